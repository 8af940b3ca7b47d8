"""Graph positioning and analytics on Spark."""

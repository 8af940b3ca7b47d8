"""Loops, whole queries and their SQL."""

"""Edges that keep coming: canonical edges and degrees kept up to date batch by batch.

An extension: a batch of new edges is made canonical, edges known already are dropped, and what is new is added to the edge
table under the batch's number. A batch that is run again overwrites its own part, so each edge counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import graph

EDGES = "src long, dst long, weight double, batch long"


def edges_so_far(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The canonical edges of all batches, or of those before one."""
    try:
        rows = spark.read.schema(EDGES).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], EDGES)
    return (rows if before is None else rows.where(F.col("batch") < before)).select("src", "dst", "weight")


def add_batch(batch: DataFrame, number: int, path: str, self_loops: str = "drop") -> None:
    new = graph.canonical(batch, self_loops).join(edges_so_far(batch.sparkSession, path, number), ["src", "dst"], "left_anti")
    new.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def follow(edges: DataFrame, path: str, checkpoint: str, self_loops: str = "drop", **trigger) -> StreamingQuery:
    """Start to ingest a stream of edges (src, dst)."""
    return edges.writeStream.foreachBatch(lambda df, number: add_batch(df, number, path, self_loops)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def degrees(spark: SparkSession, path: str) -> DataFrame:
    return graph.degree(graph.arcs(edges_so_far(spark, path)))

"""Indexes that are built once and read by queries: bucketed or partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_walks(walks: DataFrame, table: str, buckets: int = 64) -> None:
    """A table bucketed by source, so that later joins on source need no shuffle of it."""
    walks.write.mode("overwrite").bucketBy(buckets, "source").sortBy("source", "walk_no").saveAsTable(table)


def load_walks(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def save_dnpr(dnpr: DataFrame, path: str) -> None:
    dnpr.write.mode("overwrite").parquet(path)


def load_dnpr(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("node long, dnpr double").parquet(path)


def save_backward(index: DataFrame, membership: DataFrame, path: str) -> None:
    """(source, target, dppr) in folders by the target's cluster, so that a zoom reads its own cluster alone."""
    index.join(membership.select(F.col("node").alias("target"), "comm"), "target").write.mode("overwrite").partitionBy("comm").parquet(path)


def load_backward(spark: SparkSession, path: str, comm: int | None = None) -> DataFrame:
    rows = spark.read.schema("source long, target long, dppr double, comm long").parquet(path)  # an empty index has no files
    return (rows if comm is None else rows.where(F.col("comm") == comm)).select("source", "target", "dppr")


def estimate_from_index(state: DataFrame, walks: DataFrame, omega) -> DataFrame:
    """(source, node, value): reserves, plus residues carried along the first ceil(residue * omega) stored walks of their
    node; where fewer are stored, along those. A residue without any walk stays where it is. state: (source, node, reserve, residue).
    ``omega``: a number, or one for each source (source, omega)."""
    held = state.join(omega, "source") if isinstance(omega, DataFrame) else state.withColumn("omega", F.lit(float(omega)))
    stored = walks.groupBy("source").agg(F.count("*").alias("stored")).withColumnRenamed("source", "node")
    need = held.where("residue > 0").join(stored, "node", "left").select("source", "node", "residue", F.least(F.ceil(F.col("residue") * F.col("omega")), F.coalesce("stored", F.lit(0))).alias("used"))
    hop = need.where("used > 0").join(walks.select(F.col("source").alias("node"), "walk_no", "dest"), "node").where("walk_no < used")
    moved = hop.select("source", F.col("dest").alias("node"), (F.col("residue") / F.col("used")).alias("value"))
    rest = need.where("used = 0").select("source", "node", F.col("residue").alias("value"))
    return state.select("source", "node", F.col("reserve").alias("value")).unionByName(moved).unionByName(rest).groupBy("source", "node").agg(F.sum("value").alias("value"))

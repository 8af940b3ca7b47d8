"""Connected components by alternating large-star and small-star steps on a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, staged


#: The edges of a hub are dealt over so many parts.
SALTS = 16


def components(edges: DataFrame) -> DataFrame:
    """(key, comp) for every key of ``edges`` (a, b) but the roots; comp is the smallest key reachable.

    Every round is written to the shared folder. A hub's minimum is taken partially, and its edges meet it in salted parts.
    """
    spark = edges.sparkSession
    now, path = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return now.select(F.col("u").alias("key"), F.col("v").alias("comp"))
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        salted = both.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
        copies = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        large, old_large = staged(salted.join(copies.hint("merge"), ["u", "salt"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now, new_path = staged(small, "edges")
        drop(spark, path, old_large)
        path = new_path

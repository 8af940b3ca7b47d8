"""Graphs, memberships and positions that the relational tables hold; each is the whole of its tables.

ps: parts (2 * key) and suppliers (2 * key + 1) with a line item. trade: nations of customers and of suppliers, weighted by line
items. partners: each nation with its three largest partners. forest: customers (2 * key) and their orders (2 * key + 1).
chain: suppliers of one nation in a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def ps(self) -> DataFrame:
        return self.lineitem.select((2 * F.col("l_partkey")).alias("src"), (2 * F.col("l_suppkey") + 1).alias("dst"))

    def ps_sources(self) -> DataFrame:
        """(node): the suppliers with keys up to 40 that have line items; as many at any size of the tables."""
        return self.ps().where("dst <= 81").select(F.col("dst").alias("node")).distinct()

    def trade(self) -> DataFrame:
        """(src, dst, weight): customer's nation, supplier's nation, line items."""
        lines = self.lineitem.join(self.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(self.customer, F.col("o_custkey") == F.col("c_custkey")).join(self.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        return lines.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.count("*").cast("double").alias("weight"))

    def partners(self) -> DataFrame:
        """(src, dst): src's three largest partners, ties by key."""
        t = self.trade().where("src <> dst")
        both = t.unionByName(t.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
        rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
        return both.withColumn("rank", rank).where("rank <= 3").select("src", "dst")

    def forest(self) -> DataFrame:
        return self.orders.select((2 * F.col("o_custkey")).alias("src"), (2 * F.col("o_orderkey") + 1).alias("dst"))

    def chain(self) -> DataFrame:
        """Each supplier and the next of its nation."""
        nxt = F.lead("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
        return self.supplier.select(F.col("s_suppkey").alias("src"), nxt.alias("dst")).where("dst is not null")

    def ps_members(self) -> DataFrame:
        """(node, comm): parts by brand number, suppliers by 1000 + nation."""
        parts = self.part.select((2 * F.col("p_partkey")).alias("node"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("long").alias("comm"))
        return parts.unionByName(self.supplier.select((2 * F.col("s_suppkey") + 1).alias("node"), (1000 + F.col("s_nationkey")).cast("long").alias("comm")))

    def regions(self) -> DataFrame:
        """(node, comm): nations by region."""
        return self.nation.select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").cast("long").alias("comm"))

    def nation_points(self) -> DataFrame:
        """(node, x, y): mean balance of a nation's customers and mean price of their orders."""
        rows = self.customer.join(self.orders, F.col("c_custkey") == F.col("o_custkey"), "left")
        x = self.customer.groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 3).alias("x"))
        y = rows.groupBy("c_nationkey").agg(F.round(F.avg("o_totalprice") / 100, 3).alias("y"))
        return x.join(y, "c_nationkey").where("y is not null").select(F.col("c_nationkey").cast("long").alias("node"), "x", "y")

    def supplier_points(self) -> DataFrame:
        return self.supplier.select(F.col("s_suppkey").alias("node"), F.col("s_acctbal").alias("x"), (10.0 * F.col("s_suppkey")).alias("y"))

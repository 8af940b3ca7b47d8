"""Edge lists, sidecars, hierarchy files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import parse_supernode, supernode_name


def read_edges(spark: SparkSession, path: str, weighted: bool = False, n: int | None = None) -> DataFrame:
    """edges (src, dst, weight) of lines ``src dst [weight]`` parted by white space. With ``n`` an id outside 0 .. n-1
    fails the read."""
    cells = F.split(F.trim("value"), r"\s+")
    e = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(cells[0].cast("long").alias("src"), cells[1].cast("long").alias("dst"), (cells[2].cast("double") if weighted else F.lit(1.0)).alias("weight"))
    if n is None:
        return e
    bad = (F.col("src") < 0) | (F.col("src") >= n) | (F.col("dst") < 0) | (F.col("dst") >= n)
    checked = F.when(bad, F.raise_error(F.format_string("edge %d %d is outside 0 .. %d", "src", "dst", F.lit(n - 1))).cast("long")).otherwise(F.col("src"))
    return e.select(checked.alias("src"), "dst", "weight")


def write_edges(edges: DataFrame, path: str, weighted: bool = False) -> None:
    columns = ["src", "dst", *(["weight"] if weighted else [])]
    edges.select(F.concat_ws(" ", *columns).alias("value")).write.text(path)


def read_sidecar(spark: SparkSession, path: str) -> dict[str, int]:
    """The n and m of lines ``n=..`` and ``m=..``."""
    rows = spark.read.text(path).select(F.regexp_extract("value", r"^\s*(n|m)\s*=\s*(\d+)", 1).alias("k"), F.regexp_extract("value", r"^\s*(n|m)\s*=\s*(\d+)", 2).cast("long").alias("v")).where("k <> ''").limit(2).collect()
    return {r.k: r.v for r in rows}


def check_sidecar(arcs: DataFrame, sidecar: dict[str, int]) -> dict[str, tuple[int, int]]:
    """Where the sidecar differs from the graph: name -> (stated, counted)."""
    from ..operators.graph import stats

    found = stats(arcs).first()
    counted = {"n": found.n, "m": found.m}
    return {k: (v, counted[k]) for k, v in sidecar.items() if counted[k] != v}


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(component, level, id, member) of files of blocks: a name, a size, then so many ids, a line each."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                lines = iter(content.as_buffer().to_pybytes().split())
                names, members = [], []
                for name in lines:
                    size = int(next(lines))
                    names += [name.decode()] * size
                    members += [int(next(lines)) for _ in range(size)]
                    if len(members) > 100_000:
                        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(members)], ["name", "member"])
                        names, members = [], []
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(members)], ["name", "member"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "name string, member long")
    c, level, ident = parse_supernode(F.col("name"))
    return rows.select(c.alias("component"), level.alias("level"), ident.alias("id"), "member")


def read_membership(spark: SparkSession, path: str) -> DataFrame:
    return read_blocks(spark, path).withColumnRenamed("member", "leaf")


def read_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    return read_blocks(spark, path).withColumnRenamed("member", "child_id")


def read_roots(spark: SparkSession, path: str) -> DataFrame:
    c, level, ident = parse_supernode(F.trim("value"))
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.trim("value").alias("name"), c.alias("component"), level.alias("level"), ident.alias("id"))


def write_blocks(rows: DataFrame, member: str, path: str) -> None:
    """Blocks as ``read_blocks`` reads them, one file for each range of supernodes."""
    head = supernode_name(F.col("component"), F.col("level"), F.col("id"))
    key = ["component", "level", "id"]
    sizes = rows.groupBy(*key).agg(F.count("*").alias("size"))
    first = sizes.select(*key, F.explode(F.array(F.struct(F.lit(0).alias("part"), head.alias("line")), F.struct(F.lit(1).alias("part"), F.col("size").cast("string").alias("line")))).alias("x"))
    lines = first.select(*key, "x.part", F.lit(None).cast("long").alias("member"), "x.line")
    lines = lines.unionByName(rows.select(*key, F.lit(2).alias("part"), F.col(member).cast("long").alias("member"), F.col(member).cast("string").alias("line")))
    # a line each, in order inside a range of supernodes: no row holds a whole block
    lines.repartitionByRange(*key).sortWithinPartitions(*key, "part", "member").select(F.col("line").alias("value")).write.text(path)


def write_partition(membership: DataFrame, path: str) -> None:
    """Lines ``node community`` with communities renumbered from 0."""
    from ..operators.graph import dense_ids

    membership.join(dense_ids(membership.select("comm"), "comm"), "comm").orderBy("node").select(F.concat_ws(" ", "node", "new").alias("value")).write.text(path)

"""Binary graphs, positions and cached layouts of other tools; Parquet is the engine's own form.

Binary graph: int32 n, int64 cumulative degrees, int32 neighbours, little-endian; float32 weights in a file of their own.
"""

from __future__ import annotations

import os
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.loop import settle

#: Values of a binary file that a task reads at once.
STEP = 4_000_000


def _ordered(df: DataFrame, *order: str) -> tuple[DataFrame, list, int]:
    """``df`` range-partitioned by the first of ``order`` and sorted, as a written table with its part; for each part (part, rows
    before it, its first key); all rows."""
    spread = df.repartitionByRange(order[0]).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()})
    kept = settle(spread, "ordered")
    parts, total = [], 0
    for part, n, first in sorted(kept.groupBy("part").agg(F.count("*"), F.min(order[0])).collect()):  # one row for each partition
        parts.append((part, total, first))
        total += n
    return kept, parts, total


def _fill(kept: DataFrame, columns: list[str], write) -> None:
    """Run ``write(part, arrays)`` for each part's rows in order; a repeated task writes the same bytes again."""

    def run(rows):
        write(int(rows["part"].iloc[0]), rows.sort_values("row"))
        return rows[["part"]].head(0)

    kept.select("part", "row", *columns).groupBy("part").applyInPandas(run, "part int").count()


def _sized(path: str, size: int) -> None:
    with open(path, "wb") as f:
        f.truncate(size)


def write_csr(arcs: DataFrame, path: str, weights: str | None = None) -> None:
    """Write arcs over dense ids. Tasks write ranges of nodes at places that prefix sums give, so ``path`` lies in a
    file system that the driver and the executors share."""
    n = (arcs.agg(F.greatest(F.max("src"), F.max("dst"))).first()[0] or -1) + 1
    kept, parts, total = _ordered(arcs.select(F.col("src").cast("long"), F.col("dst").cast("int"), F.col("w").cast("float")), "src", "dst")
    _sized(path, 4 + 8 * n + 4 * total)
    if weights:
        _sized(weights, 4 * total)
    with open(path, "r+b") as f:
        f.write(struct.pack("<i", n))
    ends = [p[2] for p in parts[1:]] + [n]
    place = {part: (before, first if k else 0, end) for k, ((part, before, first), end) in enumerate(zip(parts, ends))}

    def write(part, rows):
        before, first, end = place[part]
        degree = np.bincount(rows["src"].to_numpy() - first, minlength=end - first)
        with open(path, "r+b") as f:
            f.seek(4 + 8 * first)
            (before + np.cumsum(degree)).astype("<i8").tofile(f)
            f.seek(4 + 8 * n + 4 * before)
            rows["dst"].to_numpy().astype("<i4").tofile(f)
        if weights:
            with open(weights, "r+b") as f:
                f.seek(4 * before)
                rows["w"].to_numpy().astype("<f4").tofile(f)

    _fill(kept, ["src", "dst", "w"], write)


class _Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class CsrReader(DataSourceReader):
    """Ranges of nodes are read apart, each by seeking to its own rows."""

    def __init__(self, options: dict):
        self.path, self.weights = options["path"], options.get("weights")
        self.step = int(options.get("nodesPerTask", 100_000))

    def partitions(self):
        with open(self.path, "rb") as f:
            (n,) = struct.unpack("<i", f.read(4))
        return [_Rows(i, min(n, i + self.step)) for i in range(0, n, self.step)] or [_Rows(0, 0)]

    def read(self, part):
        with open(self.path, "rb") as f:
            (n,) = struct.unpack("<i", f.read(4))
            f.seek(4 + 8 * max(part.first - 1, 0))
            cum = np.fromfile(f, "<i8", part.last - max(part.first - 1, 0))
            cum = cum if part.first else np.concatenate([[0], cum])
            if len(cum) < 2:
                return
            f.seek(4 + 8 * n + 4 * int(cum[0]))
            dst = np.fromfile(f, "<i4", int(cum[-1] - cum[0]))
        w = np.ones(len(dst))
        if self.weights:
            with open(self.weights, "rb") as f:
                f.seek(4 * int(cum[0]))
                w = np.fromfile(f, "<f4", len(dst)).astype(float)
        src = np.repeat(np.arange(part.first, part.last), np.diff(cum))
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst.astype(np.int64)), pa.array(w)], ["src", "dst", "w"])


class CsrSource(DataSource):
    """``spark.read.format("csrgraph").option("path", ..)[.option("weights", ..)]``"""

    @classmethod
    def name(cls):
        return "csrgraph"

    def schema(self):
        return "src long, dst long, w double"

    def reader(self, schema):
        return CsrReader(self.options)


def read_csr(spark: SparkSession, path: str, weights: str | None = None) -> DataFrame:
    spark.dataSource.register(CsrSource)
    reader = spark.read.format("csrgraph").option("path", path)
    return (reader.option("weights", weights) if weights else reader).load()


def _ranges(spark: SparkSession, files: dict[str, tuple[str, str]], schema: str, number: str | None = None) -> DataFrame:
    """The values of binary ``files`` (column: path, type) side by side; tasks read ranges by seeking. ``number``: a column for the place."""
    sizes = {os.path.getsize(path) // np.dtype(kind).itemsize for path, kind in files.values()}
    if len(sizes) > 1:
        raise ValueError("the files differ in length")
    total = sizes.pop()

    def read(batches):
        import pandas as pd

        for t in batches:
            for first in t["id"]:
                count = min(STEP, total - first)
                out = {number: np.arange(first, first + count)} if number else {}
                for column, (path, kind) in files.items():
                    out[column] = np.fromfile(path, kind, count, offset=int(first) * np.dtype(kind).itemsize)
                yield pd.DataFrame(out)

    return spark.range(0, total, STEP, max(1, -(-total // STEP))).mapInPandas(read, schema)


def _doubles(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(node, ``name``): the i-th little-endian double of a file belongs to node i."""
    return _ranges(spark, {name: (path, "<f8")}, f"node long, {name} double", "node")


def read_positions(spark: SparkSession, stem: str, radii: bool = True) -> DataFrame:
    """(node, x, y[, r]) from ``stem``.x, .y and .r."""
    out = _doubles(spark, f"{stem}.x", "x").join(_doubles(spark, f"{stem}.y", "y"), "node")
    return out.join(_doubles(spark, f"{stem}.r", "r"), "node") if radii else out


def write_positions(points: DataFrame, stem: str) -> None:
    """``stem``.x, .y and, with a column r, .r of a laid-out cluster; rows in the order of node."""
    columns = [c for c in ("x", "y", "r") if c in points.columns]
    kept, parts, total = _ordered(points.select("node", *(F.col(c).cast("double") for c in columns)), "node")
    before = {part: at for part, at, _ in parts}
    for c in columns:
        _sized(f"{stem}.{c}", 8 * total)

    def write(part, rows):
        for c in columns:
            with open(f"{stem}.{c}", "r+b") as f:
                f.seek(8 * before[part])
                rows[c].to_numpy().astype("<f8").tofile(f)

    _fill(kept, columns, write)


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """A layout (node, x, y[, r]) that was computed before or elsewhere: Parquet, or an n x 2 array in a .npy file."""
    if not path.endswith(".npy"):
        return spark.read.parquet(path)
    x = np.load(path)
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "node long, x double, y double")


def write_layout(points: DataFrame, path: str) -> None:
    """Parquet, or an n x 2 array if the path ends in .npy."""
    if path.endswith(".npy"):
        np.save(path, points.orderBy("node").select("x", "y").toPandas().to_numpy())
    else:
        points.write.mode("overwrite").parquet(path)


def read_ppr(spark: SparkSession, path: str) -> DataFrame:
    """(source, node, value) that was computed before: Parquet, or the three files ``path``.src, .dst (int32) and .ppr (float64)."""
    from os.path import exists

    if not exists(f"{path}.src"):
        return spark.read.parquet(path)
    return _ranges(spark, {"source": (f"{path}.src", "<i4"), "node": (f"{path}.dst", "<i4"), "value": (f"{path}.ppr", "<f8")}, "source long, node long, value double")

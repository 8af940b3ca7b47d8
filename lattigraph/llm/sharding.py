"""Sharding (operator 7): a Feistel permutation with cycle walking over global row numbers.

Rows are numbered from 0 in the order of (doc_id, text checksum, size): a range shuffle of these small
columns alone, then prefix sums over the ranges' counts. The permuted number p gives shard p mod k and slot
p div k, so anyone with the key can compute a row's place or, by the inverse, the row at a place. The law is
``rows``: the shards' counts differ by one at most. Rows that agree in all three columns are
interchangeable, so the result does not depend on how files were split.

Defined results: a null text has size 8 and checksum 0; null ids come first; repeated rows each get a
place; an empty table yields no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Feistel, drop, staged, table

SHARDS = 24
KEY = "shard-order-1"


def numbered(rows: DataFrame, order: list[str], name: str = "numbered") -> tuple[DataFrame, dict[int, int], int]:
    """``rows`` range-partitioned and sorted by ``order``, as a written table with columns (part, idx), the
    number of rows before each part, and the count. part and idx are deterministic up to rows equal in ``order``."""
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    spread = spread.withColumns({"part": F.spark_partition_id(), "idx": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    kept, _ = staged(spread, name)
    base, total = {}, 0
    for part, n in sorted(kept.groupBy("part").count().collect()):  # one row for each partition
        base[part] = total
        total += n
    return kept, base, total


def shard(docs: DataFrame, shards: int = SHARDS, key: str = KEY) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row."""
    text = F.col("text").cast("string")
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"))
    first, path = staged(small, "sizes")  # the range shuffle samples its input: texts are read once
    rows, base, total = numbered(first, ["doc_id", "text_crc32", "size"])
    drop(docs.sparkSession, path)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Feistel(total, key)
        for b in batches:
            part, idx = b.column(3).to_numpy(), b.column(4).to_numpy()
            p = order.forward(idx + np.fromiter((base[x] for x in part), np.int64, len(part)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(["rows"] * len(p), pa.string()), pa.array((p % shards).astype(np.int32)), pa.array(p // shards), pa.nulls(len(p), pa.int32())], ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"])

    return rows.select("doc_id", "size", "text_crc32", "part", "idx").mapInArrow(place, "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))

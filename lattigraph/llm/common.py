"""What the training-data operators share: a shared scratch folder, staged tables, key permutations.

Scratch tables go to the folder that the cluster names in ``spark.checkpoint.dir``, as those of the engine's loops do. A staged
table is a written Parquet table: it cuts lineage and survives the loss of executors.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import fresh
from ..plans.loop import scratch


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Write ``df`` and return the written table and its path."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove staged tables that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Feistel:
    """A keyed permutation of 0..n-1, forward and back.

    An alternating Feistel network of ``rounds`` (even) rounds permutes the integers of just enough bits;
    a value that falls outside 0..n-1 is permuted again until it falls inside (cycle walking). The domain is
    under 2n, so two walks are expected at most.
    """

    def __init__(self, n: int, key: str, rounds: int = 6):
        if rounds % 2:
            raise ValueError("rounds must be even")
        self.n = int(n)
        bits = max(2, (max(self.n, 1) - 1).bit_length())
        self.low = bits // 2
        self.high = bits - self.low
        self.keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}/{r}".encode(), digest_size=8).digest(), "little")) for r in range(rounds)]

    def _once(self, x: np.ndarray) -> np.ndarray:
        a, b = self.high, self.low
        left, right = x >> np.uint64(b), x & np.uint64((1 << b) - 1)
        for key in self.keys:
            left, right = right, left ^ (mix64(right + key) & np.uint64((1 << a) - 1))
            a, b = b, a
        return (left << np.uint64(b)) | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        a, b = self.high, self.low
        left, right = x >> np.uint64(b), x & np.uint64((1 << b) - 1)
        for key in reversed(self.keys):
            a, b = b, a
            left, right = right ^ (mix64(left + key) & np.uint64((1 << a) - 1)), left
        return (left << np.uint64(b)) | right

    def _walk(self, x, step) -> np.ndarray:
        out = np.array(x, dtype=np.uint64)
        if self.n <= 1:
            return np.zeros(len(out), np.int64)
        with np.errstate(over="ignore"):
            out = step(out)
            while len(outside := np.flatnonzero(out >= np.uint64(self.n))):
                out[outside] = step(out[outside])
        return out.astype(np.int64)

    def forward(self, x) -> np.ndarray:
        return self._walk(x, self._once)

    def inverse(self, x) -> np.ndarray:
        return self._walk(x, self._back)

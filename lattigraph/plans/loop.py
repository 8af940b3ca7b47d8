"""Driver loops over DataFrames.

A loop's state is written as a table each round, in the folder that the cluster names in ``spark.checkpoint.dir``
or that ``SparkContext.setCheckpointDir`` set. That cuts the plan's lineage, survives lost executors and
lets the round before be removed. Without either, a temporary folder of this machine serves a local master, as in tests; a
cluster is refused, since its executors would not share such a folder.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def scratch(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="lattigraph-"))
        atexit.register(shutil.rmtree, _local[0], True)
    return "file://" + _local[0]


def mounted(spark: SparkSession) -> str | None:
    """The scratch folder as a mounted file's path; None if it is in a store that only Spark reads."""
    path = scratch(spark)
    return None if "://" in path and not path.startswith("file:") else "/" + path.removeprefix("file:").lstrip("/")


class Settled:
    """A written table that can be removed again."""

    def __init__(self, df: DataFrame, name: str = "state"):
        self.path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = df.sparkSession.read.schema(df.schema).parquet(self.path)

    def remove(self) -> None:
        spark = self.df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def settle(df: DataFrame, name: str = "state") -> DataFrame:
    """``df`` as a written table."""
    return Settled(df, name).df

"""The corpus pipeline: quality classifier, near-dedup, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read
again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattigraph.llm.common import drop, staged, table
from lattigraph.llm.decontamination import decontaminate
from lattigraph.llm.near_dedup import deduplicate
from lattigraph.llm.packing import pack
from lattigraph.llm.quality import filter_quality, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of the documents it is given."""
    return filter_quality(docs, train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: texts that share 80 % of their five-word shingles or more, linked."""
    return deduplicate(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, packed into sequences."""
    return pack(docs)


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("packing", packing)]
#: The stages are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs, path = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop(spark, *before)
        before = [path]
    out = STAGES[-1][1](spark, docs, sf_dir)
    drop(spark, *before)  # packing has written the ids that it reads
    return out

"""Packing (operator 2): concatenate and cut.

All documents' ids, each document closed by an end id, form one stream in the order of the input's partitions
and rows. Pass one writes every document's ids with the running sum inside its partition; the partitions'
totals (a row for each partition) are summed up into global offsets. Pass two cuts the stream at multiples of
the sequence length: each document yields a piece for each window it touches, and a piece that ends at a
window's edge while its document goes on is a boundary record, as is its sequel. No shuffle is needed.

Defined results: a null or empty text is its end id alone; repeated rows are packed as often as they come;
a null ``doc_id`` is kept; an empty table yields no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table
from .tokens import encoder

LENGTH = 4096
VOCABULARY = "word_bpe_49k.json"
END = 2


@dataclass
class TokenTable:
    """Written ids (part, before, doc_id, n, ids) with the global offset of each partition's first token."""

    rows: DataFrame
    path: str
    base: dict[int, int]
    total: int
    dtype: str


def tokenize(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, dtype: str = "<u2") -> TokenTable:
    """Pass one: ids as a written table, and the prefix sums of the partitions' totals."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, enc = TaskContext.get().partitionId(), 0, encoder(vocabulary, dtype)
        last = np.array([end], dtype).tobytes()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                some = batch.slice(start, 512)
                ids = [x + last for x in enc.encode(some.column(1).to_pylist())]
                n = np.fromiter(map(len, ids), np.int64, len(ids)) // len(last)
                at = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), pa.array(at), some.column(0), pa.array(n), pa.array(ids, pa.binary())], ["part", "before", "doc_id", "n", "ids"])

    rows, path = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, "part int, before long, doc_id long, n long, ids binary"), "tokens")
    base, total = {}, 0
    for part, n in sorted(rows.groupBy("part").agg(F.sum("n").alias("n")).collect()):  # one row for each partition
        base[part] = total
        total += n
    return TokenTable(rows, path, base, total, dtype)


def _cuts(start: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For documents at global offsets: row, start in the document, length, sequence, offset of each piece."""
    first, last = start // length, (start + n - 1) // length
    count = last - first + 1
    row = np.repeat(np.arange(len(n)), count)
    seq = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
    begin = np.maximum(start[row], seq * length)
    size = np.minimum(start[row] + n[row], (seq + 1) * length) - begin
    return row, begin - start[row], size, seq, begin - seq * length


def cut(tokens: TokenTable, length: int = LENGTH, with_ids: bool = False, extra=None, coded=None) -> DataFrame:
    """Pass two: a row for each piece; ``with_ids`` adds the piece's ids as little-endian bytes.

    ``extra`` = (name, function) adds a long column computed from the array of sequence ids; ``coded``: a function that is applied to
    the bytes of each piece.
    """
    base, dtype, wide = tokens.base, tokens.dtype, np.dtype(tokens.dtype).itemsize

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                part, before, n = (batch.column(i).to_numpy() for i in (0, 1, 3))
                start = before + np.fromiter((base[p] for p in part), np.int64, len(part))
                row, begin, size, seq, offset = _cuts(start, n, length)
                ids = batch.column(4)
                flat = [ids[int(r)].as_buffer() for r in range(len(n))]
                views = [np.frombuffer(flat[r], dtype, s, b * wide) for r, b, s in zip(row, begin, size)]
                crc = np.fromiter((zlib.crc32(v.astype("<u4").tobytes()) for v in views), np.int64, len(views))
                out = [batch.column(2).take(pa.array(row)), pa.array(begin), pa.array(size), pa.array(crc), pa.array(n[row]), pa.array(seq), pa.array(offset)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if extra:
                    out.append(pa.array(extra[1](seq)))
                    names.append(extra[0])
                if with_ids:
                    out.append(pa.array([coded(v.tobytes()) if coded else v.tobytes() for v in views], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return tokens.rows.mapInArrow(pieces, schema + (f", {extra[0]} long" if extra else "") + (", ids binary" if with_ids else ""))


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents; see the module."""
    return cut(tokenize(docs, vocabulary, end), length, with_ids)


def sequences(pieces: DataFrame, length: int = LENGTH, pad: int = 0, dtype: str = "<u2") -> DataFrame:
    """The sequences themselves from pieces with ids: (sequence_id, n_tokens, ids, boundaries).

    A sequence has at most ``length`` ids, so its pieces are few. It is padded to ``length``, unless its own
    length is a power of two.
    """

    def join(batch):
        import pandas as pd

        rows = []
        for sid, g in batch.sort_values("offset").groupby("sequence_id"):
            n = int(g["length"].sum())
            ids = b"".join(g["ids"]) + (b"" if n & (n - 1) == 0 else np.full(length - n, pad, dtype).tobytes())
            rows.append((sid, n, ids, [int(x) for x in g["offset"]]))
        return pd.DataFrame(rows, columns=["sequence_id", "n_tokens", "ids", "boundaries"])

    return pieces.select("sequence_id", "offset", "length", "ids").groupBy("sequence_id").applyInPandas(join, "sequence_id long, n_tokens long, ids binary, boundaries array<long>")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

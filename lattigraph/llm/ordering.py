"""Training-order materialisation (operator 6).

Documents are packed into sequences (operator 2). A keyed Feistel permutation with cycle walking gives every
sequence a global slot, so slots and sequences can be computed from each other without a table. Slots are cut
into ranges of ``per_shard``, a file each; a task writes the files of neighbouring ranges, up to ``TASK_BYTES``, so that
partitions grow with the data over that size and not with the number of files. Pieces are sent straight to the
partition of their range (the number of slots is known, so nothing is sampled), sorted by slot and offset, and written in one pass as fixed-stride
records: the record of slot s lies in file s div per_shard at byte (s mod per_shard) * stride. A reader can
thus resume anywhere. A file is written under the task attempt's own name and renamed when whole, so a lost
executor leaves no partial shard.

Sequences are numbered in the order of packing, that of the input's files and rows: other files give other sequences.

Defined results: as in packing; the last sequence is filled up with ``pad``; an empty table yields no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Feistel, drop, new_path, staged, table
from .packing import END, LENGTH, VOCABULARY, cut, tokenize

KEY = "training-order-1"
PER_SHARD = 1024
TASK_BYTES = 256 << 20


@dataclass
class Shards:
    """Written shards: their manifest (shard, first_slot, records, bytes, path) and what locates a record."""

    manifest: DataFrame
    folder: str
    n_sequences: int
    n_tokens: int
    length: int
    per_shard: int
    dtype: str
    key: str

    def locate(self, slot: int) -> tuple[str, int]:
        """The file and the byte at which a slot's record starts."""
        return f"{self.folder}/{slot // self.per_shard:08d}.bin", slot % self.per_shard * self.length * np.dtype(self.dtype).itemsize

    def read(self, first_slot: int = 0) -> DataFrame:
        """Records from ``first_slot`` on, read back from the files: (slot, shard, row, sequence_id, n_tokens, ids)."""
        n_seq, total, length, per, dtype, key = self.n_sequences, self.n_tokens, self.length, self.per_shard, self.dtype, self.key
        stride = length * np.dtype(dtype).itemsize

        def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            order = Feistel(n_seq, key)
            for batch in batches:
                for shard, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    slot = max(first_slot, shard * per)
                    with _open(path, "rb") as f:
                        f.seek((slot - shard * per) * stride)
                        while block := f.read(stride * 64):
                            slots = np.arange(slot, slot + len(block) // stride)
                            slot = int(slots[-1]) + 1
                            seq = order.inverse(slots)
                            n = np.where(seq == n_seq - 1, total - (n_seq - 1) * length, length)
                            ids = [block[i * stride : i * stride + int(k) * (stride // length)] for i, k in enumerate(n)]
                            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(np.full(len(n), shard)), pa.array(slots % per), pa.array(seq), pa.array(n), pa.array(ids, pa.binary())], ["slot", "shard", "row", "sequence_id", "n_tokens", "ids"])

        some = self.manifest.where(F.col("first_slot") + F.col("records") > first_slot).select("shard", "path")
        return some.mapInArrow(records, "slot long, shard long, row long, sequence_id long, n_tokens long, ids binary")


def _open(path: str, mode: str):
    """A file of the shared folder: a mounted path, or any store that Arrow reaches by its address."""
    if path.startswith("file:") or "://" not in path:
        return open("/" + path.removeprefix("file:").lstrip("/"), mode)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_output_stream(inner) if "w" in mode else store.open_input_file(inner)


def _rename(a: str, b: str) -> None:
    if a.startswith("file:") or "://" not in a:
        os.replace("/" + a.removeprefix("file:").lstrip("/"), "/" + b.removeprefix("file:").lstrip("/"))
    else:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(a)
        store.move(inner, fs.FileSystem.from_uri(b)[1])


def materialise(docs: DataFrame, folder: str | None = None, key: str = KEY, per_shard: int = PER_SHARD, length: int = LENGTH, vocabulary: str = VOCABULARY, end: int = END, pad: int = 0, dtype: str = "<u2", task_bytes: int = TASK_BYTES) -> Shards:
    """Write all sequences of ``docs`` in training order."""
    spark = docs.sparkSession
    tokens = tokenize(docs, vocabulary, end, dtype)
    n_seq = -(-tokens.total // length)
    folder = folder or new_path(spark, "shards")
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)
    n_shards = max(1, -(-n_seq // per_shard))
    stride = length * np.dtype(dtype).itemsize

    # enough tasks for all cores, and no more bytes in a task than asked for
    span = max(1, min(task_bytes // (per_shard * stride), -(-n_shards // (2 * spark.sparkContext.defaultParallelism))))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        me = TaskContext.get().taskAttemptId()
        out, shard, records, now, filled, done = None, -1, 0, -1, 0, []
        filler = np.full(length, pad, dtype).tobytes()

        def close() -> None:
            out.write(filler[filled:])
            out.close()
            final = f"{folder}/{shard:08d}.bin"
            _rename(f"{final}.{me}", final)
            done.append((shard, shard * per_shard, records, records * stride, final))

        for batch in batches:
            for slot, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if slot // per_shard != shard:
                    if out is not None:
                        close()
                    shard, records, now, filled = slot // per_shard, 0, -1, 0
                    out = _open(f"{folder}/{shard:08d}.bin.{me}", "wb")
                if slot != now:
                    if filled:
                        out.write(filler[filled:])
                    now, filled, records = slot, 0, records + 1
                ids = zstandard.decompress(ids)
                out.write(ids)
                filled += len(ids)
        if out is not None:
            close()
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], ["shard", "first_slot", "records", "bytes", "path"])

    # ids are shuffled in compressed form
    pieces = cut(tokens, length, with_ids=True, extra=("slot", Feistel(n_seq, key).forward), coded=zstandard.compress)
    routed = pieces.select("slot", "offset", "ids").repartitionById(-(-n_shards // span), F.floor(F.col("slot") / (per_shard * span)).cast("int")).sortWithinPartitions("slot", "offset")
    manifest, _ = staged(routed.mapInArrow(write, "shard long, first_slot long, records long, bytes long, path string"), "manifest")
    drop(spark, tokens.path)
    return Shards(manifest, folder, n_seq, tokens.total, length, per_shard, dtype, key)


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slot as read back from the written shards, with the checksum of its ids."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = [zlib.crc32(np.frombuffer(x.as_buffer(), "<u2").astype("<u4").tobytes()) for x in b.column(5)]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(crc, pa.int64())], ["slot", "shard", "row", "sequence_id", "n_tokens", "ids_crc32"])

    return materialise(table(spark, sf_dir, "documents")).read().mapInArrow(digest, "slot long, shard long, row long, sequence_id long, n_tokens long, ids_crc32 long")

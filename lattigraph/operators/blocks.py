"""Steps over a graph of any weights, directions and number of nodes, as a join that is laid out in files of the shared folder.

``lay`` numbers the nodes in order and writes the arcs by where they end, a block of ends at a time. The vectors of many sources stand in a
file, one after the other. In a step a task joins the arcs of a block with all these vectors, which it maps, and writes the block's values at
their places in the next file: arcs are read once for all sources, nothing is shuffled, and memory holds a block's values, never
a vector over nodes. A block's arcs are ordered by the ``TILE`` of nodes that they come from, whose values stay in the cache. It refuses folders that are not mounted and nodes at which more than ``NODES`` arcs end.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.loop import Settled, mounted, settle
from .csr import BLOCK, NODES, places
from .graph import dense_ids

#: Arcs, or nodes, that a task reads at once, and that it joins at once; values of a step's vectors together.
PIECE, NEAR, HELD = 1_000_000, 250_000, 64_000_000

#: Binary logarithm of the nodes in a tile, and the most tiles.
TILE, TILES = 17, 64


def gathered(batches, most: int):
    """The columns of so many rows at a time."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= most:
            yield [np.concatenate([x.column(i).to_numpy(zero_copy_only=False) for x in held]) for i in range(b.num_columns)]
            held, size = [], 0
    if size:
        yield [np.concatenate([x.column(i).to_numpy(zero_copy_only=False) for x in held]) for i in range(held[0].num_columns)]


def summed(parts) -> list[np.ndarray]:
    """Nodes in order, each once, and the sums of their weights that leave and of the arcs that come; of parts that hold such columns."""
    held, size, most = [], 0, 4 * PIECE

    def together():
        node, leave, come = (np.concatenate([h[i] for h in held]) for i in range(3))
        low = int(node.min())
        if int(node.max()) - low < 8 * len(node):
            place = node - low
            ids = np.flatnonzero(np.bincount(place))
            return [ids + low, np.bincount(place, leave)[ids], np.bincount(place, come)[ids].astype(np.int64)]
        ids, place = np.unique(node, return_inverse=True)
        return [ids, np.bincount(place, leave), np.bincount(place, come).astype(np.int64)]

    for x in parts:
        held.append(x)
        size += len(x[0])
        if size >= most:
            held = [together()]
            size = len(held[0][0])
            most = max(most, 2 * size)
    return together() if size else [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]


def _tally(batches):
    """A task's nodes and their sums, a row for nodes of 1,024 ids; the least and the largest weight of the task."""
    bounds = [np.inf, -np.inf]

    def parts():
        for src, dst, w in gathered(batches, PIECE):
            bounds[:] = min(bounds[0], w.min()), max(bounds[1], w.max())
            yield np.r_[src, dst], np.r_[w, np.zeros(len(dst))], np.repeat([0, 1], len(src))

    node, leave, come = summed(parts())
    if len(node):
        bucket, at = node >> 10, (node & 1023).astype(np.int16)
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        for some in np.array_split(np.arange(len(cuts) - 1), -(-(len(cuts) - 1) // 10_000)):
            out = [pa.array([x[cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary()) for x in (at, leave, come)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[some]]), *out, *(pa.array(np.full(len(some), x)) for x in bounds)], ["bucket", "at", "leave", "come", "low", "high"])


def _total(batches):
    """The nodes of a partition's tallies."""
    bounds = [np.inf, -np.inf]

    def parts():
        for b in batches:
            bounds[:] = min(bounds[0], pc.min(b.column(4)).as_py()), max(bounds[1], pc.max(b.column(5)).as_py())
            at, leave, come = (np.frombuffer(b"".join(b.column(i).to_pylist()), t) for i, t in ((1, np.int16), (2, np.float64), (3, np.int64)))
            yield (np.repeat(b.column(0).to_numpy(), pc.binary_length(b.column(1)).to_numpy() // 2) << 10) + at, leave, come

    rows = summed(b for b in parts() if len(b[0]))
    for k in range(0, len(rows[0]), PIECE // 10):
        some = [x[k : k + PIECE // 10] for x in rows]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*some, *(np.full(len(some[0]), x) for x in bounds))], ["node", "leave", "come", "low", "high"])


def _file(path: str, kind, size: int) -> str:
    """A file of zeros, which takes space where it is written."""
    with open(path, "wb") as f:
        f.truncate(size * np.dtype(kind).itemsize)
    return path


def _at(path: str, kind, write: bool = False) -> np.ndarray:
    return np.memmap(path, kind, "r+" if write else "r")


class Laid:
    """A folder: ids, the weights that ``leave`` a node, and the arcs (src, and w if ``each`` is none). Block k has the nodes ends[k] .. ends[k + 1]
    and the arcs from place[k] on; in it, arcs of one tile to one node stand together, from cut[j] on those to the block's node row[j]."""

    def __init__(self, spark, path: str, n: int, ends: np.ndarray, place: np.ndarray, each: float | None):
        self.spark, self.path, self.n, self.ends, self.place, self.each = spark, path, n, ends, place, each

    def sums(self, seeds: DataFrame, steps: int, alpha: float) -> DataFrame:
        """(source, node, value): alpha times the sum over i = 0 .. ``steps`` of the seeds (source, node, value; each pair once) moved i times
        and multiplied by 1 - alpha each time. In each step the seeds are added again, which leaves the sum over steps. What the result
        does not read is removed, so this is asked once."""
        path, n, blocks, each, ends, place, near = self.path, self.n, len(self.ends) - 1, self.each, self.ends, self.place, NEAR
        named = dense_ids(seeds, "source")
        sources = max(named.count(), 1)
        width = -(-sources // -(-sources // max(1, HELD // n)))
        named = settle(named.select("source", F.floor(F.col("new") / width).alias("part"), (F.col("new") % width).alias("slot")))
        begin = settle(seeds.join(named, "source").select("part", "slot", "node", "value"))
        factor = (1 - alpha) * (1.0 if each is None else each)

        def share(leave):
            return factor / np.where(leave != 0, leave, 1)

        def start(batches):
            """Seeds at their places: as they are, and as the first step moves them."""
            find, leave = _finder(path), _at(f"{path}/leave", np.float64)
            for part, slot, node, value in gathered(batches, PIECE):
                at = find(node)
                for name, x in ((f"seeds-{part[0]}", value), (f"x-{part[0]}-0", value * share(leave[at]))):
                    out = _at(f"{path}/{name}", np.float64, True)
                    out[slot * n + at] = x
                    out.flush()
                yield pa.RecordBatch.from_arrays([pa.array([len(at)])], ["rows"])

        def move(part: int, k: int):
            def run(batches):
                src, leave = _at(f"{path}/src", np.int32), _at(f"{path}/leave", np.float64)
                w = _at(f"{path}/w", np.float64) if each is None else None
                seeds, x = (_at(f"{path}/{name}", np.float64).reshape(-1, n) for name in (f"seeds-{part}", f"x-{part}-{k}"))
                with open(f"{path}/x-{part}-{k + 1}", "r+b") as out:
                    for b in batches:
                        for block in b["id"]:
                            lo, hi, first = ends[block], ends[block + 1], place[block]
                            new = np.array(seeds[:, lo:hi])
                            if place[block + 1] > first:
                                cut, row, tile = (_at(f"{path}/{name}-{block}", kind) for name, kind in (("cut", np.int64), ("row", np.int32), ("tile", np.int64)))
                                for i, j in pieces(cut, tile, near):
                                    arcs, cuts, rows = np.asarray(src[first + cut[i] : first + cut[j]], np.intp), cut[i:j] - cut[i], np.asarray(row[i:j])
                                    moved = np.empty(len(arcs))
                                    for values, to in zip(x, new):
                                        np.take(np.asarray(values), arcs, out=moved, mode="clip")
                                        if w is not None:
                                            np.multiply(moved, w[first + cut[i] : first + cut[j]], out=moved)
                                        to[rows] += np.add.reduceat(moved, cuts)
                            if k + 1 < steps:
                                new *= share(leave[lo:hi])
                            for i, to in enumerate(new):
                                out.seek(8 * (i * n + int(lo)))
                                out.write(to.data)
                            yield pd.DataFrame({"rows": [int(hi - lo)]})

            return run

        for part, slots in sorted(named.groupBy("part").count().collect()):
            for name in (f"seeds-{part}", f"x-{part}-0"):
                _file(f"{path}/{name}", np.float64, slots * n)
            begin.where(F.col("part") == part).mapInArrow(start, "rows long").agg(F.sum("rows")).first()
            for k in range(steps):
                _file(f"{path}/x-{part}-{k + 1}", np.float64, slots * n)
                if self.spark.range(0, blocks, 1, blocks).mapInPandas(move(part, k), "rows long").agg(F.sum("rows")).first()[0] != n:
                    raise RuntimeError("a block was not moved")
                os.remove(f"{path}/x-{part}-{k}")
            os.replace(f"{path}/{f'x-{part}-{steps}' if steps else f'seeds-{part}'}", f"{path}/value-{part}")
            for name in (f"seeds-{part}", f"x-{part}-0"):
                if os.path.exists(f"{path}/{name}"):
                    os.remove(f"{path}/{name}")
        for name in os.listdir(path):
            if name.partition("-")[0] not in ("ids", "value"):
                os.remove(f"{path}/{name}")

        def read(batches):
            ids = _at(f"{path}/ids", np.int64)
            for b in batches:
                for source, part, slot, k in zip(*(x.to_pylist() for x in b.columns)):
                    lo, hi = k * PIECE, min(n, (k + 1) * PIECE)
                    value = _at(f"{path}/value-{part}", np.float64)[slot * n + lo : slot * n + hi]
                    hit = np.flatnonzero(value)
                    for some in np.array_split(hit, -(-len(hit) // (PIECE // 10))) if len(hit) else ():
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), source)), pa.array(ids[lo + some]), pa.array(alpha * value[some])], ["source", "node", "value"])

        each_piece = named.select("source", "part", "slot", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // PIECE))).alias("k"))
        return each_piece.repartition(_spread(self.spark)).mapInArrow(read, "source long, node long, value double")


def _spread(spark) -> int:
    return 3 * spark.sparkContext.defaultParallelism


def pieces(cut: np.ndarray, tile: np.ndarray, most: int):
    """Ranges of rows, each of one tile and of up to ``most`` arcs, or one row; ``tile``: the first row of each, and their number."""
    for first, end in zip(tile[:-1].tolist(), tile[1:].tolist()):
        while first < end:
            to = int(np.searchsorted(cut[first : end + 1], cut[first] + most, side="right")) - 1
            to = first + max(1, to)
            yield first, to
            first = to


def _finder(path: str):
    """Nodes' numbers."""
    ids = _at(f"{path}/ids", np.int64)
    table = _at(f"{path}/table", np.int32) if os.path.exists(f"{path}/table") else None
    return lambda nodes: places(ids, int(ids[0]), table, nodes)


def lay(a: DataFrame, seeds: DataFrame) -> Laid | None:
    """Arcs (src, dst, w) and the nodes of ``seeds`` (node) in files."""
    spark, folder = a.sparkSession, mounted(a.sparkSession)
    if folder is None:
        return None
    a = a.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("w").cast("double").alias("w")).where("src is not null and dst is not null and w is not null")
    tallies = a.coalesce(_spread(spark)).mapInArrow(_tally, "bucket long, at binary, leave binary, come binary, low double, high double")
    nodes = Settled(tallies.repartition("bucket").mapInArrow(_total, "node long, leave double, come long, low double, high double"))
    low, high, most, m = nodes.df.agg(F.min("low"), F.max("high"), F.max("come"), F.sum("come")).first()
    if not m or most > NODES:
        nodes.remove()
        return None
    each = low if low == high else None
    all_nodes = nodes.df.select("node", "leave", "come").unionByName(seeds.select(F.col("node").cast("long").alias("node"), F.lit(0.0).alias("leave"), F.lit(0).cast("long").alias("come")))
    ordered = all_nodes.groupBy("node").agg(F.sum("leave").alias("leave"), F.sum("come").alias("come")).repartitionByRange("node").sortWithinPartitions("node")
    ordered = Settled(ordered.withColumns({"part": F.spark_partition_id(), "idx": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    nodes.remove()
    before, n = [], 0
    for part, count in sorted(ordered.df.groupBy("part").count().collect()):  # one row for each partition
        before.append((part, n))
        n += count
    if n >= 1 << 31:
        ordered.remove()
        return None
    path = f"{folder}/blocks-{uuid.uuid4().hex}"
    os.makedirs(path)
    for name, kind in (("ids", np.int64), ("leave", np.float64), ("come", np.int64)):
        _file(f"{path}/{name}", kind, n)

    def number(batches):
        for new, *columns in gathered(batches, PIECE):
            for name, x in zip(("ids", "leave", "come"), columns):
                out = _at(f"{path}/{name}", x.dtype, True)
                out[new] = x
                out.flush()
            yield pa.RecordBatch.from_arrays([pa.array([len(new)])], ["rows"])

    numbered = ordered.df.join(F.broadcast(spark.createDataFrame(before, "part int, before long")), "part").select((F.col("before") + F.col("idx")).alias("new"), "node", "leave", "come")
    numbered.mapInArrow(number, "rows long").agg(F.sum("rows")).first()
    ordered.remove()
    ids, come = _at(f"{path}/ids", np.int64), _at(f"{path}/come", np.int64)
    lowest = int(ids[0])
    if n <= NODES and int(ids[-1]) - lowest < 8 * n:
        table = np.full(int(ids[-1]) - lowest + 1, -1, np.int32)
        table[ids - lowest] = np.arange(n)
        table.tofile(f"{path}/table")
    with open(f"{path}/starts", "wb") as f:
        upto = np.zeros(1, np.int64)
        upto.tofile(f)
        for k in range(0, n, PIECE):
            upto = np.cumsum(np.r_[upto[-1], come[k : k + PIECE]])[1:]
            upto.tofile(f)
    os.remove(f"{path}/come")
    starts = _at(f"{path}/starts", np.int64)
    size = min(BLOCK, max(NEAR, -(-m // _spread(spark))))
    firsts = np.unique(np.r_[np.searchsorted(starts, np.arange(0, m, size), side="right") - 1, np.arange(0, n, -(-n // _spread(spark)))])
    ends = np.append(firsts, n)
    place, shift = np.array(starts[ends]), max(TILE, (n // TILES).bit_length())
    os.remove(f"{path}/starts")
    _file(f"{path}/src", np.int32, m)
    if each is None:
        _file(f"{path}/w", np.float64, m)

    def deal(batches):
        """Arcs by the block of their end."""
        find, kind = _finder(path), np.int16 if len(firsts) < 1 << 15 else np.int32
        for src, dst, *w in gathered(batches, PIECE):
            d = find(dst)
            block = (np.searchsorted(firsts, d, side="right") - 1).astype(kind)
            order = np.argsort(block, kind="stable")
            cuts = np.r_[0, np.cumsum(np.bincount(block, minlength=len(firsts)))]
            columns = [x[order] for x in (find(src).astype(np.int32), d.astype(np.int32), *w)]
            some = np.flatnonzero(np.diff(cuts))
            out = [pa.array([x[cuts[k] : cuts[k + 1]].tobytes() for k in some], pa.binary()) for x in columns]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *out], ["block", "s", "d", "w"][: 1 + len(out)])

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        """A block's arcs by the tile that they come from, their ends and where they come from."""
        k = int(part["block"].iloc[0])
        s, d = (np.frombuffer(b"".join(part[c]), np.int32).astype(np.int64) for c in "sd")
        rows, inside = int(ends[k + 1] - ends[k]), (1 << shift) - 1
        key = (((s >> shift) * rows + d - ends[k]) << shift) + (s & inside)
        columns = []
        if each is None:
            order = np.argsort(key, kind="stable")
            key = key[order]
            columns.append(("w", np.frombuffer(b"".join(part["w"]), np.float64)[order]))
        else:
            key.sort()
        line = key >> shift
        cut = np.flatnonzero(np.r_[True, line[1:] != line[:-1], True])
        tile, row = np.divmod(line[cut[:-1]], rows)
        columns.append(("src", ((line // rows << shift) + (key & inside)).astype(np.int32)))
        for name, x in columns:
            with open(f"{path}/{name}", "r+b") as f:
                f.seek(x.itemsize * int(place[k]))
                f.write(x.data)
        for name, x in (("cut", cut), ("row", row.astype(np.int32)), ("tile", np.flatnonzero(np.r_[True, tile[1:] != tile[:-1], True]))):
            own = f"{path}/{uuid.uuid4().hex}"
            x.tofile(own)
            os.replace(own, f"{path}/{name}-{k}")  # a task that is run again does the same
        return pd.DataFrame({"arcs": [len(key)]})

    dealt = a.select("src", "dst", *(["w"] if each is None else [])).mapInArrow(deal, "block int, s binary, d binary" + (", w binary" if each is None else ""))
    if (dealt.groupBy("block").applyInPandas(fill, "arcs long").agg(F.sum("arcs")).first()[0] or 0) != m:
        raise RuntimeError("arcs changed while they were written")
    return Laid(spark, path, n, ends, place, each)

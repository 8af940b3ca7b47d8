"""A graph in compressed rows: the fast way for graphs of a checked size.

``compact`` counts arcs first. Up to ``LIMIT`` they are broadcast. Beyond, tasks write the rows of an undirected graph with equal
weights into one file of the shared folder, which tasks map and read in pieces: memory then holds vectors over nodes, never the
arcs. It refuses other graphs, more than ``NODES`` nodes and folders that are not mounted; callers then run their DataFrame
loop instead. Sources are spread over tasks, so only the graph is repeated, never the state of all sources.

``undirected`` writes the rows straight from edges, parallel ones and loops among them: these are read twice and shuffled once,
and arcs are never a table.
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
from .graph import known, symmetric, weighted

LIMIT = 2_000_000

#: Edges of more arcs are written as rows at once.
FEW = 500_000

#: Nodes of a mapped graph; arcs that a task writes, and that it reads at once.
NODES, BLOCK, PIECE = 16_000_000, 4_000_000, 1_000_000


def places(ids: np.ndarray, lowest: int, table: np.ndarray | None, nodes: np.ndarray) -> np.ndarray:
    """Places of nodes among ids; -1 for others. ``table``: the place of each id from ``lowest`` on, where ids are dense."""
    if table is None:
        at = np.minimum(np.searchsorted(ids, nodes), max(len(ids) - 1, 0))
        return np.where(ids[at] == nodes, at, -1) if len(ids) else np.full(len(nodes), -1)
    at = nodes - lowest
    inside = (at >= 0) & (at < len(table))
    return np.where(inside, table[np.where(inside, at, 0)], -1)


def ranges(starts: np.ndarray, count: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + count[0], then the next."""
    return np.repeat(starts - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(int(count.sum()))


class Csr:
    """ids in order; arcs of node i at starts[i] .. starts[i + 1]."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray):
        self.ids = np.unique(np.concatenate([src, dst])) if len(src) else np.zeros(0, np.int64)
        s, d = np.searchsorted(self.ids, src), np.searchsorted(self.ids, dst)
        order = np.lexsort((d, s))
        self.src, self.dst, self.w = s[order].astype(np.int32), d[order].astype(np.int32), w[order].astype(np.float64)
        self.n = len(self.ids)
        self.starts = np.searchsorted(self.src, np.arange(self.n + 1))
        self.deg = np.bincount(self.src, self.w, self.n)
        self.p = self.w / np.where(self.deg > 0, self.deg, 1)[self.src] if self.n else self.w
        self.m = (len(src) + int((src == dst).sum())) / 2
        into = np.argsort(self.dst, kind="stable")
        self._from, self._by, ends = self.src[into], self.p[into], self.dst[into]
        self._into = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]]) if len(ends) else np.zeros(0, np.int64)
        self._ends = ends[self._into]
        self._leave = np.flatnonzero(np.r_[True, self.src[1:] != self.src[:-1]]) if len(ends) else np.zeros(0, np.int64)

    def index(self, nodes) -> np.ndarray:
        """Places of nodes; -1 for nodes without arcs."""
        return places(self.ids, 0, None, np.asarray(nodes, np.int64))

    def around(self, nodes) -> "Csr":
        """A graph that holds all that ``nodes`` reach."""
        return self

    def reached(self, mask: np.ndarray) -> np.ndarray:
        """``mask`` and the ends of the arcs that leave it."""
        out = mask.copy()
        out[self.dst[mask[self.src]]] = True
        return out

    def within(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(src, dst, p) of the arcs between nodes of ``mask``."""
        hit = np.flatnonzero(mask[self.src] & mask[self.dst])
        return self.src[hit], self.dst[hit], self.p[hit]

    def vector(self, nodes, values) -> np.ndarray:
        at = self.index(nodes)
        return np.bincount(at[at >= 0], np.asarray(values, float)[at >= 0], self.n) if self.n else np.zeros(0)

    def forward(self, x: np.ndarray) -> np.ndarray:
        """Mass of x moved along one arc each."""
        out = np.zeros(self.n)
        if len(self._into):
            out[self._ends] = np.add.reduceat(x[self._from] * self._by, self._into)
        return out

    def backward(self, x: np.ndarray) -> np.ndarray:
        """At u: the mean of x over the arcs that leave u."""
        out = np.zeros(self.n)
        if len(self._leave):
            out[self.src[self._leave]] = np.add.reduceat(x[self.dst] * self.p, self._leave)
        return out


class Mapped(Csr):
    """The same over the files of ``write``; as both arcs of an edge are there, rows hold what comes in as well."""

    def __init__(self, folder: str):
        ids, starts, dst = (np.load(f"{folder}/{x}.npy", mmap_mode="r") for x in ("ids", "starts", "dst"))
        table = np.load(f"{folder}/table.npy", mmap_mode="r") if os.path.exists(f"{folder}/table.npy") else None
        self._hold(ids, starts, dst, float(np.load(f"{folder}/m.npy")), float(np.load(f"{folder}/w.npy")), table)

    def _hold(self, ids: np.ndarray, starts: np.ndarray, dst: np.ndarray, m: float, w: float, table: np.ndarray | None = None) -> "Mapped":
        self.ids, self.starts, self.dst, self.table, self.n, self.m, self._each = ids, starts, dst, table, len(ids), m, w
        self.count = np.diff(self.starts)
        self.deg = self.count * w
        cuts = np.unique(np.searchsorted(self.starts, np.arange(0, int(self.starts[-1]), PIECE), side="right") - 1)
        self.cuts = np.append(cuts, self.n)
        self._cum = None
        self._parts: list[tuple[np.ndarray, Csr]] = []
        return self

    def index(self, nodes) -> np.ndarray:
        return places(self.ids, int(self.ids[0]), self.table, np.asarray(nodes, np.int64))

    def _rows(self, combine, values: np.ndarray, skip=None) -> np.ndarray:
        """``combine`` of ``values`` over each row's neighbours; rows of pieces that ``skip`` names stay 0."""
        out = np.zeros(self.n, values.dtype)
        for a, b in zip(self.cuts[:-1], self.cuts[1:]):
            if skip is None or not skip(a, b):
                first = self.starts[a]
                out[a:b] = combine.reduceat(values[self.dst[first : self.starts[b]]], self.starts[a:b] - first)
        return out

    def _some(self, nodes: np.ndarray):
        """Their arcs, about ``PIECE`` at a time: (nodes, arcs of each, ends)."""
        upto = np.cumsum(self.count[nodes])
        for part in np.split(nodes, np.unique(np.searchsorted(upto, np.arange(PIECE, int(upto[-1]) if len(upto) else 0, PIECE)))):
            if len(part):
                c = self.count[part]
                yield part, c, self.dst[ranges(self.starts[part], c)]

    def _few(self, nodes: np.ndarray) -> bool:
        """Whether it is less work to follow the arcs of ``nodes`` than to read all rows."""
        return 2 * int(self.count[nodes].sum()) < int(self.starts[-1])

    def forward(self, x: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(x)
        if not self._few(at):
            return self._rows(np.add, x / self.count)
        out = np.zeros(self.n)
        for part, c, ends in self._some(at):
            out += np.bincount(ends, np.repeat(x[part] / c, c), self.n)
        return out

    def backward(self, x: np.ndarray) -> np.ndarray:
        return self._rows(np.add, x) / self.count

    def within(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = []
        for part, c, ends in self._some(np.flatnonzero(mask)):
            hit = mask[ends]
            found.append((np.repeat(part, c)[hit].astype(np.int32), ends[hit]))
        src, dst = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int32) for i in range(2))
        return src, dst, 1 / self.count[src]

    def reached(self, mask: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(mask)
        if self._few(at):
            out = mask.copy()
            for _, _, ends in self._some(at):
                out[ends] = True
            return out
        return mask | self._rows(np.logical_or, mask, lambda a, b: mask[a:b].all())

    def around(self, nodes) -> Csr:
        """The components of ``nodes`` alone in memory, where they have at most ``LIMIT`` arcs, else the whole."""
        at = self.index(nodes)
        at = at[at >= 0]
        for inside, part in self._parts:
            if inside[at].all():
                return part
        now = np.zeros(self.n, bool)
        now[at] = True
        while True:
            size = int(self.count[now].sum())
            new = self.reached(now) if size <= LIMIT else now
            if (new == now).all():
                break
            now = new
        if size > LIMIT:
            self._parts.append((now, self))
            return self
        rows, place = np.flatnonzero(now), np.cumsum(now) - 1
        if len(rows):
            ends = place[self.dst[ranges(self.starts[rows], self.count[rows])]].astype(np.int32)
            part = Mapped.__new__(Mapped)._hold(np.array(self.ids[rows]), np.r_[0, np.cumsum(self.count[rows])], ends, self.m, self._each)
        else:
            part = Csr(*3 * [np.zeros(0, np.int64)])
            part.m = self.m
        self._parts.append((now, part))
        return part


class Shared:
    """The folder of a mapped graph; opened once in a process."""

    _open: dict[str, Mapped] = {}

    def __init__(self, folder: str):
        self.folder = folder

    @property
    def value(self) -> Mapped:
        if self.folder not in self._open:
            while len(self._open) > 1:
                self._open.pop(next(iter(self._open)))
            self._open[self.folder] = Mapped(self.folder)
        return self._open[self.folder]


def _write_ids(path: str, ids: np.ndarray) -> None:
    np.save(f"{path}/ids.npy", ids)
    lowest = int(ids[0])
    if int(ids[-1]) - lowest < 8 * len(ids):
        table = np.full(int(ids[-1]) - lowest + 1, -1, np.int32)
        table[ids - lowest] = np.arange(len(ids))
        np.save(f"{path}/table.npy", table)


def _gathered(batches, most: int):
    """(src, dst) of so many rows at a time."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= most:
            yield tuple(np.concatenate([x.column(i).to_numpy(zero_copy_only=False) for x in held]) for i in range(2))
            held, size = [], 0
    if size:
        yield tuple(np.concatenate([x.column(i).to_numpy(zero_copy_only=False) for x in held]) for i in range(2))


def _deal(path: str, firsts: np.ndarray, both: bool):
    """Places of arcs by the block of their row, blocks from the rows ``firsts`` on; of edges with ``both``, each as two arcs."""

    def deal(batches):
        ids = np.load(f"{path}/ids.npy", mmap_mode="r")
        table = np.load(f"{path}/table.npy", mmap_mode="r") if os.path.exists(f"{path}/table.npy") else None
        kind, lowest = np.int16 if len(firsts) < 1 << 15 else np.int32, int(ids[0])
        block_of = np.repeat(np.arange(len(firsts), dtype=kind), np.diff(np.append(firsts, len(ids))))
        for found in _gathered(batches, PIECE // 2 if both else PIECE):
            s, d = (places(ids, lowest, table, x).astype(np.int32) for x in found)
            if both:
                s, d = np.concatenate([s, d]), np.concatenate([d, s])
            block = block_of[s]
            order = np.argsort(block, kind="stable")
            cuts = np.r_[0, np.cumsum(np.bincount(block, minlength=len(firsts)))]
            s, d = s[order], d[order]
            out = [(k, s[a:b].tobytes(), d[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in out], pa.int32()), pa.array([f[1] for f in out], pa.binary()), pa.array([f[2] for f in out], pa.binary())], ["block", "s", "d"])

    return deal


def _summed(parts) -> tuple[np.ndarray, np.ndarray]:
    """Nodes in order, each once, and their counts; of parts (nodes, counts)."""
    held, size, most = [], 0, 4 * PIECE

    def together():
        node, count = (np.concatenate([h[i] for h in held]) for i in range(2))
        low = int(node.min())
        if int(node.max()) - low < 8 * len(node):
            total = np.bincount(node - low, count).astype(np.int64)
            at = np.flatnonzero(total)
            return at + low, total[at]
        node, place = np.unique(node, return_inverse=True)
        return node, np.bincount(place, count).astype(np.int64)

    for x in parts:
        held.append(x)
        size += len(x[0])
        if size >= most:
            held = [together()]
            size = len(held[0][0])
            most = max(most, 2 * size)
    return together() if size else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def undirected(edges: DataFrame) -> DataFrame:
    """Arcs of edges (src, dst), as ``graph.symmetric`` has them without weights. Beyond ``FEW`` arcs, where tasks can map them, their
    rows, size and degrees are written at once and the table is a plan that only those run who ask for it; else it is settled."""
    edges = weighted(edges).where("src is not null and dst is not null and src <> dst").select("src", "dst")
    if 2 * edges.limit(FEW // 2 + 1).count() > FEW:
        out, found = symmetric(edges), {}
        if (rows := write_edges(edges, found)) is not None:
            known(out).update(found, rows=rows)
            return out
    return settle(symmetric(edges))


def write_edges(edges: DataFrame, found: dict) -> Shared | None:
    """Edges (src, dst), neither null nor loops, as the rows of ``write``; parallel edges become one."""
    spark, folder = edges.sparkSession, mounted(edges.sparkSession)
    if folder is None:
        return None

    def tally(batches):
        """Nodes and the ends of edges that meet them, a row for nodes of 1,024 ids."""
        node, count = _summed((x, np.ones(len(x), np.int8)) for x in map(np.concatenate, _gathered(batches, PIECE // 2)))
        if len(node):
            bucket, at = node >> 10, (node & 1023).astype(np.int16)
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            for some in np.array_split(np.arange(len(cuts) - 1), -(-(len(cuts) - 1) // 10_000)):
                out = [pa.array([x[cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary()) for x in (at, count)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[some]]), *out], ["bucket", "at", "c"])

    def total(batches):
        """All counts of a partition's nodes in a row."""

        def parts():
            for b in batches:
                at, count = (np.frombuffer(b"".join(b.column(i).to_pylist()), t) for i, t in ((1, np.int16), (2, np.int64)))
                ids = np.repeat(b.column(0).to_numpy(), pc.binary_length(b.column(1)).to_numpy() // 2)
                yield (ids << 10) + at, count

        node, count = _summed(parts())
        if len(node):
            held = (node.tobytes(), count.tobytes()) if len(node) <= NODES else (b"", b"")
            yield pa.RecordBatch.from_arrays([pa.array([len(node)]), pa.array([int(count.max())]), *(pa.array([x], pa.binary()) for x in held)], ["n", "most", "node", "c"])

    tallies = edges.mapInArrow(tally, "bucket long, at binary, c binary").repartition("bucket")
    counts = Settled(tallies.mapInArrow(total, "n long, most long, node binary, c binary"))
    n, most = counts.df.agg(F.sum("n"), F.max("most")).first()
    if not n or max(n, most) > NODES:  # the arcs of a row, parallel ones too, meet in a task
        counts.remove()
        return None
    rows = counts.df.select("node", "c").toArrow()
    ids, count = (np.frombuffer(b"".join(rows.column(i).to_pylist()), np.int64) for i in range(2))
    counts.remove()
    order = np.argsort(ids)
    ids, upto = ids[order], np.r_[0, np.cumsum(count[order])]
    path = f"{folder}/rows-{uuid.uuid4().hex}"
    os.makedirs(path)
    _write_ids(path, ids)
    firsts = np.unique(np.searchsorted(upto, np.arange(0, int(upto[-1]), BLOCK), side="right") - 1)
    ends, blocks = np.append(firsts, n), len(firsts)

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        """A block's arcs, each once, and the arcs of its rows in files of its own."""
        s, d = (np.frombuffer(b"".join(part[c]), np.int32) for c in "sd")
        k = int(part["block"].iloc[0])
        key = (s.astype(np.int64) - ends[k]) * n + d
        key.sort()
        key = key[np.r_[True, key[1:] != key[:-1]]]
        row = key // n
        own = uuid.uuid4().hex
        for name, x in (("dst", (key - row * n).astype(np.int32)), ("count", np.bincount(row, minlength=ends[k + 1] - ends[k]))):
            np.save(f"{path}/{own}.npy", x)
            os.replace(f"{path}/{own}.npy", f"{path}/{name}-{k}.npy")  # a task that is run again does the same
        return pd.DataFrame({"read": [len(s)]})

    dealt = edges.mapInArrow(_deal(path, firsts, True), "block int, s binary, d binary")
    if (dealt.groupBy("block").applyInPandas(fill, "read long").agg(F.sum("read")).first()[0] or 0) != int(upto[-1]):
        raise RuntimeError("edges changed while they were written")
    starts = np.r_[0, np.cumsum(np.concatenate([np.load(f"{path}/count-{k}.npy") for k in range(blocks)]))].astype(np.int64)
    for name, x in (("starts", starts), ("w", np.array(1.0)), ("m", np.array(starts[-1] / 2))):
        np.save(f"{path}/{name}.npy", x)
    np.lib.format.open_memmap(f"{path}/dst.npy", "w+", np.int32, (int(starts[-1]),)).flush()

    def place(batches):
        """Blocks moved to their places; degrees."""
        ids, starts = (np.load(f"{path}/{x}.npy", mmap_mode="r") for x in ("ids", "starts"))
        dst = np.load(f"{path}/dst.npy", mmap_mode="r+")
        for b in batches:
            for k in b["id"]:
                dst[starts[ends[k]] : starts[ends[k + 1]]] = np.load(f"{path}/dst-{k}.npy", mmap_mode="r")
                dst.flush()
                yield pd.DataFrame({"node": ids[ends[k] : ends[k + 1]], "wdeg": np.diff(starts[ends[k] : ends[k + 1] + 1]).astype(float)})

    found |= {"degrees": settle(spark.range(0, blocks, 1, blocks).mapInPandas(place, "node long, wdeg double")), "size": (n, int(starts[-1]) // 2)}
    for k in range(blocks):
        os.remove(f"{path}/dst-{k}.npy")
        os.remove(f"{path}/count-{k}.npy")
    return Shared(path)


def write(arcs: DataFrame, found: dict | None = None) -> Shared | None:
    """Arcs (src, dst, w) as rows in files that tasks map: ids, starts and, written by tasks at places that the starts give, dst.
    ``found`` gets the degrees and the size."""
    folder = mounted(arcs.sparkSession)
    if folder is None:
        return None
    one = F.xxhash64("src", "dst"), F.xxhash64("dst", "src")
    rows = settle(arcs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("c"), F.min("w").alias("low"), F.max("w").alias("high"), F.bit_xor(one[0]).alias("to"), F.bit_xor(one[1]).alias("fro"), F.sum((F.col("src") <= F.col("dst")).cast("long")).alias("m")))
    mark = rows.agg(F.min("low"), F.max("high"), F.bit_xor("to"), F.bit_xor("fro"), F.sum("m"), F.count("*")).first()
    if mark[0] is None or mark[0] != mark[1] or mark[0] <= 0 or mark[2] != mark[3] or mark[5] > NODES:
        return None
    table = rows.select("node", "c").toArrow()
    ids, count = (table.column(i).to_numpy() for i in range(2))
    order = np.argsort(ids)
    ids, starts = ids[order], np.r_[0, np.cumsum(count[order])].astype(np.int64)
    path = f"{folder}/rows-{uuid.uuid4().hex}"
    os.makedirs(path)
    for name, x in (("starts", starts), ("w", np.array(mark[0])), ("m", np.array(float(mark[4])))):
        np.save(f"{path}/{name}.npy", x)
    _write_ids(path, ids)
    np.lib.format.open_memmap(f"{path}/dst.npy", "w+", np.int32, (int(starts[-1]),)).flush()
    firsts = np.unique(np.searchsorted(starts, np.arange(0, int(starts[-1]), BLOCK), side="right") - 1)
    n, spots = len(ids), np.append(starts[firsts], starts[-1])

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        s, d = (np.frombuffer(b"".join(part[c]), np.int32) for c in "sd")
        k = int(part["block"].iloc[0])
        key = (s.astype(np.int64) - firsts[k]) * n + d
        key.sort()
        dst = np.load(f"{path}/dst.npy", mmap_mode="r+")
        dst[spots[k] : spots[k + 1]] = (key % n).astype(np.int32)
        dst.flush()
        return pd.DataFrame({"arcs": [len(key)]})

    dealt = arcs.select("src", "dst").mapInArrow(_deal(path, firsts, False), "block int, s binary, d binary")
    if (dealt.groupBy("block").applyInPandas(fill, "arcs long").agg(F.sum("arcs")).first()[0] or 0) != int(spots[-1]):
        raise RuntimeError("arcs changed while they were written")
    if found is not None:
        found |= {"degrees": rows.select("node", (F.col("c") * float(mark[0])).alias("wdeg")), "size": (len(ids), int(mark[4]))}
    return Shared(path)


def compact(arcs: DataFrame, limit: int = LIMIT):
    """The graph as a value that tasks share, made once for a DataFrame; None if it is refused."""
    if ("compact", limit) not in (kept := known(arcs)):
        kept["compact", limit] = _compact(arcs, limit, kept) if "rows" not in kept else kept["rows"] if 2 * kept["size"][1] > limit else _broadcast(arcs.sparkSession, kept["rows"].value)
    return kept["compact", limit]


def _broadcast(spark, g: Mapped):
    """Few mapped rows as a value."""
    return spark.sparkContext.broadcast(Csr(np.repeat(g.ids, g.count), g.ids[g.dst], np.ones(len(g.dst))))


def _compact(arcs: DataFrame, limit: int, found: dict | None = None):
    arcs = arcs.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("w").cast("double").alias("w"))
    if arcs.limit(limit + 1).count() > limit:
        return write(arcs, found)
    rows = arcs.toArrow()
    src, dst, w = (rows.column(i).to_numpy() for i in range(3))
    return arcs.sparkSession.sparkContext.broadcast(Csr(src, dst, w))

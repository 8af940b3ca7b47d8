"""Components, Louvain and Louvain+ over mapped rows: vectors over nodes on the driver, arcs in the tasks.

Every round hands the vectors to tasks through files in the shared folder; each task reads the rows of a block and writes what it
found for them. A coarser level is written as rows again, with weights, by the tasks that sum them up; no arcs are shuffled.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..plans.loop import mounted, settle
from .csr import Shared, ranges
from .walks import _uniform

#: Arcs of a block, of a round that is not worth a job, and that are worked on at once (so many stay in a core's cache).
BLOCK, FEW, PIECE = 4_000_000, 2_000_000, 1 << 16

#: Sums are made in a vector over all keys if there are up to so many keys for each weighted, or unweighted, arc; else by sorting.
DENSE, DENSE_COUNTS = 16, 4

#: Weights of communities that may still join others to all, at which they are merged in order.
MATRIX = 1 << 23


class Level:
    """Rows of a level: ids of nodes, arcs of node i at starts[i] .. starts[i + 1], weights of arcs or one for all."""

    _open: dict[str, "Level"] = {}

    def __init__(self, folder: str):
        self.folder = folder
        self.starts, self.dst, self.w = (np.load(f"{folder}/{x}.npy", mmap_mode="r") for x in ("starts", "dst", "w"))
        self.n, self.count = len(self.starts) - 1, np.diff(self.starts)
        self.deg = np.load(f"{folder}/deg.npy", mmap_mode="r") if self.w.ndim else self.count * float(self.w)

    @classmethod
    def at(cls, folder: str) -> "Level":
        """Opened once in a process."""
        if folder not in cls._open:
            while len(cls._open) > 1:
                cls._open.pop(next(iter(cls._open)))
            cls._open[folder] = cls(folder)
        return cls._open[folder]

    def sums(self, nodes: np.ndarray, group: np.ndarray, comm: np.ndarray, loops: bool = False):
        """(row, to, w) in order: the weight of arcs from the groups of ``nodes`` (numbered in order) to communities; ``comm`` holds
        all nodes' community. An arc from a node to itself counts with ``loops`` alone."""
        c = self.count[nodes]
        take = ranges(self.starts[nodes], c)
        ends = self.dst[take]
        key = np.repeat(group.astype(np.int64) * len(comm), c) + comm[ends]
        keep = None if loops else ends != np.repeat(nodes, c)
        if keep is not None and not keep.all():
            key, take = key[keep], take[keep]
        rows = int(group[-1]) + 1 if len(group) else 0
        return self.added(key, take, rows, len(comm))

    def added(self, key: np.ndarray, take: np.ndarray, rows: int, wide: int):
        """(row, to, w) in order: the sums of the weights, all positive, of the arcs ``take`` by ``key``, which is row * wide + to."""
        cells = rows * wide
        if cells <= (DENSE if self.w.ndim else DENSE_COUNTS) * len(key):
            total = np.bincount(key, self.w[take], cells) if self.w.ndim else np.bincount(key, minlength=cells)
            key = np.flatnonzero(total)
            w = total[key] if self.w.ndim else total[key] * float(self.w)
        elif self.w.ndim:
            order = np.argsort(key, kind="stable")
            key, w = key[order], self.w[take][order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            key, w = key[first], np.add.reduceat(w, first) if len(first) else np.zeros(0)
        else:
            key.sort()
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            key, w = key[first], np.diff(np.r_[first, len(key)]) * float(self.w)
        row = key // wide
        return row, key - row * wide, w


def _best(row: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The first entry of the largest score in each run of ``row``."""
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    top = np.repeat(np.maximum.reduceat(score, first), np.diff(np.r_[first, len(row)]))
    hit = np.flatnonzero(score == top)
    return hit[np.r_[True, row[hit][1:] != row[hit][:-1]]]


def _cuts(arcs: np.ndarray, most: int) -> np.ndarray:
    """Cuts of consecutive groups with so many arcs into parts of about ``most``."""
    before = np.r_[0, np.cumsum(arcs)]
    return np.unique(np.r_[0, np.searchsorted(before[:-1], np.arange(most, before[-1], most)), len(arcs)])


def _over(spark: SparkSession, level: Level, arcs: np.ndarray, vectors: dict, work: Callable) -> list:
    """``work(level, vectors, a, b)`` -> arrays over the groups a .. b, or of what it likes, for blocks of groups with ``arcs`` each."""
    cuts = _cuts(arcs, BLOCK)
    if arcs.sum() <= FEW:
        return [work(level, vectors, 0, len(arcs))]
    folder, home = f"{level.folder}/round-{uuid.uuid4().hex}", level.folder
    os.makedirs(folder)
    for name, x in vectors.items():
        np.save(f"{folder}/{name}.npy", x)
    names = list(vectors)

    def run(batches):
        for b in batches:
            for i in b["id"]:
                level = Level.at(home)
                given = {x: np.load(f"{folder}/{x}.npy", mmap_mode="r") for x in names}
                given = {x: v if v.ndim else v[()] for x, v in given.items()}
                for j, x in enumerate(work(level, given, int(cuts[i]), int(cuts[i + 1]))):
                    np.save(f"{folder}/out-{i}-{j}.npy", x)
                yield pd.DataFrame({"id": [i]})

    blocks = len(cuts) - 1
    spark.range(0, blocks, 1, blocks).mapInPandas(run, "id long").write.format("noop").mode("overwrite").save()
    out = []
    for i in range(blocks):
        found = []
        while os.path.exists(path := f"{folder}/out-{i}-{len(found)}.npy"):
            found.append(np.load(path))
        out.append(found)
    shutil.rmtree(folder)
    return out


def _joined(parts: list, j: int) -> np.ndarray:
    return np.concatenate([p[j] for p in parts])


def _pieces(level: Level, a: int, b: int):
    """Nodes a .. b, about ``PIECE`` arcs at a time."""
    cuts = a + _cuts(level.count[a:b], PIECE)
    return zip(cuts[:-1], cuts[1:])


def components(spark: SparkSession, level: Level) -> np.ndarray:
    """The smallest node that each is connected to."""
    label = np.arange(level.n, dtype=np.int32)

    def low(level, given, a, b):
        return [np.concatenate([np.minimum.reduceat(given["label"][level.dst[level.starts[x] : level.starts[y]]], level.starts[x:y] - level.starts[x]) for x, y in _pieces(level, a, b)])]

    while True:
        least = _joined(_over(spark, level, level.count, {"label": label}, low), 0)
        new = np.minimum(label, least)
        np.minimum.at(new, label, least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def local_moves(spark: SparkSession, level: Level, seed: int, epsilon: float) -> np.ndarray:
    """Communities, named by a node, after synchronous rounds of moves; those of ``cluster.local_moves``."""
    deg = np.asarray(level.deg, float)
    m2 = deg.sum()

    def look(level, given, a, b):
        comm, tot, deg = given["comm"], given["tot"], level.deg
        to, up, inside = np.arange(a, b), np.zeros(b - a), 0.0
        for x, y in _pieces(level, a, b):
            nodes = np.arange(x, y)
            row, c, w = level.sums(nodes, nodes - x, comm)
            own = np.asarray(comm[x:y])
            mine, d = c == own[row], np.asarray(deg[x:y])
            at_home = np.bincount(row[mine], w[mine], y - x)
            inside += at_home.sum()
            stay = at_home - (tot[own] - d) * d / m2
            if len(row):
                gain = w - (tot[c] - np.where(mine, d[row], 0.0)) * d[row] / m2
                best = _best(row, gain)
                rise = gain[best] - stay[row[best]]
                up[row[best] + x - a] = np.where(rise > 1e-15, rise, 0.0)
                to[row[best] + x - a] = c[best]
        return [to.astype(np.int32), up, np.array([inside])]

    loops = _loops(spark, level)

    def seen(comm):
        tot = np.bincount(comm, deg, level.n)
        parts = _over(spark, level, level.count, {"comm": comm, "tot": tot}, look)
        return (_joined(parts, 2).sum() + loops) / m2 - ((tot / m2) ** 2).sum(), _joined(parts, 0), _joined(parts, 1)

    now, place = np.arange(level.n, dtype=np.int32), np.arange(level.n)
    quality, to, up = seen(now)
    share, i = 0.5, 0
    while 2 * up.sum() / m2 > epsilon:
        drawn = (up > 0) & (_uniform(place, np.zeros(level.n, np.int64), i, seed) < share)
        new = np.where(drawn, to, now).astype(np.int32)
        better, *wanted = seen(new)
        if better > quality:
            now, quality, (to, up), share = new, better, wanted, min(0.5, 2 * share)
        else:  # as in cluster.local_moves
            share = max(share / 2, 1e-9) if better < quality else min(0.5, 2 * share)
        i += 1
    return now


def _loops(spark: SparkSession, level: Level) -> float:
    """The weight of arcs from a node to itself."""

    def found(level, given, a, b):
        total = 0.0
        for x, y in _pieces(level, a, b):
            ends = level.dst[level.starts[x] : level.starts[y]]
            same = ends == np.repeat(np.arange(x, y), level.count[x:y])
            total += float(level.w[level.starts[x] : level.starts[y]][same].sum()) if level.w.ndim else same.sum() * float(level.w)
        return [np.array([total])]

    return float(_joined(_over(spark, level, level.count, {}, found), 0).sum())


def merged(spark: SparkSession, level: Level, active: np.ndarray, k: int, seed: int, hard_cap: bool) -> np.ndarray:
    """Size-bounded communities, named by a node, of the nodes of ``active`` (whole components); the proposals and limits of
    ``cluster.size_bounded_level``. In a round a community that none would join moves, one that such a community would join stays, and
    a coin decides for the others. Those that fit with none propose to any of the smallest neighbours, and a community takes one of them,
    or up to a third of k nodes, so that they spread. What is left of at most ``MATRIX`` weights is merged in order."""
    comm = np.arange(level.n, dtype=np.int32)
    size, deg = np.zeros(level.n, np.int64), np.array(level.deg, float)
    size[active] = 1
    m2, last = deg[active].sum(), 0
    kind = np.uint8 if k < 255 else np.int64

    def propose(level, given, a, b):
        """Communities are numbered in the order of their names here, without those that are gone."""
        comm, full, size, deg, nodes, first = (given[x] for x in ("comm", "full", "size", "deg", "nodes", "first"))
        found, none, turn = [], np.iinfo(np.int64).max, given["turn"]
        cuts = a + _cuts(given["arcs"][a:b], PIECE)
        for x, y in zip(cuts[:-1], cuts[1:]):
            at = first[x : y + 1] - first[x]
            part = np.asarray(nodes[first[x] : first[y]])
            own, c = comm[part[at[:-1]]], level.count[part]
            pull = deg[own] / m2
            take = ranges(level.starts[part], c)
            ends, arcs = level.dst[take], np.add.reduceat(c, at[:-1])
            group = np.repeat(np.arange(y - x), arcs)
            # arcs to communities that are too large to join are left out before anything is summed up
            hit = np.flatnonzero(full[ends] <= np.repeat((k - size[own]).astype(kind), arcs))
            to, row = comm[ends[hit]], group[hit]
            other = to != own[row]
            row, to, w = level.added(row[other] * len(size) + to[other], take[hit[other]], y - x, len(size))
            alone = np.ones(y - x, bool)
            alone[row] = False
            if len(row):
                best = _best(row, w - deg[to] * pull[row])
                found.append((own[row[best]], to[best], np.ones(len(best), bool)))
            if not hard_cap and alone.any():  # the smallest neighbour instead; of equal ones any
                mine = alone[group]
                to, row = comm[ends[mine]], group[mine]
                drawn = (to.astype(np.uint32) * np.uint32(0x9E3779B1)) ^ (own[row].astype(np.uint32) * np.uint32(0x85EBCA77) + turn)
                drawn = (drawn ^ (drawn >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                key = np.where(to != own[row], (size[to] << 32) | (drawn ^ (drawn >> np.uint32(12))), none)
                best = _best(row, -key)
                best = best[key[best] < none]
                found.append((own[row[best]], to[best], np.zeros(len(best), bool)))
        out = [np.concatenate([f[j] for f in found]) if found else np.zeros(0, t) for j, t in enumerate((np.int64, np.int64, bool))]
        order = np.argsort(out[0], kind="stable")
        return [x[order] for x in out]

    def weights(level, given, a, b):
        """(group, to, w) of all arcs."""
        comm, nodes, first, wide = (given[x] for x in ("comm", "nodes", "first", "wide"))
        found = []
        cuts = a + _cuts(given["arcs"][a:b], PIECE)
        for x, y in zip(cuts[:-1], cuts[1:]):
            part = np.asarray(nodes[first[x] : first[y]])
            c = level.count[part]
            take = ranges(level.starts[part], c)
            group = np.repeat(np.arange(y - x), np.add.reduceat(c, first[x:y] - first[x]))
            row, to, w = level.added(group * wide + comm[level.dst[take]], take, y - x, wide)
            found.append((row + x, to, w))
        return [np.concatenate([f[j] for f in found]) for j in range(3)]

    place, none = np.arange(level.n), np.zeros(level.n, np.int64)
    while True:
        active = active[size[comm[active]] < k]  # what has k nodes once keeps them
        if not len(active):
            return comm
        owner = (comm[active].astype(np.int64) << 32) | active
        owner.sort()
        nodes = owner & 0xFFFFFFFF
        owner >>= 32
        first = np.r_[np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]), len(nodes)]
        arcs = np.add.reduceat(level.count[nodes], first[:-1])
        live = np.flatnonzero(size)
        number = np.cumsum(size > 0, dtype=np.int32) - np.int32(1)
        here = number[comm]
        if (len(first) - 1) * len(live) <= MATRIX:
            parts = _over(spark, level, arcs, {"comm": here, "nodes": nodes, "first": first, "arcs": arcs, "wide": np.int64(len(live))}, weights)
            table = np.zeros((len(first) - 1, len(live)))
            for row, to, w in parts:
                table[row, to] = w
            place[live] = live[_in_order(table, number[owner[first[:-1]]], size[live], deg[live], m2, k, seed, hard_cap)]
            return place[comm].astype(np.int32)
        full = np.minimum(size[live], k).astype(kind)[here]
        parts = _over(spark, level, arcs, {"comm": here, "full": full, "turn": np.uint32(last), "size": size[live], "deg": deg[live], "nodes": nodes, "first": first, "arcs": arcs}, propose)
        src, dst, fits = (_joined(parts, j) for j in range(3))
        if not len(src):
            return comm
        src, dst = live[src], live[dst]
        leaf, stays, goes = np.ones(level.n, bool), np.zeros(level.n, bool), np.zeros(level.n, bool)
        leaf[dst] = False
        leaf = leaf[src]
        stays[dst[leaf]] = True
        pairs = False
        while not pairs:  # nothing changes in a round of coins that joins none
            heads = _uniform(src, none[: len(src)], 2 * last, seed) < 0.5
            heads[leaf] = True
            heads[stays[src]] = False
            goes[:] = False
            goes[src[heads]] = True
            moving = heads & ~goes[dst]
            s, d, f = src[moving], dst[moving], fits[moving]
            order = np.lexsort((s, _uniform(s, none[: len(s)], 2 * last + 1, seed), ~f, d))
            s, d, f = s[order], d[order], f[order]
            taken = np.cumsum(size[s])
            head = np.r_[True, d[1:] != d[:-1]] if len(d) else np.zeros(0, bool)
            begin = np.maximum.accumulate(np.where(head, np.arange(len(d)), 0)) if len(d) else np.zeros(0, np.int64)
            so_far = taken - (taken - size[s])[begin]
            go = np.where(f, size[d] + so_far <= k, head | (so_far <= k // 3))
            s, d, last = s[go], d[go], last + 1
            pairs = len(s) > 0
        name = place.astype(np.int32)
        name[s] = d
        comm = name[comm]
        np.add.at(size, d, size[s])
        np.add.at(deg, d, deg[s])
        size[s], deg[s] = 0, 0.0


def _in_order(table: np.ndarray, own: np.ndarray, size: np.ndarray, deg: np.ndarray, m2: float, k: int, seed: int, hard_cap: bool) -> np.ndarray:
    """``cluster._merge_in_order`` over the weights from the communities ``own``, one row each, to all; the community that each is in."""
    owner, row = np.arange(len(size)), np.full(len(size), -1)
    row[own] = np.arange(len(own))
    queue = deque(own[np.random.default_rng(seed).permutation(len(own))].tolist())
    while queue:
        v = queue.popleft()
        if owner[v] != v or size[v] >= k:
            continue
        w = table[row[v]]
        near = w > 0
        near[v] = False
        fit = np.flatnonzero(near & (size + size[v] <= k))
        if len(fit):
            t = int(fit[np.argmax(w[fit] - deg[fit] * deg[v] / m2)])
        elif not hard_cap and near.any():
            fit = np.flatnonzero(near)
            t = int(fit[np.argmin(size[fit])])
        else:
            continue
        a, b = (t, v) if row[t] < 0 or np.count_nonzero(table[row[t]]) >= np.count_nonzero(w) else (v, t)
        if row[a] >= 0:
            table[row[a]] += table[row[b]]
        table[:, a] += table[:, b]
        table[:, b] = 0
        owner[b], size[a], deg[a] = a, size[a] + size[b], deg[a] + deg[b]
        if size[a] < k:
            queue.append(a)
    while (owner[owner] != owner).any():
        owner = owner[owner]
    return owner


def coarse(spark: SparkSession, level: Level, comm: np.ndarray, groups: int) -> Level:
    """Rows between communities 0 .. ``groups``, weights summed up; nodes of community -1 are left out (whole components)."""
    at = np.flatnonzero(comm >= 0)
    nodes = at[np.argsort(comm[at], kind="stable")]
    first = np.searchsorted(comm[nodes], np.arange(groups + 1))
    arcs = np.add.reduceat(level.count[nodes], first[:-1])
    folder = f"{os.path.dirname(level.folder)}/rows-{uuid.uuid4().hex}"
    os.makedirs(folder)

    def add(level, given, a, b):
        comm, nodes, first = (given[x] for x in ("comm", "nodes", "first"))
        count, deg, ends, weights = np.zeros(b - a, np.int64), np.zeros(b - a), [], []
        cuts = a + _cuts(given["arcs"][a:b], PIECE)
        for x, y in zip(cuts[:-1], cuts[1:]):
            part = np.asarray(nodes[first[x] : first[y]])
            row, to, w = level.sums(part, np.repeat(np.arange(y - x), np.diff(first[x : y + 1])), comm, loops=True)
            count[x - a : y - a], deg[x - a : y - a] = np.bincount(row, minlength=y - x), np.bincount(row, w, y - x)
            ends.append(to.astype(np.int32))
            weights.append(w)
        name = f"{folder}/part-{a}"
        np.save(f"{name}-dst.npy", np.concatenate(ends))
        np.save(f"{name}-w.npy", np.concatenate(weights))
        return [count, deg, np.array([a])]

    parts = _over(spark, level, arcs, {"comm": comm, "nodes": nodes, "first": first, "arcs": arcs}, add)
    starts = np.r_[0, np.cumsum(_joined(parts, 0))].astype(np.int64)
    np.save(f"{folder}/starts.npy", starts)
    np.save(f"{folder}/deg.npy", _joined(parts, 1))
    for name, kind in (("dst", np.int32), ("w", np.float64)):
        whole, done = np.lib.format.open_memmap(f"{folder}/{name}.npy", "w+", kind, (int(starts[-1]),)), 0
        for p in parts:
            path = f"{folder}/part-{int(p[2][0])}-{name}.npy"
            part = np.load(path, mmap_mode="r")
            whole[done : done + len(part)] = part
            done += len(part)
            os.remove(path)
        whole.flush()
    return Level(folder)


def alone(spark: SparkSession, level: Level, work: Callable) -> np.ndarray:
    """``work(src, dst, w)`` -> (ids, communities as places) of a small level, in one task."""
    folder, out = level.folder, f"{level.folder}/alone-{uuid.uuid4().hex}.npy"

    def run(batches):
        for b in batches:
            if len(b):
                g = Level.at(folder)
                w = np.asarray(g.w) if g.w.ndim else np.full(len(g.dst), float(g.w))
                np.save(out, work(np.repeat(np.arange(g.n), g.count), np.asarray(g.dst).astype(np.int64), w)[1])
            yield pd.DataFrame({"id": b["id"]})

    spark.range(0, 1, 1, 1).mapInPandas(run, "id long").write.format("noop").mode("overwrite").save()
    return np.load(out)


def table(spark: SparkSession, folder: str, columns: dict, schema: str) -> DataFrame:
    """Vectors (and numbers, for all rows) as a table that tasks write."""
    n = max(len(x) for x in columns.values() if np.ndim(x))
    made = f"{folder}/table-{uuid.uuid4().hex}"
    os.makedirs(made)
    for name, x in columns.items():
        np.save(f"{made}/{name}.npy", x)
    names, step = list(columns), 500_000

    def run(batches):
        for b in batches:
            for i in b["id"]:
                given = {x: np.load(f"{made}/{x}.npy", mmap_mode="r") for x in names}
                yield pd.DataFrame({x: np.asarray(v[i * step : (i + 1) * step]) if v.ndim else np.full(min(step, n - i * step), v) for x, v in given.items()})

    blocks = -(-n // step)
    out = settle(spark.range(0, blocks, 1, max(blocks, 1)).mapInPandas(run, schema))
    shutil.rmtree(made)
    return out


def opened(shared: Shared) -> Level:
    return Level(shared.folder)

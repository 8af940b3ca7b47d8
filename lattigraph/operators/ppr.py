"""Personalised PageRank by power steps, and what derives from it.

``seeds`` (source, node, value) hold the start mass of every source: unit mass for PPR, the degree for the degree-weighted
form (DPPR), degree over size for each leaf of a supernode. All sources advance together. ``engine``: "csr" runs
each source in a task over a broadcast graph of a checked size, "join" runs joins and aggregations round by round,
"auto" takes the first where the graph is small enough.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.loop import Settled, settle
from . import graph
from .blocks import lay
from .csr import LIMIT, NODES, Mapped, compact

ALPHA = 0.2

#: In joins: sources side by side in a row, and nodes that are looked up in every task.
WIDE, NEAR = 16, 100_000


def unit_seeds(sources: DataFrame) -> DataFrame:
    """A unit of mass at each source (node)."""
    return sources.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("value"))


def degree_seeds(a: DataFrame, sources: DataFrame | None = None, plus: float = 0.0) -> DataFrame:
    """Mass deg + ``plus`` at each source; all nodes without ``sources``."""
    deg = graph.weighted_degree(a)
    deg = deg if sources is None else deg.join(sources.select("node").distinct(), "node", "left_semi")
    return deg.select(F.col("node").alias("source"), "node", (F.col("wdeg") + plus).alias("value"))


def super_seeds(a: DataFrame, membership: DataFrame) -> DataFrame:
    """deg / size mass at each leaf, keyed by its supernode ``comm``: by linearity one source stands for all leaves."""
    sizes = membership.groupBy("comm").agg(F.count("*").alias("size"))
    leaves = membership.join(sizes, "comm").join(graph.weighted_degree(a), "node")
    return leaves.select(F.col("comm").alias("source"), "node", (F.col("wdeg") / F.col("size")).alias("value"))


def per_source(seeds: DataFrame, csr, work, columns: tuple[str, ...], members=None) -> DataFrame:
    """Run ``work(csr, start vector)`` -> arrays over nodes for each source; rows with any value not 0. ``members`` (a broadcast of
    nodes in order and their community): rows hold the sums over communities instead of nodes."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        g = csr.value.around(rows["node"])
        parts = work(g, g.vector(rows["node"], rows["value"]))
        if members is not None:
            node, comm = members.value
            at = g.index(node)
            ids, place = np.unique(comm[at >= 0], return_inverse=True)
            sums = [np.bincount(place, p[at[at >= 0]], len(ids)) for p in parts]
            hit = np.flatnonzero(np.any([p != 0 for p in sums], axis=0)) if len(ids) else np.zeros(0, int)
            return pd.DataFrame({"source": np.full(len(hit), rows["source"].iloc[0]), "node": ids[hit], **{c: p[hit] for c, p in zip(columns, sums)}})
        hit = np.flatnonzero(np.any([p != 0 for p in parts], axis=0)) if g.n else np.zeros(0, int)
        return pd.DataFrame({"source": np.full(len(hit), rows["source"].iloc[0]), "node": g.ids[hit] if g.n else hit, **{c: p[hit] for c, p in zip(columns, parts)}})

    schema = "source long, node long, " + ", ".join(f"{c} double" for c in columns)
    seeds = seeds.select(F.col("source").cast("long"), F.col("node").cast("long"), F.col("value").cast("double"))
    # seeds are small and the work on each source is not: keep them from being gathered in a few tasks
    return seeds.repartition(spread(seeds), "source").groupBy("source").applyInPandas(run, schema)


def spread(df: DataFrame) -> int:
    """Partitions for rows that each stand for much work."""
    return 3 * df.sparkSession.sparkContext.defaultParallelism


def truncated(a: DataFrame, seeds: DataFrame, steps: int = 15, alpha: float = ALPHA, engine: str = "auto", membership: DataFrame | None = None, tolerance: float | None = None) -> DataFrame:
    """(source, node, value): alpha * sum over i = 0 .. steps of (1 - alpha)^i P^i applied to the seeds. With a ``membership``
    (node, comm) summed over supernodes, which stand in for the node; nodes of none are dropped. With a ``tolerance`` of the unsettled mass, mapped rows may reach it sooner."""
    csr = compact(a) if engine in ("auto", "csr") else None

    def sums(g, x):
        if tolerance is not None and isinstance(g, Mapped):
            return [alpha * solved(g, x, tolerance, steps, alpha)]
        total = x.copy()
        for _ in range(steps):
            x = (1 - alpha) * g.forward(x)
            total += x
        return [alpha * total]

    if csr is not None:
        members = None if membership is None else _members(membership)
        values = per_source(seeds, csr, sums, ("value",), members)
        return values if membership is None or members is not None else _summed(values, membership)
    values = _joined(a, seeds, steps, alpha)
    return values if membership is None else _summed(values, membership)


def _joined(a: DataFrame, seeds: DataFrame, steps: int, alpha: float) -> DataFrame:
    """(source, node, value) by joins: ``WIDE`` sources stand side by side in a row of a node, so that an arc is joined once for all of
    them. In each step mass moves along the arcs and the seeds are added again, which leaves the sum over steps. Beyond ``LIMIT`` arcs
    the rows would be more than disks hold: ``blocks`` lays the same join out in files, where these can be mapped."""
    own = settle(seeds.select(F.col("source").cast("long"), F.col("node").cast("long"), "value").groupBy("source", "node").agg(F.sum("value").alias("value")))
    a = _leaving(a, own, steps)
    if a.limit(LIMIT + 1).count() > LIMIT and (laid := lay(a, own)) is not None:
        return laid.sums(own, steps, alpha)
    p = settle(graph.row_normalised(a).select("src", "dst", ((1 - alpha) * F.col("p")).alias("p")).repartition("src"))
    named = graph.dense_ids(own, "source")
    sources = max(named.count(), 1)
    width = -(-sources // -(-sources // WIDE))
    named = settle(named.select("source", F.floor(F.col("new") / width).alias("part"), (F.col("new") % width).cast("int").alias("slot")))
    slots = [f"v{i}" for i in range(width)]
    start = settle(own.join(named, "source").groupBy("part", "node").agg(*(F.sum(F.when(F.col("slot") == i, F.col("value")).otherwise(0.0)).alias(v) for i, v in enumerate(slots))))
    state = Settled(start)
    for _ in range(steps):
        moved = state.df.join(p, F.col("node") == F.col("src")).select("part", F.col("dst").alias("node"), *((F.col(v) * F.col("p")).alias(v) for v in slots))
        new = Settled(start.unionByName(moved).groupBy("part", "node").agg(*(F.sum(v).alias(v) for v in slots)))
        state.remove()
        state = new
    each = state.df.select("part", "node", F.posexplode(F.array(*slots)).alias("slot", "value")).where("value <> 0")
    return each.join(named, ["part", "slot"]).select("source", "node", (alpha * F.col("value")).alias("value"))


def _leaving(a: DataFrame, own: DataFrame, steps: int) -> DataFrame:
    """The arcs that leave what ``own`` (node) reaches in fewer than ``steps`` steps, where these are up to ``NEAR`` nodes of a large graph; else all."""
    if a.limit(LIMIT + 1).count() <= LIMIT:
        return a
    near, size = Settled(own.select("node").distinct()), 0
    for _ in range(steps):
        before, size = size, near.df.limit(NEAR + 1).count()
        if size > NEAR or size == before:
            break
        leave = a.join(F.broadcast(near.df), F.col("src") == F.col("node"), "left_semi")
        new = Settled(near.df.unionByName(leave.select(F.col("dst").alias("node"))).distinct())
        near.remove()
        near = new
    else:
        size = near.df.limit(NEAR + 1).count()
    return a if size > NEAR else settle(a.join(F.broadcast(near.df), F.col("src") == F.col("node"), "left_semi"))


def _members(membership: DataFrame):
    """Nodes and communities as a broadcast value; None if they are more than a mapped graph's nodes."""
    rows = membership.select(F.col("node").cast("long"), F.col("comm").cast("long"))
    if rows.limit(NODES + 1).count() > NODES:
        return None
    table = rows.toArrow()
    return membership.sparkSession.sparkContext.broadcast(tuple(table.column(i).to_numpy() for i in range(2)))


def _summed(values: DataFrame, membership: DataFrame) -> DataFrame:
    return values.join(membership, "node").groupBy("source", F.col("comm").alias("node")).agg(F.sum("value").alias("value"))


def steps_for(tolerance: float, mass: float = 1.0, alpha: float = ALPHA) -> int:
    """Power steps after which at most ``tolerance`` of ``mass`` has not settled."""
    return max(0, math.ceil(math.log(tolerance / max(mass, tolerance)) / math.log(1 - alpha)))


def exact(a: DataFrame, seeds: DataFrame, tolerance: float = 1e-9, alpha: float = ALPHA, engine: str = "auto", membership: DataFrame | None = None) -> DataFrame:
    """Power iteration until at most ``tolerance`` of each source's mass is unsettled."""
    mass = seeds.groupBy("source").agg(F.sum("value").alias("m")).agg(F.max("m")).first()[0] or 1.0
    return truncated(a, seeds, steps_for(tolerance, mass, alpha), alpha, engine, membership, tolerance)


def solved(g: Mapped, x: np.ndarray, tolerance: float, steps: int, alpha: float = ALPHA) -> np.ndarray:
    """The sum of (1 - alpha)^i P^i x but for an unsettled mass of at most ``tolerance``, by conjugate gradients: mapped rows are
    symmetric, so P is self-adjoint where products are divided by degrees. Power steps go on from there while the unsettled mass is
    over the tolerance or more nodes are reached, at most ``steps``."""
    total, left = np.zeros(g.n), x.copy()
    way, square = left.copy(), float((left * left / g.deg).sum())
    for _ in range(steps):
        if np.abs(left).sum() <= tolerance / 2:
            break
        ahead = way - (1 - alpha) * g.forward(way)
        size = square / float((way * ahead / g.deg).sum())
        total += size * way
        left -= size * ahead
        square, before = float((left * left / g.deg).sum()), square
        way = left + square / before * way
    left = x - total + (1 - alpha) * g.forward(total)  # as it is, without the errors of the updates
    for _ in range(steps):
        wider = bool((left[total == 0] != 0).any())
        if np.abs(left).sum() <= tolerance and not wider:
            break
        total += left
        left = (1 - alpha) * g.forward(left)
    return np.abs(total)  # values are not negative: their size is as near


def dppr(a: DataFrame, sources: DataFrame | None = None, tolerance: float = 1e-9, alpha: float = ALPHA, engine: str = "auto", targets: DataFrame | None = None) -> DataFrame:
    """deg(s) * pi(s, t); rows of ``targets`` (node) alone if given."""
    out = exact(a, degree_seeds(a, sources), tolerance, alpha, engine)
    return out if targets is None else out.join(targets.select("node").distinct(), "node", "left_semi").select("source", "node", "value")


def super_dppr(a: DataFrame, membership: DataFrame, tolerance: float = 1e-9, alpha: float = ALPHA, engine: str = "auto") -> DataFrame:
    """(source, target, value): the mean DPPR over the leaf pairs of two supernodes; membership(node, comm)."""
    return mean_of_leaves(exact(a, super_seeds(a, membership), tolerance, alpha, engine, membership), membership)


def super_truncated(a: DataFrame, membership: DataFrame, steps: int = 15, alpha: float = ALPHA, engine: str = "auto") -> DataFrame:
    """The same after ``steps``."""
    return mean_of_leaves(truncated(a, super_seeds(a, membership), steps, alpha, engine, membership), membership)


def to_supernodes(values: DataFrame, membership: DataFrame) -> DataFrame:
    """Values summed over a target's leaves and divided by their number; nodes of no supernode are dropped."""
    return mean_of_leaves(_summed(values, membership), membership)


def mean_of_leaves(sums: DataFrame, membership: DataFrame) -> DataFrame:
    """(source, target, value): sums over supernodes (source, node, value) divided by the number of leaves."""
    sizes = membership.groupBy("comm").agg(F.count("*").alias("size"))
    return sums.join(sizes, F.col("node") == F.col("comm")).select("source", F.col("comm").alias("target"), (F.col("value") / F.col("size")).alias("value"))


def dnpr(a: DataFrame, steps: int = 20, alpha: float = ALPHA, engine: str = "auto") -> DataFrame:
    """(node, dnpr): the mean PPR from a source drawn by degree, over ``steps`` terms."""
    total = a.agg(F.sum("w")).first()[0] or 1.0
    start = graph.weighted_degree(a).select(F.lit(0).cast("long").alias("source"), "node", (F.col("wdeg") / total).alias("value"))
    return truncated(a, start, steps - 1, alpha, engine).select("node", F.col("value").alias("dnpr"))


def dnpr_closed(a: DataFrame, steps: int = 20, alpha: float = ALPHA) -> DataFrame:
    """The same in closed form: degrees are stationary, so dnpr = deg / 2m * (1 - (1 - alpha)^steps)."""
    deg = graph.weighted_degree(a)
    total = deg.agg(F.sum("wdeg").alias("total"))
    return deg.join(F.broadcast(total)).select("node", (F.col("wdeg") / F.col("total") * (1 - (1 - alpha) ** steps)).alias("dnpr"))


def symmetrised(values: DataFrame) -> DataFrame:
    """(i, j, value): value(i, j) + value(j, i)."""
    v = values.select(F.col("source").alias("i"), F.col("node").alias("j"), "value")
    return v.unionByName(v.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")).groupBy("i", "j").agg(F.sum("value").alias("value"))


def simrank(a: DataFrame, steps: int = 5, decay: float = 0.9) -> DataFrame:
    """(i, j, value) after ``steps`` of SimRank: decay times the mean over neighbour pairs; 1 for a node with itself."""
    p = settle(graph.row_normalised(a))
    same = graph.nodes(a).select(F.col("node").alias("i"), F.col("node").alias("j"), F.lit(1.0).alias("value"))
    now = Settled(same)
    for _ in range(steps):
        half = now.df.join(p, F.col("i") == F.col("dst")).groupBy(F.col("src").alias("i"), "j").agg(F.sum(F.col("p") * F.col("value")).alias("value"))
        full = half.join(p, F.col("j") == F.col("dst")).groupBy("i", F.col("src").alias("j")).agg((decay * F.sum(F.col("p") * F.col("value"))).alias("value"))
        new = Settled(full.where("i <> j").unionByName(same))
        now.remove()
        now = new
    return now.df

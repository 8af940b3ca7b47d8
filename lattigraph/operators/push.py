"""Local push: reserves and residues from sources (forward) or targets (backward).

All nodes over the threshold are pushed at once in a round. For a source s and threshold rmax the forward reserve
satisfies 0 <= deg(s) pi(s, t) - reserve(t) <= rmax * deg(t); reserves and residues always sum to the start mass. The backward
reserve satisfies 0 <= pi(s, t) - reserve(s) <= rmax.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.loop import Settled, settle
from . import graph
from .csr import Csr, compact
from .ppr import ALPHA, per_source


def push_vector(g: Csr, residue: np.ndarray, rmax: float, alpha: float = ALPHA, rounds: int | None = None, backward: bool = False, reserve: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(reserve, residue) of one source or target. The first round pushes whatever holds mass."""
    residue = residue.copy()
    reserve = np.zeros(g.n) if reserve is None else reserve.copy()
    active, done = residue > 0, 0
    while active.any() and (rounds is None or done < rounds):
        moved = np.where(active, residue, 0.0)
        reserve += alpha * moved
        residue = np.where(active, 0.0, residue) + (1 - alpha) * (g.backward(moved) if backward else g.forward(moved))
        active = residue > rmax * (1.0 if backward else g.deg)
        done += 1
    return reserve, residue


def push(a: DataFrame, seeds: DataFrame, rmax: float, alpha: float = ALPHA, rounds: int | None = None, backward: bool = False, engine: str = "auto") -> DataFrame:
    """(source, node, reserve, residue); with ``rounds`` at most so many, else until no residue is over the threshold."""
    csr = compact(a) if engine in ("auto", "csr") else None
    if csr is not None:
        return per_source(seeds, csr, lambda g, x: push_vector(g, x, rmax, alpha, rounds, backward), ("reserve", "residue"))
    state = seeds.groupBy("source", "node").agg(F.sum("value").alias("residue")).select("source", "node", F.lit(0.0).alias("reserve"), "residue")
    return push_state(a, state, rmax, alpha, rounds, backward)


def push_state(a: DataFrame, state: DataFrame, rmax, alpha: float = ALPHA, rounds: int | None = None, backward: bool = False, first: bool = True, among: DataFrame | None = None) -> DataFrame:
    """Push on from a state (source, node, reserve, residue) by joins and aggregations. ``rmax``: a number, or a threshold for
    each source (source, rmax). ``first``: the first round pushes whatever holds mass. ``among`` (source, node): what may be pushed."""
    p = graph.row_normalised(a)
    arcs = p.select(F.col("src").alias("at"), F.col("dst").alias("to"), "p") if not backward else p.select(F.col("dst").alias("at"), F.col("src").alias("to"), "p")
    arcs = settle(arcs.repartition("at"))
    deg = settle(graph.weighted_degree(a))
    if among is not None:
        among = settle(among.select("source", "node").distinct().withColumn("may", F.lit(True)))

    def marked(df: DataFrame, whatever: bool) -> DataFrame:
        df = df.join(deg, "node")
        df = df.join(rmax, "source") if isinstance(rmax, DataFrame) else df.withColumn("rmax", F.lit(float(rmax)))
        hot = F.col("residue") > (F.lit(0.0) if whatever else F.col("rmax") if backward else F.col("rmax") * F.col("wdeg"))
        if among is not None:
            df = df.join(among, ["source", "node"], "left")
            hot = hot & F.coalesce("may", F.lit(False))
        return df.select("source", "node", "reserve", "residue", hot.alias("hot"))

    now, done = Settled(marked(state, first)), 0
    while (rounds is None or done < rounds) and now.df.where("hot").head(1):
        moved = now.df.where("hot").join(arcs, F.col("node") == F.col("at")).select("source", F.col("to").alias("node"), F.lit(0.0).alias("reserve"), ((1 - alpha) * F.col("residue") * F.col("p")).alias("residue"))
        held = now.df.select("source", "node", F.when(F.col("hot"), F.col("reserve") + alpha * F.col("residue")).otherwise(F.col("reserve")).alias("reserve"), F.when(F.col("hot"), 0.0).otherwise(F.col("residue")).alias("residue"))
        new = Settled(marked(held.unionByName(moved).groupBy("source", "node").agg(F.sum("reserve").alias("reserve"), F.sum("residue").alias("residue")), False))
        now.remove()
        now, done = new, done + 1
    return now.df.select("source", "node", "reserve", "residue").where("reserve <> 0 or residue <> 0")


def accumulated_state(a: DataFrame, leaves: DataFrame, alpha: float = ALPHA, hops: int = 2, tiny: float = 1e-14) -> DataFrame:
    """``accumulated_residue`` of a unit of mass at each of ``leaves`` (node), by joins: (source, node, reserve, residue)."""
    own = leaves.select(F.col("node").alias("source"), "node").distinct()
    ball = own
    for _ in range(hops):
        ball = settle(ball.unionByName(ball.join(a.select(F.col("src").alias("node"), "dst"), "node").select("source", F.col("dst").alias("node"))).distinct())
    once = push_state(a, own.select("source", "node", F.lit(0.0).alias("reserve"), F.lit(1.0).alias("residue")), 0.0, alpha, rounds=1)
    state = settle(push_state(a, once, tiny, alpha, first=False, among=ball.where("source <> node")))
    home = state.where("source = node").select("source", F.col("residue").alias("back")).join(graph.weighted_degree(a).withColumnRenamed("node", "source"), "source")
    share = F.when((F.col("back") > 0) & (F.col("back") < 1), F.col("back"))
    times = F.when(share.isNotNull(), F.greatest(F.lit(1.0), F.ceil(F.log(tiny * F.greatest("wdeg", F.lit(1.0))) / F.log(share)))).otherwise(F.lit(1.0))
    home = home.select("source", F.coalesce((1 - F.pow(share, times)) / (1 - share), F.lit(1.0)).alias("scale"), F.when(F.col("back") > 0, F.pow("back", times)).otherwise(F.col("back")).alias("left"))
    out = state.join(home, "source", "left").withColumn("scale", F.coalesce("scale", F.lit(1.0)))
    return out.select("source", "node", (F.col("reserve") * F.col("scale")).alias("reserve"), F.when((F.col("source") == F.col("node")) & F.col("left").isNotNull(), F.col("left")).otherwise(F.col("residue") * F.col("scale")).alias("residue"))


def cascade(g: Csr, x: np.ndarray, rmax: float, alpha: float = ALPHA, halvings: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Forward push at thresholds 2^halvings * rmax, ..., 2 rmax, rmax, each carrying on from the one before."""
    reserve, residue = np.zeros(g.n), x
    for h in range(halvings, -1, -1):
        reserve, residue = push_vector(g, residue, rmax * 2**h, alpha, reserve=reserve)
    return reserve, residue


def accumulated_residue(g: Csr, x: np.ndarray, alpha: float = ALPHA, hops: int = 2, tiny: float = 1e-14) -> tuple[np.ndarray, np.ndarray]:
    """Push inside the ``hops``-hop ball without pushing the source again, then sum the returns to the source as a
    geometric series. ``x`` is the mass at one source."""
    mass = float(x.sum())
    if mass <= 0:
        return np.zeros(g.n), x.copy()
    source = int(np.argmax(x))
    ball = np.zeros(g.n, bool)
    ball[source] = True
    for _ in range(hops):
        ball = g.reached(ball)
    unit = np.zeros(g.n)
    unit[source] = 1.0
    reserve = alpha * unit
    residue = (1 - alpha) * g.forward(unit)
    # rounds follow the arcs inside the ball; what all rounds move out of it is added at the end
    home = np.flatnonzero(ball)
    s, d, p = g.within(ball)
    s, d, p = np.searchsorted(home, s), np.searchsorted(home, d), (1 - alpha) * p
    held, least, moved = residue[home], tiny * g.deg[home], np.zeros(len(home))
    least[np.searchsorted(home, source)] = np.inf
    while (active := held > least).any():
        now = np.where(active, held, 0.0)
        moved += now
        held = np.where(active, 0.0, held) + np.bincount(d, now[s] * p, len(home))
    reserve[home] += alpha * moved
    out = np.zeros(g.n)
    out[home] = moved
    residue += (1 - alpha) * g.forward(out)
    residue[home] = held
    back = residue[source]
    if back > 0:
        times = max(1, int(np.ceil(np.log(tiny * max(g.deg[source], 1.0)) / np.log(back)))) if back < 1 else 1
        scale = (1 - back**times) / (1 - back)
        reserve, residue = reserve * scale, residue * scale
        residue[source] = back**times
    return reserve * mass, residue * mass

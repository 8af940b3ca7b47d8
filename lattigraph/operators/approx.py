"""Degree-weighted PPR between the nodes, or the supernodes, of a cluster: seven methods.

powiter: power iteration. fora: push, then walks from the residues. foraplus: push at falling thresholds, then walks whose first hop is
forced. foratp: one threshold for the cluster. foraresacc: residue accumulation around the source. fpsn: push alone,
to a threshold set by the largest DNPR. taupush: fpsn for targets of DNPR up to tau, a backward index for the
others.

Walk estimates are unbiased: each of the ceil(r * omega) walks from a residue r carries r over their number.

Graphs of a counted size, or in mapped rows, run in one task for each source; beyond it (``engine="join"``) pushes are joins and
aggregations over all sources at once. There all sources share a node's walks: those of a stored index come first, and where it
holds too few, walks made now carry on from its numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.loop import settle
from ..sources.index import estimate_from_index
from . import graph, ppr
from .csr import Csr, compact
from .ppr import ALPHA, per_source, spread
from .push import accumulated_residue, accumulated_state, cascade, push, push_state, push_vector
from .walks import walk_ends, walks

METHODS = ("powiter", "fora", "foraplus", "foratp", "foraresacc", "fpsn", "taupush")


@dataclass
class Accuracy:
    """The parameters that set thresholds, from a graph's size."""

    n: int
    m: float
    k: int = 25
    relative: float = 0.5

    @property
    def delta(self) -> float:
        return 1 / (250 * math.log(max(self.n, 2)))

    @property
    def mean_degree(self) -> float:
        return 2 * self.m / max(self.n, 1)

    @property
    def tau_max(self) -> float:
        return 1 / math.sqrt(self.k * max(self.n, 1))

    def epsilon(self, delta: float) -> float:
        return min(1 - self.n ** (-2 * self.relative), max(1 - (2 * delta / math.e) ** self.relative, 1 - math.exp(-2 * self.relative)))

    def walks(self, delta: float, mass: float) -> tuple[float, float]:
        """(rmax, omega) of a push with walks; ``mass``: what the threshold is spread over."""
        e = self.epsilon(delta)
        c, fail = 2 + 2 * e / 3, math.log(max(self.n, 2))
        return e * math.sqrt(mass * delta / (2 * self.m * c * fail)), c * fail / (e * e * delta)

    def push(self, tau: float) -> float:
        """rmax of a push without walks for targets of DNPR up to ``tau``."""
        delta = self.mean_degree * self.delta
        return self.epsilon(delta) * delta / (2 * self.m * tau)

    def walk_cost(self, omega: float, residue: float, alpha: float = ALPHA, indexed: bool = False) -> float:
        """Modelled seconds of the walks from ``residue``."""
        return omega * residue * (1 - alpha) * 4e-7 / (140 if indexed else 1)

    def index_threshold(self, spread: float) -> tuple[float, float]:
        """(rmax, omega) of a walk index; ``spread``: the mean degree, times k for foratp."""
        e = 1 - math.exp(-2 * self.relative)
        delta, c, fail = self.mean_degree * self.delta, 2 + 2 * e / 3, math.log(max(self.n, 2))
        return e * math.sqrt(delta * spread / (c * 2 * self.m * fail)), c * fail / (delta * e * e)


def accuracy(a: DataFrame, k: int = 25) -> Accuracy:
    n, m = graph.known(a)["size"] if "size" in graph.known(a) else graph.stats(a).first()[:2]
    return Accuracy(n, float(m or 0), k)


def with_walks(g: Csr, reserve: np.ndarray, residue: np.ndarray, omega: float, alpha: float, seed: int, forced: bool = False) -> np.ndarray:
    """The reserve plus what walks from the residues add; ``forced``: the share that stops at once is added exactly."""
    out = reserve.copy()
    left = residue
    if forced:
        out += alpha * residue
        left = (1 - alpha) * residue
    at = np.flatnonzero(left > 0)
    count = np.ceil(left[at] * omega).astype(np.int64)
    start = np.repeat(at, count)
    number = np.arange(len(start)) - np.repeat(np.cumsum(count) - count, count)
    end = walk_ends(g, start, number, alpha, seed, forced)
    return out + np.bincount(end, np.repeat(left[at] / np.maximum(count, 1), count), g.n)


def leaf_dppr(a: DataFrame, cluster: DataFrame, method: str = "taupush", k: int = 25, alpha: float = ALPHA, seed: int = 2, backward: DataFrame | None = None, engine: str = "auto", index: DataFrame | None = None) -> DataFrame:
    """(source, node, value): deg(s) pi(s, t) between the nodes of ``cluster`` (node). ``index`` (source, walk_no, dest): stored walks of
    the same seed."""
    if engine in ("auto", "csr") and index is None:
        compact(a)  # what it finds out is not to be found again
    seeds = ppr.degree_seeds(a, cluster)
    if method == "powiter":
        return ppr.dppr(a, cluster, alpha=alpha, targets=cluster)
    acc = accuracy(a, k)
    out = _estimate(a, seeds, cluster, method, acc, alpha, seed, k_tau=_tau(a, cluster, acc, method), cluster_degree=None, engine=engine, index=index)
    out = out.join(cluster.select("node").distinct(), "node", "left_semi").select("source", "node", "value")
    return overwrite_heavy(out, backward, cluster) if method == "taupush" and backward is not None else out


def super_dppr(a: DataFrame, membership: DataFrame, method: str = "taupush", k: int = 25, alpha: float = ALPHA, seed: int = 2, engine: str = "auto", index: DataFrame | None = None) -> DataFrame:
    """(source, target, value): mean DPPR between the supernodes of ``membership`` (node, comm)."""
    if method == "powiter":
        return ppr.super_dppr(a, membership, alpha=alpha)
    acc = accuracy(a, k)
    tau = None
    if method in ("fpsn", "taupush"):
        means = ppr.dnpr_closed(a, alpha=alpha).join(membership, "node").groupBy("comm").agg(F.avg("dnpr").alias("d"))
        tau = means.agg(F.max("d")).first()[0]
    values = _estimate(a, ppr.super_seeds(a, membership), membership, method, acc, alpha, seed, k_tau=tau, cluster_degree=cluster_stats(a, membership) if method == "foratp" else None, level=2, engine=engine, index=index)
    return ppr.to_supernodes(values, membership)


def cluster_stats(a: DataFrame, membership: DataFrame) -> DataFrame:
    """(comm, size, dsum, dmean, dmax) by degree."""
    deg = graph.weighted_degree(a)
    return membership.join(deg, "node").groupBy("comm").agg(F.count("*").alias("size"), F.sum("wdeg").alias("dsum"), F.avg("wdeg").alias("dmean"), F.max("wdeg").alias("dmax"))


def _tau(a: DataFrame, cluster: DataFrame, acc: Accuracy, method: str) -> float | None:
    if method not in ("fpsn", "taupush"):
        return None
    d = ppr.dnpr_closed(a).join(cluster.select("node").distinct(), "node", "left_semi")
    if method == "taupush":
        d = d.where(F.col("dnpr") <= acc.tau_max)
    return d.agg(F.max("dnpr")).first()[0] or acc.tau_max


def _estimate(a, seeds, cluster, method, acc, alpha, seed, k_tau, cluster_degree, level=1, engine="auto", index=None) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    csr = compact(a) if engine in ("auto", "csr") and index is None else None
    if csr is None and method in ("fpsn", "taupush"):
        return push(a, seeds, acc.push(k_tau), alpha, engine="join").select("source", "node", F.col("reserve").alias("value"))
    total = None
    if method == "foratp":
        if cluster_degree is None:
            total = (graph.weighted_degree(a).join(cluster.select("node").distinct(), "node", "left_semi").agg(F.sum("wdeg")).first()[0] or 1.0, 1.0)
        else:
            total = tuple(cluster_degree.agg(F.sum("dmean"), F.min("size")).first())

    def limits(mass: float) -> tuple[float, float]:
        """(rmax, omega) of a source."""
        delta = (mass if level == 1 else acc.mean_degree) * acc.delta
        rmax, omega = acc.walks(delta, (mass if level == 1 else 1.0) if total is None else total[0] * total[1])
        return rmax, omega if total is None else omega / total[1]

    if csr is None:
        return _joined(a, seeds, method, limits, acc.m, alpha, seed, index)

    def work(g: Csr, x: np.ndarray):
        mass = float(x.sum())
        if not mass:
            return [np.zeros(g.n)]
        if method in ("fpsn", "taupush"):
            return [push_vector(g, x, acc.push(k_tau), alpha)[0]]
        rmax, omega = limits(mass)
        if method == "foraplus":
            reserve, residue = cascade(g, x, rmax, alpha)
        elif method == "foraresacc":
            reserve, residue = np.zeros(g.n), np.zeros(g.n)
            for v in np.flatnonzero(x):
                one = np.zeros(g.n)
                one[v] = x[v]
                p, r = accumulated_residue(g, one, alpha)
                p, r = push_vector(g, r, 1 / (10 * g.m), alpha, reserve=p)
                reserve, residue = reserve + p, residue + r
        else:
            reserve, residue = push_vector(g, x, rmax, alpha)
        return [with_walks(g, reserve, residue, omega, alpha, seed, forced=method == "foraplus")]

    return per_source(seeds, csr, work, ("value",))


def _joined(a: DataFrame, seeds: DataFrame, method: str, limits, m: float, alpha: float, seed: int, index: DataFrame | None, halvings: int = 3) -> DataFrame:
    """Push over all sources at once, by joins and aggregations, then walks that the sources share; these are made by joins where
    the graph is refused by ``compact``."""

    def of_source(batches):
        for t in batches:
            found = [limits(x) if x > 0 else (1.0, 1.0) for x in t["mass"]]
            yield pd.DataFrame({"source": t["source"], "rmax": [f[0] for f in found], "omega": [f[1] for f in found]})

    masses = seeds.groupBy("source").agg(F.sum("value").alias("mass"))
    each = settle(masses.mapInPandas(of_source, "source long, rmax double, omega double"))
    state = seeds.groupBy("source", "node").agg(F.sum("value").alias("residue")).select("source", "node", F.lit(0.0).alias("reserve"), "residue")
    if method == "foraresacc":
        leaves = settle(seeds.select(F.col("source").alias("of"), F.col("node").alias("leaf"), "value"))
        unit = accumulated_state(a, leaves.select(F.col("leaf").alias("node")), alpha)
        state = unit.join(leaves, F.col("source") == F.col("leaf")).select(F.col("of").alias("source"), "node", (F.col("reserve") * F.col("value")).alias("reserve"), (F.col("residue") * F.col("value")).alias("residue"))
        state = push_state(a, state.groupBy("source", "node").agg(F.sum("reserve").alias("reserve"), F.sum("residue").alias("residue")), 1 / (10 * m), alpha)
    elif method == "foraplus":
        for h in range(halvings, -1, -1):
            state = push_state(a, state, each.select("source", (F.col("rmax") * 2**h).alias("rmax")), alpha)
    else:
        state = push_state(a, state, each.select("source", "rmax"), alpha)
    if method == "foraplus":  # the share that stops at once is added exactly
        state = state.select("source", "node", (F.col("reserve") + alpha * F.col("residue")).alias("reserve"), ((1 - alpha) * F.col("residue")).alias("residue"))
    state = settle(state)
    need = state.where("residue > 0").join(each, "source").groupBy("node").agg(F.max(F.ceil(F.col("residue") * F.col("omega"))).alias("count"))
    if index is not None:
        need = need.join(index.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("first")), "node", "left")
    # walks of one step after another wait for a join each: where tasks can read the graph, a walk is made in one of them
    made = walks(a, need, alpha, seed, force_first=method == "foraplus")
    made = settle(made if index is None else made.unionByName(index.select("source", "walk_no", "dest")))
    return estimate_from_index(state, made, each.select("source", "omega"))


def backward_index(a: DataFrame, membership: DataFrame, k: int = 25, alpha: float = ALPHA) -> DataFrame:
    """(source, target, dppr) for targets with DNPR over tau_max, from every node of the target's cluster.
    membership: (node, comm)."""
    acc = accuracy(a, k)
    csr = compact(a)
    heavy = tau_targets(ppr.dnpr_closed(a, alpha=alpha), acc.tau_max).join(membership, "node")
    delta = acc.n * acc.tau_max / acc.k
    scale = acc.epsilon(delta) * delta
    deg = graph.weighted_degree(a)
    widest = heavy.select(F.col("node").alias("target"), "comm").join(membership, "comm").where("node <> target").join(deg, "node").groupBy("target").agg(F.max("wdeg").alias("dmax"))

    own = heavy.select(F.col("node").alias("target"), "comm").join(membership.withColumnRenamed("node", "source"), "comm").select("source", "target")
    if csr is None:
        # one threshold for all targets, the smallest of theirs
        widest = settle(widest)
        most = widest.agg(F.max("dmax")).first()[0]
        pushed = push(a, ppr.unit_seeds(widest.select(F.col("target").alias("node"))), scale / (most or 1.0), alpha, backward=True, engine="join")
        return pushed.select(F.col("node").alias("source"), F.col("source").alias("target"), "reserve").where("reserve <> 0").join(own, ["source", "target"], "left_semi").join(deg.withColumnRenamed("node", "source"), "source").select("source", "target", (F.col("reserve") * F.col("wdeg")).alias("dppr"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        g, target = csr.value, int(rows["target"].iloc[0])
        x = np.zeros(g.n)
        x[g.index([target])[0]] = 1.0
        reserve, _ = push_vector(g, x, scale / float(rows["dmax"].iloc[0]), alpha, backward=True)
        hit = np.flatnonzero(reserve)
        return pd.DataFrame({"source": g.ids[hit], "target": np.full(len(hit), target), "dppr": reserve[hit] * g.deg[hit]})

    found = widest.repartition(spread(widest), "target").groupBy("target").applyInPandas(run, "source long, target long, dppr double")
    return found.join(own, ["source", "target"], "left_semi")


def overwrite_heavy(values: DataFrame, backward: DataFrame, cluster: DataFrame) -> DataFrame:
    """Values of heavy targets replaced by those of the backward index."""
    inside = cluster.select("node").distinct()
    index = backward.join(inside.select(F.col("node").alias("source")), "source", "left_semi").join(inside.select(F.col("node").alias("target")), "target", "left_semi")
    return values.join(index.select("source", F.col("target").alias("node"), "dppr"), ["source", "node"], "full").select("source", "node", F.coalesce("dppr", "value").alias("value"))


def tau_targets(dnpr: DataFrame, tau: float) -> DataFrame:
    return dnpr.where(F.col("dnpr") > tau)


def tau_split(dnpr: DataFrame, tau: float) -> DataFrame:
    """One row: how many targets are over ``tau``, and the largest DNPR of the others."""
    return dnpr.agg(F.sum(F.when(F.col("dnpr") > tau, 1).otherwise(0)).cast("long").alias("heavy"), F.max(F.when(F.col("dnpr") <= tau, F.col("dnpr"))).alias("next_dnpr"))

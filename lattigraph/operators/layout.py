"""Layouts: tables (i, j, d, w) or arcs in, (node, x, y) out. A group is laid out inside one task."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import plane
from ..plans.loop import settle
from . import cluster, distance, graph, ppr

POINTS = "node long, x double, y double"


def stress_layout(weighted: DataFrame, by: str | None = None, seed: int = 0, n_init: int = 4, max_iter: int = 300, eps: float = 1e-3, metric: bool = True, rule: str = "relative") -> DataFrame:
    """SMACOF on (i, j, d[, w]); w is 1 without the column. ``by`` names a column of groups laid out apart.
    Returns ([by,] node, x, y, stress)."""
    w = F.col("w") if "w" in weighted.columns else F.lit(1.0)
    rows = weighted.select((F.col(by) if by else F.lit(0)).cast("long").alias("g"), F.col("i").cast("long"), F.col("j").cast("long"), F.col("d").cast("double"), w.cast("double").alias("w"))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([t["i"], t["j"]]))
        n = len(ids)
        d, w = np.zeros((n, n)), np.zeros((n, n))
        a, b = np.searchsorted(ids, t["i"]), np.searchsorted(ids, t["j"])
        d[a, b], w[a, b] = t["d"], t["w"]
        x, stress, _ = plane.best_smacof(d, w, seed, n_init, max_iter=max_iter, eps=eps, metric=metric, rule=rule)
        return pd.DataFrame({"g": t["g"].iloc[0], "node": ids, "x": x[:, 0], "y": x[:, 1], "stress": stress})

    out = rows.groupBy("g").applyInPandas(run, "g long, node long, x double, y double, stress double")
    return out.withColumnRenamed("g", by) if by else out.drop("g")


class StressMDS:
    """SMACOF with kept parameters. ``dissimilarity``: "precomputed" takes (i, j, d[, w]); "euclidean" takes (node, features)
    of at most ``distance.DENSE`` nodes."""

    def __init__(self, dissimilarity: str = "precomputed", seed: int = 0, n_init: int = 4, max_iter: int = 300, eps: float = 1e-3, metric: bool = True):
        if dissimilarity not in ("precomputed", "euclidean"):
            raise ValueError(f"unknown dissimilarity {dissimilarity!r}")
        self.dissimilarity, self.how = dissimilarity, {"seed": seed, "n_init": n_init, "max_iter": max_iter, "eps": eps, "metric": metric}
        self.embedding: DataFrame | None = None

    def fit(self, df: DataFrame) -> "StressMDS":
        """Lay ``df`` out; the result is kept in ``embedding``."""
        if self.dissimilarity == "euclidean":
            f = df.select("node", F.col("features").cast("array<double>").alias("f"))
            pairs = distance.grid(f).join(f.select(F.col("node").alias("i"), F.col("f").alias("a")), "i").join(f.select(F.col("node").alias("j"), F.col("f").alias("b")), "j")
            df = pairs.select("i", "j", F.sqrt(F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)).alias("d"))
        self.embedding = settle(stress_layout(df, **self.how))
        return self

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).embedding


def single_level(a: DataFrame, sizes: DataFrame | None = None, steps: int = 15, seed: int = 0, n_init: int = 4, vanilla: bool = False, clamp: bool = True) -> DataFrame:
    """The flagship: PPR distance, radii if ``sizes`` (node, size) are given, boosted weights between small components, SMACOF.
    Returns (node, x, y, stress[, r])."""
    d = distance.ppr_distance(a, steps, degree_weighted=not vanilla, clamp=clamp)
    radii = None
    if sizes is not None:
        d, radii = distance.inflate(d, sizes)
    w = distance.boost_small(distance.weights(d), cluster.components(a))
    out = stress_layout(w, seed=seed, n_init=n_init)
    return out if radii is None else out.join(radii, "node")


def cluster_layout(values: DataFrame, sizes: DataFrame, n: int, seed: int = 0, n_init: int = 1, weight_basis: str = "before") -> DataFrame:
    """A zoomed-in cluster from DPPR (source, node or target, value) between its children and their sizes (node, size).
    ``weight_basis``: weights from the distances before or after radii are added. Returns (node, x, y, stress, r)."""
    to = "target" if "target" in values.columns else "node"
    d = distance.pdist_grid(ppr.symmetrised(values.select("source", F.col(to).alias("node"), "value")), sizes.select("node"), n=n)
    inflated, radii = distance.inflate(d, sizes)
    basis = d if weight_basis == "before" else inflated
    w = distance.weights(basis).select("i", "j", "w")
    return stress_layout(inflated.join(w, ["i", "j"]), seed=seed, n_init=n_init, rule="absolute").join(radii, "node")


def hop_mds(a: DataFrame, seed: int = 0, n_init: int = 4, metric: bool = True) -> DataFrame:
    return stress_layout(distance.hop_distance(a), seed=seed, n_init=n_init, metric=metric)


def simrank_layout(a: DataFrame, steps: int = 5, seed: int = 0) -> DataFrame:
    """SMACOF on the distance of SimRank proximities."""
    d = distance.pdist_grid(ppr.symmetrised(ppr.simrank(a, steps).select(F.col("i").alias("source"), F.col("j").alias("node"), "value")), graph.nodes(a))
    return stress_layout(distance.weights(d), seed=seed)


#: Layouts from the adjacency of one small graph.
PLANE = {
    "fr": lambda m, s: plane.fruchterman_reingold(m, s),
    "forceatlas": lambda m, s: plane.force_atlas(m, s),
    "linlog": lambda m, s: plane.force_atlas(m, s, linlog=True),
    "pivot": lambda m, s: plane.pivot_mds(m, seed=s),
    "maxent": lambda m, s: plane.maxent_stress(m, s),
    "le": lambda m, s: plane.eigenmap(m),
}


def plane_layout(a: DataFrame, method: str, seed: int = 0, most: int = distance.DENSE) -> DataFrame:
    """(node, x, y) by a method of ``PLANE`` for a graph of at most ``most`` nodes."""
    place = PLANE[method]

    def run(t: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([t["src"], t["dst"]]))
        if len(ids) > most:
            raise ValueError(f"{len(ids)} nodes are too many; lay out clusters one at a time")
        x = place(plane.adjacency(len(ids), np.searchsorted(ids, t["src"]), np.searchsorted(ids, t["dst"]), t["w"].to_numpy()), seed)
        return pd.DataFrame({"node": ids, "x": x[:, 0], "y": x[:, 1]})

    return a.select("src", "dst", "w").groupBy(F.lit(0).alias("g")).applyInPandas(lambda t: run(t), POINTS)


def layout(a: DataFrame, method: str = "ppr", seed: int = 0) -> DataFrame:
    """(node, x, y) by name: ppr, vanilla, unclamped, mds, simrank or a method of ``PLANE``."""
    if method in PLANE:
        return plane_layout(a, method, seed)
    named = {"ppr": lambda: single_level(a, seed=seed), "vanilla": lambda: single_level(a, seed=seed, vanilla=True), "unclamped": lambda: single_level(a, seed=seed, clamp=False), "mds": lambda: hop_mds(a, seed), "simrank": lambda: simrank_layout(a, seed=seed)}
    if method not in named:
        raise ValueError(f"unknown layout {method!r}")
    return named[method]().select("node", "x", "y")


def extent(points: DataFrame) -> DataFrame:
    """One row (xmin, xmax, ymin, ymax) of points (x, y, r)."""
    return points.agg(F.min(F.col("x") - F.col("r")).alias("xmin"), F.max(F.col("x") + F.col("r")).alias("xmax"), F.min(F.col("y") - F.col("r")).alias("ymin"), F.max(F.col("y") + F.col("r")).alias("ymax"))


def rescale(points: DataFrame, scale: float = 1.0) -> DataFrame:
    """Points shifted to 0 and divided by the larger extent."""
    box = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    f = F.when(span > 0, scale / span).otherwise(1.0)
    return points.join(F.broadcast(box)).select("node", ((F.col("x") - F.col("x0")) * f).alias("x"), ((F.col("y") - F.col("y0")) * f).alias("y"))


_BOX = "area double, length_parallel double, length_orthogonal double, center_x double, center_y double, unit_x double, unit_y double, angle double, corners array<struct<x:double,y:double>>"


def minimum_box(points: DataFrame) -> DataFrame:
    """One row: the least box around points (x, y). Each task reduces its points to their hull first, so the
    last task sees hulls alone."""

    def hulls(batches):
        kept = None
        for t in batches:
            p = t.to_numpy(float)
            kept = plane.hull(p if kept is None else np.vstack([kept, p]))
        if kept is not None and len(kept):
            yield pd.DataFrame(kept, columns=["x", "y"])

    def box(t: pd.DataFrame) -> pd.DataFrame:
        b = plane.minimum_box(t[["x", "y"]].to_numpy(float))
        return pd.DataFrame([(b.area, b.length_parallel, b.length_orthogonal, *b.center, *b.unit_vector, b.angle, [{"x": x, "y": y} for x, y in b.corners])], columns=[c.split()[0] for c in _BOX.split(", ")])

    corners = points.select(F.col("x").cast("double"), F.col("y").cast("double")).mapInPandas(hulls, "x double, y double")
    return corners.groupBy(F.lit(0).alias("g")).applyInPandas(lambda t: box(t), _BOX)


def rotate(points: DataFrame) -> DataFrame:
    """Points turned so that their least box lies along the axes."""
    angle = minimum_box(points).select("angle")
    c, s = F.cos("angle"), F.sin("angle")
    return points.join(F.broadcast(angle)).select("node", (F.col("x") * c + F.col("y") * s).alias("x"), (F.col("y") * c - F.col("x") * s).alias("y"))


def best_fit(points: DataFrame) -> DataFrame:
    """Rotated points with both axes divided so that the width is 4."""
    turned = rotate(points)
    width = turned.agg((F.max("x") - F.min("x")).alias("width"))
    return turned.join(F.broadcast(width)).select("node", (F.col("x") / (F.col("width") / 4)).alias("x"), (F.col("y") / (F.col("width") / 4)).alias("y"))


def svg(points: DataFrame, edges: DataFrame | None = None, size: int = 640, labels: bool = False, most: int = 20_000) -> str:
    """A drawing of at most ``most`` points (node, x, y[, r]) and the edges between them."""
    p = points.limit(most + 1).toPandas()
    if len(p) > most:
        raise ValueError(f"over {most} points: draw a cluster instead")
    xy = p[["x", "y"]].to_numpy(float)
    try:
        xy = plane.rotate(xy)
    except ValueError:
        pass
    r = p["r"].to_numpy(float) if "r" in p else np.zeros(len(p))
    low, high = (xy - r[:, None]).min(0), (xy + r[:, None]).max(0)
    f = (size - 20) / max(float((high - low).max()), 1e-9)
    at = dict(zip(p["node"], (xy - low) * f + 10))
    lines = []
    if edges is not None:
        inside = points.select("node")
        kept = edges.join(inside.withColumnRenamed("node", "src"), "src", "left_semi").join(inside.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst").limit(20 * most + 1).collect()
        if len(kept) > 20 * most:
            raise ValueError(f"over {20 * most} edges: draw a cluster instead")
        lines = [f'<line x1="{at[s][0]:.2f}" y1="{at[s][1]:.2f}" x2="{at[d][0]:.2f}" y2="{at[d][1]:.2f}" stroke="lightgray" stroke-width="0.5"/>' for s, d in kept]
    dots = [f'<circle cx="{at[n][0]:.2f}" cy="{at[n][1]:.2f}" r="{min(max(x * f, 1.5), size / 8):.2f}"/>' for n, x in zip(p["node"], r)]
    text = [f'<text x="{at[n][0]:.2f}" y="{at[n][1]:.2f}" font-size="5">{n}</text>' for n in p["node"]] if labels else []
    height = math.ceil(float((high - low)[1]) * f + 20)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" height="{height}">{"".join(lines + dots + text)}</svg>'

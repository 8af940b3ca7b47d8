"""Random walks with restart. Every random number is a hash of (seed, source, walk, step), so a walk can be
repeated by anyone and a lost task repeats it exactly."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import uniform
from ..plans.loop import Settled, settle
from . import graph
from .csr import Csr, compact
from .ppr import ALPHA, spread


#: In the join engine a node's arcs are added up in so many parts, and looked up in buckets of about so many arcs.
SALTS, BUCKET = 16, 64


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _uniform(source: np.ndarray, walk: np.ndarray, step: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = source.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + walk.astype(np.uint64)
        return (_mix(_mix(key) + np.uint64((step * 0xD1342543DE82EF95 + seed) % 2**64)) >> np.uint64(11)).astype(float) / float(1 << 53)


def walk_ends(g: Csr, start: np.ndarray, walk: np.ndarray, alpha: float = ALPHA, seed: int = 2, force_first: bool = False) -> np.ndarray:
    """Where each walk from ``start`` (places) stops; a dead end goes back to its start."""
    at, step = start.copy(), 0
    going = np.arange(len(start))
    while len(going):
        s, k = g.ids[start[going]], walk[going]
        if step or not force_first:
            going = going[_uniform(s, k, 2 * step, seed) >= alpha]
        if not len(going):
            break
        u = _uniform(g.ids[start[going]], walk[going], 2 * step + 1, seed)
        here = at[going]
        count = g.starts[here + 1] - g.starts[here]
        heavy = _cumulative(g)
        if heavy is None:
            pick = g.starts[here] + np.minimum((u * count).astype(np.int64), np.maximum(count - 1, 0))
        else:
            pick = np.searchsorted(heavy, heavy_start(heavy, g, here) + u * g.deg[here], side="right")
            pick = np.clip(pick, g.starts[here], np.maximum(g.starts[here + 1] - 1, g.starts[here]))
        at[going] = np.where(count > 0, g.dst[np.minimum(pick, max(len(g.dst) - 1, 0))], start[going])
        step += 1
    return at


def _cumulative(g: Csr):
    """Running weight over arcs, or None where all weights are equal."""
    if not hasattr(g, "_cum"):
        g._cum = None if len(g.w) == 0 or np.all(g.w == g.w[0]) else np.cumsum(g.w)
    return g._cum


def heavy_start(cumulative: np.ndarray, g: Csr, here: np.ndarray) -> np.ndarray:
    before = g.starts[here] - 1
    return np.where(before >= 0, cumulative[np.maximum(before, 0)], 0.0)


def walks(a: DataFrame, need: DataFrame, alpha: float = ALPHA, seed: int = 2, force_first: bool = False, engine: str = "auto") -> DataFrame:
    """(source, walk_no, dest) for ``need`` (node, count): count walks from each node; with a column ``first`` those from that
    number on. A walk depends on its node and number alone, so walks made at different times add up."""
    low = F.coalesce(F.col("first").cast("long"), F.lit(0)) if "first" in need.columns else F.lit(0).cast("long")
    numbered = need.where(F.col("count") > low).select(F.col("node").alias("source"), F.explode(F.sequence(low, F.col("count").cast("long") - 1)).alias("walk_no"))
    csr = compact(a) if engine in ("auto", "csr") else None
    if csr is not None:

        def run(batches):
            g = csr.value
            for rows in batches:
                at = g.index(rows["source"])
                ok = at >= 0
                end = walk_ends(g, at[ok], rows["walk_no"].to_numpy()[ok], alpha, seed, force_first)
                dest = rows["source"].to_numpy().copy()
                dest[ok] = g.ids[end]
                yield pd.DataFrame({"source": rows["source"], "walk_no": rows["walk_no"], "dest": dest})

        return numbered.repartition(spread(numbered), "source", "walk_no").mapInPandas(run, "source long, walk_no long, dest long")
    table, degree = arc_ranges(a)
    state, step = Settled(numbered.select("source", "walk_no", F.col("source").alias("at"), F.lit(True).alias("going"))), 0
    while state.df.where("going").head(1):
        stops = F.lit(False) if force_first and not step else uniform(seed + 2 * step, F.col("source"), F.col("walk_no")) < alpha
        moving = state.df.where("going").withColumn("going", ~stops)
        # a walk's mark on the weights of its node, and the bucket that holds the mark
        drawn = moving.where("going").join(degree, F.col("at") == F.col("node"), "left").withColumn("mark", uniform(seed + 2 * step + 1, F.col("source"), F.col("walk_no")) * F.col("wdeg"))
        drawn = drawn.withColumn("bucket", F.least(F.floor(F.col("mark") / F.col("wide")), F.col("buckets") - 1))
        met = drawn.join(table, (F.col("at") == F.col("src")) & (F.col("bucket") == F.col("in_bucket")) & (F.col("mark") >= F.col("low")) & (F.col("mark") < F.col("high")), "left")
        moved = met.select("source", "walk_no", F.coalesce("dst", "source").alias("at"), F.lit(True).alias("going"))
        new = Settled(state.df.where("not going").unionByName(moving.where("not going")).unionByName(moved))
        state.remove()
        state, step = new, step + 1
    return state.df.select("source", "walk_no", F.col("at").alias("dest"))


def arc_ranges(a: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arcs as ranges low .. high of their node's weight, in buckets: (src, dst, low, high, in_bucket), and (node, wdeg,
    wide, buckets). Buckets are of equal width, one for ``BUCKET`` arcs; an arc lies in all that it reaches into. Arcs are
    added up in parts by a hash of dst, so that a hub is in no single task."""
    arcs = a.select("src", "dst", "w").withColumn("part", F.pmod(F.xxhash64("dst"), F.lit(SALTS)))
    within = Window.partitionBy("src", "part").orderBy("dst").rowsBetween(Window.unboundedPreceding, 0)
    parts = settle(arcs.groupBy("src", "part").agg(F.sum("w").alias("total"), F.count("*").alias("arcs")))
    before = parts.select("src", "part", (F.sum("total").over(Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("before"))
    degree = settle(parts.groupBy(F.col("src").alias("node")).agg(F.sum("total").alias("sum"), F.ceil(F.sum("arcs") / BUCKET).alias("buckets")))
    ends = arcs.withColumn("upto", F.sum("w").over(within)).join(before, ["src", "part"]).select("src", "dst", "part", (F.col("before") + F.col("upto")).alias("high"))
    # an arc begins where the one before ends: ranges leave no gap to rounding
    last = F.lag("high").over(Window.partitionBy("src", "part").orderBy("dst"))
    ends = settle(ends.withColumn("last", last))
    tops = ends.groupBy("src", "part").agg(F.max("high").alias("top"))
    first = tops.select("src", "part", F.coalesce(F.lag("top").over(Window.partitionBy("src").orderBy("part")), F.lit(0.0)).alias("first"))
    degree = settle(degree.join(tops.groupBy(F.col("src").alias("node")).agg(F.max("top").alias("wdeg")), "node").select("node", "wdeg", (F.col("wdeg") / F.col("buckets")).alias("wide"), "buckets"))
    ranges = ends.join(first, ["src", "part"]).join(degree, F.col("src") == F.col("node")).withColumn("low", F.coalesce("last", "first"))
    bucket = lambda c: F.least(F.floor(F.col(c) / F.col("wide")), F.col("buckets") - 1)
    return settle(ranges.select("src", "dst", "low", "high", F.explode(F.sequence(bucket("low"), bucket("high"))).alias("in_bucket"))), degree


def walk_index(a: DataFrame, rmax: float, omega: float, alpha: float = ALPHA, seed: int = 2, plus: bool = False) -> DataFrame:
    """ceil(deg * rmax * omega) walks from every node; ``plus``: times (1 - alpha), and the first hop is forced."""
    share = (1 - alpha) if plus else 1.0
    need = graph.weighted_degree(a).select("node", F.ceil(F.col("wdeg") * share * rmax * omega).alias("count"))
    return walks(a, need, alpha, seed, force_first=plus)

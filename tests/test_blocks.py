"""Joins over arcs and vectors in files, beyond what one task takes: the same values as one task's, and no table of joined rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattigraph.operators import blocks, graph, ppr
from lattigraph.plans import loop
from lattigraph.plans.loop import settle

from .graphs import edges_df, random_edges

EDGES = random_edges(50, 90)
SEEDS = [(1, 1, 1.0), (7, 7, 1.0), (7, 9, 0.5), (-4, 3, 2.0), (12, 999, 1.0), (8, 8, 0.0)]


def seeds_df(spark, rows=SEEDS):
    return spark.createDataFrame(rows, "source long, node long, value double")


def values(df):
    rows = df.collect()
    out = {(r.source, r.node): r.value for r in rows}
    assert len(out) == len(rows)
    return out


def stepped(arcs, seeds, steps, alpha=0.2):
    """By hand, over a dict."""
    out = {}
    leave = {}
    for s, _, w in arcs:
        leave[s] = leave.get(s, 0) + w
    for source in {s for s, _, _ in seeds}:
        x, total = {}, {}
        for s, v, value in seeds:
            if s == source:
                x[v] = x.get(v, 0) + value
        for k in range(steps + 1):
            for v, value in x.items():
                total[v] = total.get(v, 0) + alpha * value
            new = {}
            for s, d, w in arcs:
                if s in x:
                    new[d] = new.get(d, 0) + (1 - alpha) * x[s] * w / leave[s]
            x = new
        out |= {(source, v): value for v, value in total.items() if value}
    return out


def close(got, want):
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


@pytest.fixture
def small(monkeypatch):
    """Blocks, pieces and vectors of a few values."""
    monkeypatch.setattr(ppr, "LIMIT", 10)
    monkeypatch.setattr(ppr, "NEAR", 1)
    monkeypatch.setattr(blocks, "BLOCK", 40)
    monkeypatch.setattr(blocks, "NEAR", 15)
    monkeypatch.setattr(blocks, "HELD", 120)
    monkeypatch.setattr(blocks, "TILE", 3)
    monkeypatch.setattr(blocks, "PIECE", 20)


@pytest.mark.parametrize("kind", ["equal", "weighted", "directed", "far apart"])
def test_blocks_give_what_joins_give(spark, small, monkeypatch, kind):
    a = graph.symmetric(edges_df(spark, EDGES))
    if kind == "weighted":
        a = a.withColumn("w", 1.0 + F.col("dst") % 3)
    if kind == "directed":  # with nodes that no arc leaves, nodes at which none ends, and parallel arcs
        a = a.where("src % 5 <> 0 and dst % 7 <> 0 or src = 3").withColumn("w", F.lit(0.5)).unionByName(spark.createDataFrame([(1, 2, 0.5), (2, 2, 0.5)], "src long, dst long, w double"))
    seeds = SEEDS
    if kind == "far apart":
        far = lambda c: F.col(c) * 10**12 - 7
        a, seeds = a.select(far("src").alias("src"), far("dst").alias("dst"), "w"), [(s, v * 10**12 - 7, x) for s, v, x in SEEDS]
    a = settle(a)
    rows = [tuple(r) for r in a.select("src", "dst", "w").collect()]
    monkeypatch.setattr(ppr.graph, "row_normalised", None)  # arcs are not joined with rows
    for steps in (5, 0):
        close(values(ppr.truncated(a, seeds_df(spark, seeds), steps, engine="join")), stepped(rows, seeds, steps))


def test_no_arc_is_written_again_in_a_step(spark, small, monkeypatch, tmp_path):
    """Before: each step shuffled all arcs, and the joined rows of all sources, which filled the disks."""
    a = settle(graph.symmetric(edges_df(spark, EDGES)))
    monkeypatch.setattr(blocks, "mounted", lambda spark: str(tmp_path))
    settled, tables = loop.Settled.__init__, []
    monkeypatch.setattr(loop.Settled, "__init__", lambda self, df, *rest: tables.append(df.columns) or settled(self, df, *rest))
    counts = []
    for steps in (2, 7):
        tables.clear()
        found = ppr.truncated(a, seeds_df(spark), steps, engine="join")
        counts.append(len(tables))
        assert found.count() > 50
    assert counts[0] == counts[1]
    left = sorted(f.split("-")[0] for d in os.listdir(tmp_path) for f in os.listdir(tmp_path / d))
    assert set(left) == {"ids", "value"}  # arcs and older steps are gone


def test_a_folder_that_is_not_mounted_has_joins(spark, small, monkeypatch):
    a = settle(graph.symmetric(edges_df(spark, EDGES)).withColumn("w", 1.0 + F.col("dst") % 3))
    monkeypatch.setattr(blocks, "mounted", lambda spark: None)
    rows = [tuple(r) for r in a.select("src", "dst", "w").collect()]
    close(values(ppr.truncated(a, seeds_df(spark), 4, engine="join")), stepped(rows, SEEDS, 4))


def test_pieces_hold_all_rows():
    cut, tile = np.array([0, 9, 30, 31, 40, 41, 50]), np.array([0, 2, 3, 6])
    for near in (1, 2, 10, 25, 100):
        parts = list(blocks.pieces(cut, tile, near))
        assert parts[0][0] == 0 and parts[-1][1] == 6 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert all(j == i + 1 or cut[j] - cut[i] <= near for i, j in parts) and {2, 3} <= {j for _, j in parts}

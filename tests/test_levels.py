"""Louvain and the size-bounded hierarchy over mapped rows; before, graphs of more than a task's arcs ran as rounds of joins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattigraph.operators import cluster, csr, graph, levels
from lattigraph.plans.loop import settle

from .graphs import edges_df, random_edges
from .test_cluster import blocks


@pytest.fixture(params=[(2_000_000, 200_000), (60, 0)])
def cut(monkeypatch, request):
    """Whole levels at once, or blocks of few arcs in tasks of their own."""
    monkeypatch.setattr(levels, "BLOCK", request.param[0])
    monkeypatch.setattr(levels, "FEW", request.param[1])
    monkeypatch.setattr(levels, "PIECE", 25 if request.param[1] == 0 else 1_000_000)


def test_louvain_finds_the_blocks(spark, cut):
    a = settle(graph.symmetric(edges_df(spark, blocks() + [(100, 101), (101, 102)])))
    found = cluster.louvain(a, engine="mapped")
    assert cluster.modularity(a, found[-1]).first()[0] > 0.7
    label = dict(found[-1].collect())
    assert len(set(label.values())) <= 8 and len(label) == 43


def test_coarse_rows_are_the_sums(spark, cut):
    a = settle(graph.symmetric(edges_df(spark, random_edges(60, 90))))
    rows, comm = cluster._mapped(a, "mapped"), (np.arange(60) % 7).astype(np.int32)
    for _ in range(2):  # of equal weights, then of weights
        found = levels.coarse(spark, rows, comm, comm.max() + 1)
        member = spark.createDataFrame([(i, int(c)) for i, c in enumerate(comm)], "node long, comm long")
        want = {(r.src, r.dst): r.w for r in cluster.coarsen(a, member).collect()}
        src = np.repeat(np.arange(found.n), found.count)
        assert {(s, d): w for s, d, w in zip(src.tolist(), found.dst.tolist(), found.w.tolist())} == want
        rows, a, comm = found, settle(cluster.coarsen(a, member)), np.array([0, 0, 1, 1, 1, 2, 2], np.int32)


@pytest.mark.parametrize("hard,small", [(False, False), (True, False), (True, True)])
def test_hierarchy(spark, cut, hard, small):
    edges = random_edges(80, 60) + [(200 + i, 201 + i) for i in range(5)]
    a = settle(graph.symmetric(edges_df(spark, edges)))
    membership, hierarchy = cluster.louvain_plus(a, k=10, hard_cap=hard, include_small_components=small, engine="mapped")
    nodes = sorted(r.node for r in graph.nodes(a).collect() if small or r.node < 200)
    assert sorted(r.leaf for r in membership.where("level = 1").collect()) == nodes
    assert cluster.roots(membership).count() == (2 if small else 1)
    sizes = [r["count"] for r in membership.where("level = 1").groupBy("component", "id").count().collect()]
    assert not hard or max(sizes) <= 10
    near, comm = {}, {r.leaf: r.id for r in membership.where("level = 1").collect()}
    for s, d in edges:
        if s in comm and comm[s] != comm[d]:
            near.setdefault(comm[s], set()).add(comm[d])
            near.setdefault(comm[d], set()).add(comm[s])
    size = {c: list(comm.values()).count(c) for c in set(comm.values())}
    for c, others in near.items():  # nothing is left to join
        assert size[c] >= 10 or (hard and all(size[c] + size[o] > 10 for o in others))
    rebuilt = cluster.expand(hierarchy, membership.where("level = 1"))
    if not small:
        assert sorted(rebuilt.collect()) == sorted(membership.collect())


def test_no_move_is_left(spark):
    edges = [(i, i + 1) for i in range(300)] + random_edges(60, 90)
    a = settle(graph.symmetric(edges_df(spark, edges)))
    rows = cluster._mapped(a, "mapped")
    ids = np.load(f"{rows.folder}/ids.npy")
    comm = levels.local_moves(spark, rows, 1, 1e-6)
    member = spark.createDataFrame([(int(i), int(c)) for i, c in zip(ids, comm)], "node long, comm long")
    gains = cluster.merge_gain(a, member).join(member.select("node", F.col("comm").alias("own")), "node").join(graph.weighted_degree(a), "node")
    m2 = a.count()
    rows = gains.select("node", (F.col("gain") + F.when(F.col("own") == F.col("comm"), F.col("wdeg") * F.col("wdeg") / m2).otherwise(0.0)).alias("gain"), (F.col("own") == F.col("comm")).alias("stays"))
    best = rows.groupBy("node").agg((F.max("gain") - F.max(F.when(F.col("stays"), F.col("gain")))).alias("up"))
    assert 2 * (best.agg(F.sum(F.greatest("up", F.lit(0.0)))).first()[0] or 0.0) / m2 <= 1e-6
    assert (levels.components(spark, cluster._mapped(a, "mapped")) == 0).all()


def test_the_way_down_is_the_same(spark):
    """A large graph takes the rows by itself."""
    a = settle(graph.symmetric(edges_df(spark, random_edges(80, 60))))
    membership, hierarchy = cluster.louvain_plus(a, k=10, engine="mapped")
    path = cluster.random_path(hierarchy, membership)
    assert path == cluster.random_path(*reversed(cluster.louvain_plus(a, k=10, engine="mapped"))) and path[-1][0] == 1


@pytest.fixture
def unread(spark, monkeypatch):
    """Edges with parallel ones, and their arcs as a plan that fails if it is run."""
    edges = edges_df(spark, random_edges(80, 60) + [(b, a) for a, b in random_edges(80, 60)])
    monkeypatch.setattr(csr, "FEW", 10)
    monkeypatch.setattr(csr, "symmetric", lambda e: e.select("src", "dst", F.raise_error(F.lit("arcs were read")).cast("double").alias("w")))
    return settle(graph.symmetric(edges)), csr.undirected(edges)


def test_hierarchy_and_louvain_straight_from_edges(unread, cut):
    """Before, arcs were a table first."""
    for table, rows in zip(*(cluster.louvain_plus(a, k=10, engine="mapped") for a in unread)):
        assert sorted(table.collect()) == sorted(rows.collect()) and table.head(1)
    table, rows = (cluster.louvain(a, engine="mapped")[-1] for a in unread)
    assert sorted(table.collect()) == sorted(rows.collect())


def test_a_way_down_straight_from_edges(unread, monkeypatch):
    """The root is the component's own; before, all supernodes met in a join, and the arcs were a table."""
    want, got = (cluster.louvain_plus(a, k=10, engine="mapped") for a in unread)
    top = cluster.roots(want[0]).where("component = 0").orderBy(F.xxhash64("id", F.lit(2))).first()
    monkeypatch.setattr(cluster, "roots", None)
    path = cluster.random_path(*reversed(got))
    assert path == cluster.random_path(*reversed(want)) and path[0] == (top.level, top.id) and [level for level, _ in path] == list(range(top.level, 0, -1))
    kids = {r.id for r in got[0].where("level = 1").collect()}
    assert path[-1][1] in kids


def by_hand(folder, s, d, w=None):
    """A level of arcs both ways, without Spark."""
    s, d, w = np.r_[s, d], np.r_[d, s], None if w is None else np.r_[w, w]
    order = np.lexsort((d, s))
    n = int(s.max()) + 1
    held = {"starts": np.searchsorted(s[order], np.arange(n + 1)), "dst": d[order].astype(np.int32), "w": np.array(1.0) if w is None else w[order]}
    if w is not None:
        held["deg"] = np.bincount(s, w, n)
    for name, x in held.items():
        np.save(folder / f"{name}.npy", x)
    return levels.Level(str(folder))


@pytest.mark.parametrize("most,matrix", [(30, 0), (4, 1 << 23)])
def test_communities_are_even_after_few_rounds(tmp_path, monkeypatch, most, matrix):
    """Before, a quarter of the proposals counted in a round, and all that fitted with none joined the same neighbour."""
    draw = np.random.default_rng(3)
    pairs = np.unique([(i, 2000 + j) for i in range(2000) for j in draw.choice(60, 10, replace=False)], axis=0)
    level, rounds, over = by_hand(tmp_path, pairs[:, 0], pairs[:, 1]), [], levels._over
    monkeypatch.setattr(levels, "FEW", 1 << 40)
    monkeypatch.setattr(levels, "MATRIX", matrix, raising=False)
    monkeypatch.setattr(levels, "_over", lambda *a: rounds.append(0) or over(*a))
    comm = levels.merged(None, level, np.arange(level.n), 25, 1, False)
    sizes = np.unique(comm, return_counts=True)[1]
    assert len(comm) == 2060 and 25 <= sizes.min() and sizes.max() <= 75 and len(rounds) <= most


def test_what_is_left_is_merged_in_order(tmp_path):
    """As in one task, from a table of weights."""
    draw = np.random.default_rng(5)
    pairs = np.unique(np.sort(draw.choice(90, (500, 2)), axis=1), axis=0)
    pairs = pairs[pairs[:, 0] < pairs[:, 1]]
    level = by_hand(tmp_path, pairs[:, 0], pairs[:, 1], draw.random(len(pairs)) + 0.1)
    comm = levels.merged(None, level, np.arange(level.n), 10, 4, True)
    want = cluster._merge_in_order(np.repeat(np.arange(level.n), level.count), np.asarray(level.dst), np.asarray(level.w), 10, 4, True)[1]
    same = lambda c: c[:, None] == c[None, :]
    assert (same(comm) == same(want)).all()

import math

import numpy as np
import pytest

from lattigraph.operators import approx, distance, graph, ppr, push, walks
from lattigraph.operators.csr import compact
from lattigraph.plans.loop import settle
from pyspark.sql import functions as F

from .graphs import EXAMPLE, dense, edges_df, exact_ppr, matrix, random_edges

N = 60
EDGES = random_edges(N)


@pytest.fixture(scope="module")
def arcs(spark):
    return settle(graph.symmetric(edges_df(spark, EDGES)))


@pytest.fixture(scope="module")
def pi():
    return exact_ppr(EDGES, N)


def test_worked_example(spark):
    a = graph.symmetric(edges_df(spark, EXAMPLE))
    got = dense(ppr.exact(a, ppr.unit_seeds(graph.nodes(a)), 1e-12), 10)
    # fixed values of the worked example
    assert got[0, 8] == pytest.approx(0.010877, abs=1e-6) and got[2, 0] == pytest.approx(0.108582, abs=1e-6) and got[6, 9] == pytest.approx(0.444444, abs=1e-6)
    d = dense(ppr.dppr(a, tolerance=1e-12), 10)
    assert 1 - math.log(d[0, 8] + d[8, 0]) == pytest.approx(3.729357, abs=1e-6)
    assert 1 - math.log(d[6, 9] + d[9, 6]) == pytest.approx(1.117783, abs=1e-6)
    members = spark.createDataFrame([(0, 0), (3, 0), (1, 1), (2, 1), (5, 2)], "node long, comm long")
    s = dense(ppr.super_dppr(a, members, 1e-12), 3, j="target")
    assert s[1, 0] == pytest.approx(0.566913, abs=1e-6) and s[2, 0] == pytest.approx(0.390295, abs=1e-6) and s[2, 1] == pytest.approx(0.503713, abs=1e-6)
    coarse = graph.arcs(spark.createDataFrame([(0, 1, 4.0), (1, 2, 1.0), (0, 2, 1.0)], "src long, dst long, weight double"))
    deg = {0: 2, 1: 2, 2: 2}
    c = dense(ppr.exact(coarse, ppr.unit_seeds(graph.nodes(coarse)), 1e-12), 3)
    assert c[1, 0] * deg[1] == pytest.approx(0.740118, abs=1e-6) and c[2, 0] * deg[2] == pytest.approx(0.689655, abs=1e-6)


@pytest.mark.parametrize("engine", ["csr", "join"])
def test_truncated(arcs, pi, engine):
    sources = graph.nodes(arcs).where("node < 5")
    got = dense(ppr.truncated(arcs, ppr.unit_seeds(sources), 15, engine=engine), N)[:5]
    assert np.allclose(got.sum(1), 1 - 0.8**16)
    assert np.abs(got - pi[:5]).max() < 0.8**16


def test_dppr_is_symmetric_and_exact(arcs, pi):
    d = dense(ppr.dppr(arcs, tolerance=1e-12), N)
    assert np.abs(d - d.T).max() < 1e-10
    assert np.abs(d - matrix(EDGES, N).sum(1)[:, None] * pi).max() < 1e-9


def test_dnpr(arcs):
    a, b = (dict(x.collect()) for x in (ppr.dnpr(arcs), ppr.dnpr_closed(arcs)))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-12


@pytest.mark.parametrize("backward", [False, True])
def test_push_bounds_and_engines(spark, arcs, pi, backward):
    deg = matrix(EDGES, N).sum(1)
    sources = graph.nodes(arcs).where("node < 4")
    seeds = ppr.unit_seeds(sources) if backward else ppr.degree_seeds(arcs, sources)
    rmax = 0.01
    out = {e: settle(push.push(arcs, seeds, rmax, backward=backward, engine=e)) for e in ("csr", "join")}
    reserve = {e: dense(x, N, "reserve")[:4] for e, x in out.items()}
    residue = {e: dense(x, N, "residue")[:4] for e, x in out.items()}
    assert np.allclose(reserve["csr"], reserve["join"]) and np.allclose(residue["csr"], residue["join"])
    if backward:
        gap = pi[:, :4].T - reserve["csr"]
        assert gap.min() > -1e-12 and gap.max() <= rmax + 1e-12
    else:
        gap = deg[:4, None] * pi[:4] - reserve["csr"]
        assert gap.min() > -1e-12 and (gap <= rmax * deg[None] + 1e-12).all()
        assert np.allclose((reserve["csr"] + residue["csr"]).sum(1), deg[:4])


def test_residue_accumulation_keeps_mass(arcs):
    g = compact(arcs).value
    x = np.zeros(g.n)
    x[3] = 4.0
    reserve, residue = push.accumulated_residue(g, x)
    assert (reserve >= 0).all() and (residue >= 0).all()
    assert (reserve + residue).sum() == pytest.approx(4.0, abs=1e-9)
    r2, s2 = push.cascade(g, x, 0.001)
    assert (r2 + s2).sum() == pytest.approx(4.0) and (s2 <= 0.001 * g.deg + 1e-12).all()


@pytest.mark.parametrize("engine", ["csr", "join"])
def test_walks_are_unbiased_and_repeatable(spark, arcs, pi, engine):
    need = spark.createDataFrame([(0, 4000)], "node long, count long")
    once = settle(walks.walks(arcs, need, engine=engine))
    again = walks.walks(arcs, need, engine=engine)
    assert sorted(once.collect()) == sorted(again.collect())
    share = np.zeros(N)
    for dest, c in once.groupBy("dest").count().collect():
        share[dest] = c / 4000
    assert np.abs(share - pi[0]).max() < 0.03


@pytest.mark.parametrize("method", approx.METHODS)
def test_methods_are_close(arcs, pi, method):
    cluster = graph.nodes(arcs).where("node < 12")
    index = settle(approx.backward_index(arcs, cluster.select("node", F.lit(0).cast("long").alias("comm")), k=4)) if method == "taupush" else None
    got = dense(approx.leaf_dppr(arcs, cluster, method, k=4, backward=index), N)[:12, :12]
    want = (matrix(EDGES, N).sum(1)[:, None] * pi)[:12, :12]
    assert (got[:, 12:] == 0).all() and np.abs(got - want).max() < 0.08


@pytest.mark.parametrize("method", ["powiter", "fora", "foratp", "taupush", "foraplus"])
def test_super_methods_are_close(spark, arcs, pi, method):
    members = graph.nodes(arcs).select("node", F.floor(F.col("node") / 15).cast("long").alias("comm"))
    got = dense(approx.super_dppr(arcs, members, method, k=4), 4, j="target")
    d = matrix(EDGES, N).sum(1)[:, None] * pi
    want = d.reshape(4, 15, 4, 15).mean((1, 3))
    assert np.abs(got - want).max() < 0.03


def test_pdist(spark):
    a = graph.symmetric(edges_df(spark, [(0, 1), (1, 2), (3, 4)]))
    d = dense(distance.ppr_distance(a), 5, "d", "i", "j")
    assert d[0, 3] == pytest.approx(2 * math.log2(5)) and d.min() >= 2 and np.allclose(d, d.T)
    b = distance.boost_small(distance.weights(distance.ppr_distance(a)), spark.createDataFrame([(i, c) for i, c in zip(range(5), [0, 0, 0, 3, 4])], "node long, comp long"), share=0.5)
    w = dense(b, 5, "w", "i", "j")
    assert w[3, 4] == pytest.approx(2 / d[3, 4] ** 2) and w[0, 1] == pytest.approx(1 / d[0, 1] ** 2)
    h = dense(distance.hop_distance(a), 5, "d", "i", "j")
    assert h[0, 2] == 3 and h[0, 1] == 2 and h[0, 3] == 0 and h[0, 0] == 0
    with pytest.raises(ValueError):
        distance.grid(graph.nodes(a), most=3)


def test_simrank(spark):
    a = graph.symmetric(edges_df(spark, EXAMPLE))
    got = dense(ppr.simrank(a, 3), 10, i="i", j="j")
    w = matrix(EXAMPLE, 10)
    w /= w.sum(1, keepdims=True)
    s = np.eye(10)
    for _ in range(3):
        s = 0.9 * w @ s @ w.T
        np.fill_diagonal(s, 1)
    assert np.allclose(got, s)


def test_tau_push_by_joins_beyond_one_task(spark, monkeypatch):
    a = settle(graph.symmetric(edges_df(spark, random_edges(40, 60))))
    nodes = settle(graph.nodes(a))
    comm = nodes.select("node", F.lit(0).cast("long").alias("comm"))

    def values():
        index = settle(approx.backward_index(a, comm, k=2))
        rows = approx.leaf_dppr(a, nodes, "fpsn", k=2), approx.leaf_dppr(a, nodes, "taupush", k=2, backward=index)
        return [dense(x, 40) for x in rows], index.count()

    (fpsn, tau), heavy = values()
    monkeypatch.setattr(approx, "compact", lambda a: None)
    (fpsn_join, tau_join), heavy_join = values()
    assert np.abs(fpsn - fpsn_join).max() < 1e-9 and heavy_join >= heavy
    exact = dense(ppr.dppr(a, nodes), 40)
    assert np.abs(tau_join - exact).max() <= np.abs(tau - exact).max() + 1e-9


def test_queries_on_a_graph_that_grows(spark):
    from lattigraph.plans import queries, tables

    t = tables.Tables(spark, "/root/testdata/sf0.001")
    n = graph.nodes(queries.ps_arcs(t)).count()
    assert queries.REGISTRY["walk_index"](spark, t.dir).select("source").distinct().count() == n > 25
    assert queries.REGISTRY["louvain_plus"](spark, t.dir).where("level = 1").count() == n
    assert queries.REGISTRY["push_forward_ps"](spark, t.dir).select("source").distinct().count() == t.ps_sources().count() > 0


def test_weighted_walks_agree_between_engines(spark):
    edges = [(0, i, float(i)) for i in range(1, 200)] + [(1, 2, 50.0), (3, 4, 0.25)]
    a = settle(graph.symmetric(spark.createDataFrame(edges, "src long, dst long, weight double"), sum_parallel=True))
    need = spark.createDataFrame([(0, 20_000), (1, 20_000), (7, 5)], "node long, count long")
    share = {}
    for engine in ("csr", "join"):
        got = walks.walks(a, need, engine=engine, force_first=True)
        assert got.count() == 40_005 and got.where("dest is null").count() == 0
        share[engine] = dense(got.groupBy("source", "dest").agg((F.count("*") / 20_000).alias("value")), 200, j="dest")[:2]
    assert np.abs(share["csr"] - share["join"]).max() < 0.02
    low, high = (share[e][0, 1:50].sum() for e in ("csr", "join"))
    assert abs(low - high) < 0.02


@pytest.mark.parametrize("method", ["fora", "foraplus"])
def test_walk_methods_by_joins(spark, method):
    """Beyond one task the same methods run as joins: as close to the exact values, with and without stored walks."""
    a = settle(graph.symmetric(edges_df(spark, random_edges(20, 26))))
    nodes = settle(graph.nodes(a).where("node < 3"))
    want = dense(ppr.dppr(a, nodes, targets=nodes), 20)[:3, :3]
    stored = None
    if method == "fora":
        acc = approx.accuracy(a, 4)
        stored = settle(walks.walk_index(a, *acc.index_threshold(acc.mean_degree)))
    got = dense(approx.leaf_dppr(a, nodes, method, k=4, engine="join", index=stored), 20)[:3, :3]
    assert np.abs(got - want).max() < 0.1


def test_residue_accumulation_by_joins(spark):
    edges = random_edges(14, 18)
    a = settle(graph.symmetric(edges_df(spark, edges)))
    g = compact(a).value
    leaves = graph.nodes(a).where("node in (0, 3)")
    state = push.accumulated_state(a, leaves, hops=1, tiny=1e-3)
    reserve, residue = dense(state, 14, "reserve"), dense(state, 14, "residue")
    for leaf in (0, 3):
        x = np.zeros(g.n)
        x[g.index([leaf])[0]] = 1.0
        r, s = push.accumulated_residue(g, x, hops=1, tiny=1e-3)
        assert np.allclose(reserve[leaf, g.ids], r) and np.allclose(residue[leaf, g.ids], s)
        assert (reserve[leaf] + residue[leaf]).sum() == pytest.approx(1.0)


def test_walks_carry_on_from_a_number(spark, arcs):
    whole = walks.walks(arcs, spark.createDataFrame([(0, 9)], "node long, count long"), engine="join")
    rest = walks.walks(arcs, spark.createDataFrame([(0, 9, 4)], "node long, count long, first long"), engine="join")
    assert sorted(whole.where("walk_no >= 4").collect()) == sorted(rest.collect()) and rest.count() == 5


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from lattigraph.plans import loop

    def session(master, named=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: named), sparkContext=context)

    assert loop.scratch(session("spark://host:7077", "hdfs://a/b/")) == "hdfs://a/b"
    assert loop.scratch(session("local[2]")).startswith("file://")
    with pytest.raises(RuntimeError, match="checkpoint"):
        loop.scratch(session("spark://host:7077"))


@pytest.mark.parametrize("wide,near", [(16, 100_000), (3, 12), (3, 25)])
def test_joins_of_many_sources(spark, monkeypatch, wide, near):
    """Sources side by side, over the arcs that they reach where these are few; before, each source joined all arcs in each step."""
    edges = EDGES + [(100 + a, 100 + b) for a, b in random_edges(20, 26)]
    a = settle(graph.symmetric(edges_df(spark, edges)).withColumn("w", 1.0 + F.col("dst") % 3))
    sources = spark.createDataFrame([(100 + i,) for i in (0, 2, 3, 5, 7, 11, 13)], "node long")
    seeds = ppr.unit_seeds(sources).unionByName(spark.createDataFrame([(100, 105, 0.5), (100, 105, 0.25), (-4, 3, 2.0)][: 2 if near == 25 else 3], "source long, node long, value double"))
    whole = {(r.source, r.node): r.value for r in ppr.truncated(a, seeds, 6, engine="csr").collect()}
    monkeypatch.setattr(ppr, "LIMIT", 10)
    monkeypatch.setattr(ppr, "WIDE", wide)
    monkeypatch.setattr(ppr, "NEAR", near)
    for steps in (6, 0, 1):
        want = whole if steps == 6 else {(r.source, r.node): r.value for r in ppr.truncated(a, seeds, steps, engine="csr").collect()}
        got = {(r.source, r.node): r.value for r in ppr.truncated(a, seeds, steps, engine="join").collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    if near == 25:
        left = ppr._leaving(a, seeds, 6)
        assert left.count() == a.where("src >= 100").count() < a.count()
    assert ppr.truncated(a, seeds.where("value > 9"), 2, engine="join").count() == 0

"""Graphs beyond one task's memory, as rows in files that tasks map."""

import numpy as np
import pytest

from lattigraph.operators import approx, csr, graph, ppr, push, walks
from lattigraph.plans.loop import settle
from pyspark.sql import functions as F

from .graphs import dense, edges_df, random_edges

N = 60
EDGES = random_edges(N) + [(100 + a, 100 + b) for a, b in random_edges(20, 26)]


@pytest.fixture(scope="module")
def arcs(spark):
    return settle(graph.symmetric(edges_df(spark, EDGES)))


@pytest.fixture(params=[40, 150, 10_000])
def small(monkeypatch, request):
    """Files of few arcs a piece; a component of more than ``param`` arcs stays in them."""
    monkeypatch.setattr(csr, "PIECE", 50)
    monkeypatch.setattr(csr, "BLOCK", 70)
    shared = csr.Shared.value.fget
    limit = request.param

    class Small(csr.Mapped):
        def around(self, nodes):
            kept, csr.LIMIT = csr.LIMIT, limit
            try:
                return super().around(nodes)
            finally:
                csr.LIMIT = kept

    monkeypatch.setattr(csr, "Mapped", Small)
    monkeypatch.setattr(csr.Shared, "_open", {})
    return shared


def test_rows_and_steps(arcs, small):
    whole, g = csr._compact(arcs, csr.LIMIT).value, csr.compact(arcs, 10).value
    assert isinstance(g, csr.Mapped) and (g.ids == whole.ids).all() and (g.dst == whole.dst).all() and (g.deg == whole.deg).all() and g.m == whole.m
    x = np.random.default_rng(1).random(g.n)
    assert np.allclose(g.forward(x), whole.forward(x)) and np.allclose(g.backward(x), whole.backward(x))
    mask = x < 0.1
    assert (g.reached(mask) == whole.reached(mask)).all()
    part = g.around([103])
    assert part.m == g.m and part.n in (g.n, 20)


def test_components_in_memory_are_rows_too(arcs, small, monkeypatch):
    """Exact values of a small component come from conjugate gradients as well, sizes from what is known; before, from three times
    the power steps, and from a job for each method."""
    g, whole = csr.compact(arcs, 10).value, csr.compact(arcs, csr.LIMIT).value
    assert g.around([10**6]).n == 0  # a node without arcs
    part = g.around([103])
    assert isinstance(part, csr.Mapped) and part.n in (g.n, 20)
    x, y = (np.where(h.ids == 103, 7.0, 0.0) for h in (part, whole))
    got, total = 0.2 * ppr.solved(part, x, 1e-11, 300), y.copy()
    for _ in range(150):
        y = 0.8 * whole.forward(y)
        total += y
    assert np.allclose(got, 0.2 * total[whole.index(part.ids)], atol=1e-10)
    monkeypatch.setitem(graph.known(arcs), "size", (80, 123))
    assert (approx.accuracy(arcs).n, approx.accuracy(arcs).m) == (80, 123.0)


def test_methods_are_those_of_a_graph_in_memory(arcs, small, monkeypatch):
    """Truncated sums, pushes, estimates and walks; before, a graph beyond the limit was joined."""
    sources = settle(graph.nodes(arcs).where("node < 3 or node = 105"))
    need = sources.select("node", F.lit(30).alias("count"))

    def values():
        out = [dense(ppr.truncated(arcs, ppr.unit_seeds(sources)), 130)]
        out += [dense(push.push(arcs, ppr.unit_seeds(sources), 0.001, backward=b), 130, "reserve") for b in (False, True)]
        out += [dense(approx.leaf_dppr(arcs, sources, m, k=4), 130) for m in ("fora", "foraplus", "foratp", "foraresacc", "fpsn")]
        return out, sorted(walks.walks(arcs, need).collect())

    (want, ends), mapped = values(), csr.compact(arcs, 10)
    assert isinstance(mapped.value, csr.Mapped)
    for module in (ppr, push, approx, walks):
        monkeypatch.setattr(module, "compact", lambda a: mapped)
    got, again = values()
    assert all(np.allclose(a, b) for a, b in zip(got, want)) and ends == again


@pytest.mark.parametrize("apart", [1, 10**12])
def test_rows_straight_from_edges(spark, small, monkeypatch, apart):
    """Parallel edges, loops and nulls; before, arcs were made distinct in a table first."""
    rows = EDGES + [(b, a) for a, b in EDGES[::3]] + EDGES[::2] + [(4, 4), (None, 3), (3, None), (999, 999)]
    edges = spark.createDataFrame([(a and a * apart, b and b * apart) for a, b in rows], "src long, dst long").repartition(3)
    want = settle(graph.symmetric(edges))
    monkeypatch.setattr(csr, "FEW", 10)
    got = csr.undirected(edges)
    a, b = csr.compact(want, 10).value, csr.compact(got, 10).value
    assert isinstance(b, csr.Mapped) and all(np.array_equal(x, y) for x, y in ((a.ids, b.ids), (a.starts, b.starts), (a.dst, b.dst), (a.deg, b.deg))) and a.m == b.m
    whole = csr.compact(got, 10_000).value
    assert not isinstance(whole, csr.Mapped) and np.array_equal(whole.dst, a.dst) and np.array_equal(whole.ids, a.ids)
    assert sorted(graph.weighted_degree(got).collect()) == sorted(graph.weighted_degree(want).collect()) and graph.stats(got).first() == graph.stats(want).first()
    assert sorted(got.collect()) == sorted(want.collect())
    monkeypatch.setattr(csr, "mounted", lambda spark: None)
    assert sorted(csr.undirected(edges).collect()) == sorted(want.collect())


def test_refused(spark, arcs, monkeypatch):
    one_way = arcs.where("src < dst or src = 3")
    weighted = arcs.withColumn("w", F.least("src", "dst") + 1.0)
    assert csr.compact(one_way, 10) is None and csr.compact(weighted, 10) is None
    monkeypatch.setattr(csr, "mounted", lambda spark: None)
    assert csr._compact(arcs, 10) is None


def test_supernodes_are_summed_where_the_values_are(spark, arcs, monkeypatch):
    members = graph.nodes(arcs).where("node < 110").select("node", F.floor(F.col("node") / 20).cast("long").alias("comm"))
    want = {(r[0], r[1]): r[2] for r in ppr.super_truncated(arcs, members, engine="join").collect()}
    again = {(r[0], r[1]): r[2] for r in ppr.to_supernodes(ppr.truncated(arcs, ppr.super_seeds(arcs, members)), members).collect()}
    for engine in ("csr", "mapped"):
        if engine == "mapped":
            kept = csr.compact(arcs, 10)
            monkeypatch.setattr(ppr, "compact", lambda a: kept)
        got = {(r[0], r[1]): r[2] for r in ppr.super_truncated(arcs, members).collect()}
        assert got.keys() == want.keys() == again.keys() and all(got[k] == pytest.approx(want[k]) == pytest.approx(again[k]) for k in want)


def test_shared_walks_wait_for_no_joins(spark, arcs, monkeypatch):
    """Pushes by joins, walks in tasks: a stored index of the same walks, topped up, changes nothing."""
    sources = settle(graph.nodes(arcs).where("node < 3"))
    mapped = csr.compact(arcs, 10)
    monkeypatch.setattr(walks, "compact", lambda a: mapped)
    monkeypatch.setattr(walks, "arc_ranges", None)  # of walks by joins alone
    stored = settle(walks.walks(arcs, graph.nodes(arcs).select("node", F.lit(2).alias("count"))))
    got = [dense(approx.leaf_dppr(arcs, sources, "fora", k=4, engine="join", index=i), N)[:3, :3] for i in (None, stored)]
    want = dense(ppr.dppr(arcs, sources, targets=sources), N)[:3, :3]
    assert np.allclose(*got) and np.abs(got[0] - want).max() < 0.1


def test_counts_meet_once_whatever_the_ids():
    """Before, each batch of a task gave a row for each of its nodes."""
    draw = np.random.default_rng(2)
    for ids in (np.arange(-50, 50), draw.integers(-(2**62), 2**62, 100)):
        parts = [(draw.choice(ids, 30), np.ones(30, np.int64)) for _ in range(9)]
        node, count = csr._summed(iter(parts))
        want = np.unique(np.concatenate([p[0] for p in parts]), return_counts=True)
        assert (node == want[0]).all() and (count == want[1]).all() and count.dtype == np.int64
    assert [len(x) for x in csr._summed(iter([]))] == [0, 0]


def test_rows_of_ids_far_apart(spark):
    edges = [(-5, 2**61), (7, 2**61), (7, -5), (2**61, 7), (1 << 20, 1023), (1024, 1023)]
    found = {}
    g = csr.write_edges(spark.createDataFrame(edges, "src long, dst long").repartition(3), found).value
    assert g.ids.tolist() == sorted({x for e in edges for x in e}) and found["size"] == (6, 5)
    rows = {int(g.ids[i]): {int(g.ids[x]) for x in g.dst[g.starts[i] : g.starts[i + 1]]} for i in range(g.n)}
    assert rows == {v: {b if a == v else a for a, b in edges if v in (a, b)} for v in g.ids.tolist()}

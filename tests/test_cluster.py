import numpy as np
import pytest

from lattigraph.operators import cluster, graph
from lattigraph.plans.loop import settle
from lattigraph.plans.zoom import Atlas
from pyspark.sql import functions as F

from .graphs import edges_df, random_edges


def blocks(k=5, size=8, seed=1):
    r = np.random.default_rng(seed)
    inside = [(b * size + i, b * size + j) for b in range(k) for i in range(size) for j in range(i) if r.random() < 0.8]
    return sorted({(min(e), max(e)) for e in inside + [(b * size, (b + 1) % k * size) for b in range(k)]})


@pytest.fixture(scope="module")
def arcs(spark):
    return settle(graph.symmetric(edges_df(spark, blocks() + [(100, 101), (101, 102)])))


@pytest.mark.parametrize("engine", ["sequential", "rounds"])
def test_components_against_union_find(spark, engine):
    r = np.random.default_rng(3)
    edges = r.integers(0, 300, (180, 2)).tolist() + [(i, i + 1) for i in range(400, 440)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    a = graph.symmetric(edges_df(spark, edges))
    got = dict(cluster.components(a, engine).collect())
    assert got == {n: find(n) for n in got} and len(got) == len({x for e in edges for x in e if e[0] != e[1]})


def test_largest_component(arcs):
    assert cluster.largest_component(cluster.components(arcs)).count() == 40


def test_modularity_and_coarsening(spark, arcs):
    member = graph.nodes(arcs).select("node", F.floor(F.col("node") / 8).cast("long").alias("comm"))
    q = cluster.modularity(arcs, member).first()[0]
    e = [(r.src, r.dst) for r in arcs.collect()]
    m2 = len(e)
    deg = {}
    for s, _ in e:
        deg[s] = deg.get(s, 0) + 1
    want = sum((1 if s // 8 == d // 8 else 0) for s, d in e) / m2 - sum((sum(v for k, v in deg.items() if k // 8 == c)) ** 2 for c in {k // 8 for k in deg}) / m2**2
    assert q == pytest.approx(want)
    coarse = cluster.coarsen(arcs, member)
    assert coarse.agg(F.sum("w")).first()[0] == m2
    same = graph.nodes(coarse).select("node", F.col("node").alias("comm"))
    assert cluster.modularity(coarse, same).first()[0] == pytest.approx(q)


def test_moves(spark):
    m = spark.createDataFrame([(1, 7), (2, 7), (3, 9)], "node long, comm long")
    assert dict(cluster.move(m, spark.createDataFrame([(2, 9)], "node long, comm long")).collect()) == {1: 7, 2: 9, 3: 9}


@pytest.mark.parametrize("engine", ["sequential", "rounds"])
def test_louvain_finds_the_blocks(arcs, engine):
    levels = cluster.louvain(arcs, engine=engine)
    q = cluster.modularity(arcs, levels[-1]).first()[0]
    assert q > 0.7
    label = dict(levels[-1].collect())
    assert len(set(label.values())) <= 8 and len(label) == 43


@pytest.mark.parametrize("hard,engine", [(False, "sequential"), (True, "sequential"), (True, "rounds")])
def test_louvain_plus_contract(spark, hard, engine):
    a = settle(graph.symmetric(edges_df(spark, random_edges(80, 60))))
    membership, hierarchy = cluster.louvain_plus(a, k=10, hard_cap=hard, engine=engine)
    nodes = {r.node for r in graph.nodes(a).collect()}
    for level in {r.level for r in membership.select("level").distinct().collect()}:
        leaves = [r.leaf for r in membership.where(F.col("level") == level).collect()]
        assert sorted(leaves) == sorted(nodes)
    assert cluster.roots(membership).count() == 1
    if hard:
        assert membership.where("level = 1").groupBy("id").count().agg(F.max("count")).first()[0] <= 10
    rebuilt = cluster.expand(hierarchy, membership.where("level = 1"))
    assert sorted(rebuilt.collect()) == sorted(membership.collect())
    path = cluster.random_path(hierarchy, membership)
    assert path == cluster.random_path(hierarchy, membership) and path[-1][0] == 1


@pytest.mark.parametrize("engine", ["sequential", "rounds"])
def test_all_leaves_join_their_hub(spark, engine):
    a = settle(graph.symmetric(edges_df(spark, [(0, i) for i in range(1, 401)])))
    assert cluster.size_bounded_level(a, 10, engine=engine).select("comm").distinct().count() == 1
    capped = cluster.size_bounded_level(a, 10, hard_cap=True, engine=engine).groupBy("comm").count().agg(F.max("count"), F.count("*")).first()
    assert tuple(capped) == (10, 392)


@pytest.mark.parametrize("engine", ["sequential", "rounds"])
def test_no_move_is_left(spark, engine):
    edges = [(i, i + 1) for i in range(300)] + random_edges(60, 90)
    a = settle(graph.symmetric(edges_df(spark, edges)))
    comm = dict(cluster.local_moves(a, engine=engine).collect())
    near, tot, m2 = {}, {}, 0
    for r in a.collect():
        near.setdefault(r.src, []).append(r.dst)
        tot[comm[r.src]] = tot.get(comm[r.src], 0) + 1
        m2 += 1
    left = 0
    for v, to in near.items():
        gain = lambda c: sum(comm[u] == c for u in to) - (tot[c] - (len(to) if c == comm[v] else 0)) * len(to) / m2  # noqa: E731,B023
        left += max(0, max(gain(comm[u]) for u in to) - gain(comm[v]))
    assert 2 * left / m2 <= 1e-6


def test_all_components_are_clustered(arcs):
    membership, _ = cluster.louvain_plus(arcs, k=10, include_small_components=True)
    assert membership.where("level = 1").count() == 43 and cluster.roots(membership).count() == 2


def test_zoom(spark):
    atlas = Atlas.build(edges_df(spark, random_edges(60, 90)), k=8)
    way = atlas.path(embed=False)
    exact = Atlas(atlas.arcs, atlas.membership, atlas.hierarchy, 8, "powiter")
    for level, ident, got in way:
        want = {(r.source, r.target): r.value for r in exact.proximity(0, level, ident).collect()}
        have = {(r.source, r.target): r.value for r in got.collect()}
        assert max(abs(have.get(k, 0) - v) for k, v in want.items()) < 0.1
    level, ident, _ = way[0]
    laid = atlas.zoom(0, level, ident)
    assert laid.count() == cluster.children(atlas.hierarchy, atlas.membership, 0, level, ident).count()
    assert laid.where("x is null or isnan(x) or r <= 0").count() == 0
    assert atlas.draw(0, level, ident).startswith("<svg")
    assert atlas.hubs(5).count() == 5

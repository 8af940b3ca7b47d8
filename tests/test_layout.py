import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattigraph.functions import plane
from lattigraph.operators import graph, layout, metrics

from .graphs import EXAMPLE, edges_df, matrix, random_edges


def points_df(spark, x):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "node long, x double, y double")


def test_smacof_lowers_stress():
    r = np.random.default_rng(0)
    truth = r.random((15, 2))
    d = plane.distances(truth)
    w = np.where(d > 0, 1 / np.maximum(d, 1e-9) ** 2, 0)
    stress = [plane.smacof(d, w, seed=3, max_iter=i, eps=-1)[1] for i in (1, 5, 20, 80)]
    assert all(b <= a + 1e-9 for a, b in zip(stress, stress[1:]))
    x, s, _ = plane.best_smacof(d, w, n_init=8, max_iter=500, eps=1e-9)
    assert np.abs(plane.distances(x) - d).max() < 0.05
    assert plane.smacof(d, w, metric=False)[0].shape == (15, 2)
    assert plane.smacof(d, w, rule="absolute")[2] <= 300


def test_isotonic():
    assert plane.isotonic([1, 3, 2, 4]).tolist() == [1, 2.5, 2.5, 4]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), min_size=4, max_size=25, unique=True))
def test_minimum_box_holds_all_points(points):
    p = np.array(points, float)
    if np.linalg.matrix_rank(p - p[0]) < 2:
        return
    b = plane.minimum_box(p)
    u, o = np.array(b.unit_vector), np.array([-b.unit_vector[1], b.unit_vector[0]])
    c = np.array(b.center)
    assert (np.abs((p - c) @ u) <= b.length_parallel / 2 + 1e-6).all() and (np.abs((p - c) @ o) <= b.length_orthogonal / 2 + 1e-6).all()
    assert b.area == pytest.approx(b.length_parallel * b.length_orthogonal)
    angles = np.linspace(0, math.pi / 2, 181)
    boxes = [np.ptp(p @ [math.cos(t), math.sin(t)]) * np.ptp(p @ [-math.sin(t), math.cos(t)]) for t in angles]
    assert b.area <= min(boxes) + 1e-6


def test_boxes_and_fits(spark):
    p = np.array([(0, 0), (4, 4), (5, 3), (1, -1), (2, 1)], float)
    df = points_df(spark, p)
    assert layout.minimum_box(df).first().area == pytest.approx(8 * math.sqrt(2) / math.sqrt(2))
    fitted = np.array([(r.x, r.y) for r in layout.best_fit(df).orderBy("node").collect()])
    assert np.ptp(fitted[:, 0]) == pytest.approx(4)
    scaled = np.array([(r.x, r.y) for r in layout.rescale(df).orderBy("node").collect()])
    assert scaled.min() == 0 and scaled.max() == 1
    with pytest.raises(ValueError):
        plane.minimum_box(p[:2])


def brute_metrics(edges, x):
    n = len(x)
    nd = sum(1 / ((x[u] - x[v]) ** 2).sum() for u in range(n) for v in range(u))
    length = [math.dist(x[a], x[b]) for a, b in edges]
    near = {v: sorted({b if a == v else a for a, b in edges if v in (a, b)}) for v in range(n)}
    ar = 0.0
    for v, ns in near.items():
        for i in ns:
            for j in ns:
                if i < j:
                    p, q = x[i] - x[v], x[j] - x[v]
                    c = min(1, max(-1, p @ q / np.linalg.norm(p) / np.linalg.norm(q)))
                    ar += 1 - min(15, math.degrees(math.acos(c))) ** 2 / 225
    return nd, np.std(length) / np.mean(length), ar


def cross(a, b, c, d):
    side = lambda p, q, r: np.sign((q[1] - p[1]) * (r[0] - q[0]) - (q[0] - p[0]) * (r[1] - q[1]))
    return side(a, b, c) != side(a, b, d) and side(c, d, a) != side(c, d, b)


@pytest.mark.parametrize("block", [3, 2000])
def test_metrics_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(metrics, "BLOCK", block)
    edges = random_edges(20, 25)
    x = np.random.default_rng(4).random((20, 2))
    arcs, p = graph.symmetric(edges_df(spark, edges)), points_df(spark, x)
    nd, cv, ar = brute_metrics(edges, x)
    e = graph.canonical(edges_df(spark, edges))
    assert metrics.node_distribution(p).first()[0] == pytest.approx(nd)
    assert metrics.edge_length_cv(e, p).first()[0] == pytest.approx(cv)
    assert metrics.angular_resolution(arcs, p).first()[0] == pytest.approx(ar)
    n = sum(cross(x[a], x[b], x[c], x[d]) for i, (a, b) in enumerate(edges) for c, d in edges[:i] if not {a, b} & {c, d})
    got = metrics.crossing_ratio(e, p).first()
    deg = matrix(edges, 20).sum(1)
    m = len(edges)
    assert got.crossings == n and got.ratio == pytest.approx(n / (m * (m - 1) / 2 - (deg * (deg - 1) / 2).sum()))


def test_metrics_do_not_change_under_motion(spark):
    edges = random_edges(12, 10)
    x = np.random.default_rng(6).random((12, 2))
    t = 0.7
    y = x @ np.array([[math.cos(t), -math.sin(t)], [math.sin(t), math.cos(t)]]) + [3, -2]
    arcs = graph.symmetric(edges_df(spark, edges))
    a, b = (metrics.evaluate(arcs, points_df(spark, z)).first() for z in (x, y))
    assert a.ulcv == pytest.approx(b.ulcv) and a.ar == pytest.approx(b.ar)
    assert metrics.node_distribution(points_df(spark, [(0, 0), (0, 0)])).first()[0] == math.inf


@pytest.mark.parametrize("method", ["ppr", "vanilla", "unclamped", "mds", "simrank", *layout.PLANE])
def test_layouts_place_every_node(spark, method):
    a = graph.symmetric(edges_df(spark, EXAMPLE))
    p = layout.layout(a, method).toPandas()
    assert sorted(p.node) == list(range(10)) and np.isfinite(p[["x", "y"]].to_numpy()).all()


def test_sizes_and_drawing(spark):
    a = graph.symmetric(edges_df(spark, EXAMPLE))
    sizes = graph.nodes(a).selectExpr("node", "cast(1 + node as int) as size")
    p = layout.single_level(a, sizes, n_init=1)
    assert p.where("r > 0").count() == 10
    assert layout.extent(p).first().xmin < p.agg({"x": "min"}).first()[0]
    svg = layout.svg(p, a.where("src < dst"), labels=True)
    assert svg.count("<circle") == 10 and svg.count("<line") == 14 and svg.count("<text") == 10
    with pytest.raises(ValueError):
        layout.layout(a, "nothing")
    with pytest.raises(ValueError):
        layout.svg(p, most=3)


def test_estimator(spark):
    truth = np.random.default_rng(2).random((12, 3)) * [3, 2, 0]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(truth)], "node long, features array<double>")
    p = layout.StressMDS("euclidean", n_init=8, max_iter=500, eps=1e-9).fit_transform(df).orderBy("node").toPandas()[["x", "y"]].to_numpy()
    assert np.abs(plane.distances(p) - plane.distances(truth)).max() < 0.05
    with pytest.raises(ValueError):
        layout.StressMDS("cosine")


def test_pair_metrics_by_sectors_and_cells(spark):
    """Angular resolution and crossings against all pairs, with coinciding and aligned points."""
    r = np.random.default_rng(8)
    xy = [(float(x), float(y)) for x, y in r.integers(0, 9, (24, 2))]
    edges = sorted({(min(a, b), max(a, b)) for a, b in r.integers(0, 24, (60, 2)).tolist() if a != b})
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(xy)], "node long, x double, y double")
    e = spark.createDataFrame(edges, "src long, dst long")
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    total = 0.0
    for v, ends in near.items():
        for i, a in enumerate(ends):
            for b in ends[:i]:
                p, q = (np.subtract(xy[u], xy[v]) for u in (a, b))
                if np.linalg.norm(p) and np.linalg.norm(q):
                    angle = np.degrees(np.arccos(np.clip(p @ q / np.linalg.norm(p) / np.linalg.norm(q), -1, 1)))
                    total += 1 - min(15.0, angle) ** 2 / 225
    arcs = e.unionByName(e.selectExpr("dst as src", "src as dst"))
    assert metrics.angular_resolution(arcs, points).first()[0] == pytest.approx(total, abs=1e-9)

    def side(a, b, c):
        v = (b[1] - a[1]) * (c[0] - b[0]) - (b[0] - a[0]) * (c[1] - b[1])
        return (v > 0) - (v < 0)

    def on(a, b, c):
        return min(a[0], c[0]) <= b[0] <= max(a[0], c[0]) and min(a[1], c[1]) <= b[1] <= max(a[1], c[1])

    def meet(a, b, c, d):
        o = side(a, b, c), side(a, b, d), side(c, d, a), side(c, d, b)
        return o[0] != o[1] and o[2] != o[3] or not o[0] and on(a, c, b) or not o[1] and on(a, d, b) or not o[2] and on(c, a, d) or not o[3] and on(c, b, d)

    want = {(s, t) for s in edges for t in edges if s > t and not set(s) & set(t) and meet(*(xy[u] for u in (*s, *t)))}
    got = {((x.a_src, x.a_dst), (x.b_src, x.b_dst)) for x in metrics.crossings(e, points).collect()}
    assert {tuple(sorted(p, reverse=True)) for p in got} == want and len(got) == len(want)


def test_a_grid_of_any_size(spark, monkeypatch):
    """Beyond the dense limit all pairs are there and equal those of the dense grid, if asked for."""
    from lattigraph.operators import distance

    a = graph.symmetric(spark.createDataFrame([(1, 2), (2, 3), (7, 9), (9, 11), (20, 21)], "src long, dst long"))
    want = sorted(distance.ppr_distance(a).collect())
    monkeypatch.setattr(distance, "DENSE", 3)
    got = sorted(distance.ppr_distance(a, most=None).collect())
    assert [r[:2] for r in got] == [r[:2] for r in want] and len(got) == 64
    assert all(abs(x.d - y.d) < 1e-12 for x, y in zip(got, want))
    with pytest.raises(ValueError):
        distance.ppr_distance(a, most=3)

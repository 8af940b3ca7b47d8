import pytest

from lattigraph.functions.exprs import parse_supernode, supernode_name, uniform
from lattigraph.operators import graph
from pyspark.sql import functions as F

RAW = [(1, 2), (2, 1), (1, 2), (3, 3), (3, 5), (9, 5), (None, 4)]


def pairs(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_canonical_and_arcs(spark):
    e = spark.createDataFrame(RAW, "src long, dst long")
    assert pairs(graph.canonical(e), "src", "dst") == [(1, 2), (3, 5), (5, 9)]
    assert pairs(graph.canonical(e, "keep", True), "src", "dst", "weight") == [(1, 2, 3.0), (3, 3, 1.0), (3, 5, 1.0), (5, 9, 1.0)]
    a = graph.symmetric(e, "keep")
    assert pairs(a, "src", "dst") == [(1, 2), (2, 1), (3, 3), (3, 5), (5, 3), (5, 9), (9, 5)]
    assert dict(pairs(graph.degree(a), "node", "deg")) == {1: 1, 2: 1, 3: 3, 5: 2, 9: 1}
    assert dict(pairs(graph.degree(a, False), "node", "deg"))[3] == 2
    assert dict(pairs(graph.self_loop_weight(a), "node", "loop")) == {1: 0, 2: 0, 3: 1, 5: 0, 9: 0}
    with pytest.raises(ValueError):
        graph.canonical(e, "maybe")


def test_renumber_and_induced(spark):
    e = graph.canonical(spark.createDataFrame(RAW, "src long, dst long"))
    assert pairs(graph.renumber(e), "src", "dst") == [(0, 1), (2, 3), (3, 4)]
    a = graph.arcs(e)
    members = spark.createDataFrame([(3,), (5,), (7,)], "node long")
    assert pairs(graph.induced(a, members), "src", "dst") == [(3, 5), (5, 3)]
    sub, ids = graph.induced_renumbered(a, members)
    assert pairs(sub, "src", "dst") == [(0, 1), (1, 0)] and dict(pairs(ids, "node", "new")) == {3: 0, 5: 1, 7: 2}


def test_symmetry_stats_and_rows(spark):
    a = spark.createDataFrame([(1, 2, 1.0), (2, 1, 2.0), (1, 3, 1.0)], "src long, dst long, w double")
    assert pairs(graph.symmetry_violations(a).fillna(-1.0), "src", "dst", "w", "back") == [(1, 2, 1.0, 2.0), (1, 3, 1.0, -1.0), (2, 1, 2.0, 1.0)]
    assert pairs(graph.row_normalised(a), "src", "dst", "p") == [(1, 2, 0.5), (1, 3, 0.5), (2, 1, 1.0)]
    e = graph.symmetric(spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long"))
    assert tuple(graph.stats(e).first()) == (3, 2, 4 / 3)
    empty = graph.symmetric(spark.createDataFrame([], "src long, dst long"))
    assert graph.degree(empty).count() == 0 and graph.dense_ids(graph.nodes(empty)).count() == 0


def test_names_and_uniform(spark):
    df = spark.createDataFrame([(0, 2, 17)], "c int, l int, i long").select(supernode_name(F.col("c"), F.col("l"), F.col("i")).alias("name"))
    assert df.first().name == "c0_l2_17"
    assert tuple(df.select(*parse_supernode(F.col("name"))).first()) == (0, 2, 17)
    assert tuple(df.select(*parse_supernode(F.lit("c0_x"))).first()) == (None, None, None)
    u = [r[0] for r in spark.range(2000).select(uniform(3, F.col("id"))).collect()]
    assert 0 < min(u) < max(u) < 1 and abs(sum(u) / len(u) - 0.5) < 0.03


def test_renumber_takes_columns_of_any_name(spark):
    e = spark.createDataFrame([(5, 9, 1, 2), (9, 30, 3, 4)], "src long, dst long, a int, new_src int")
    assert sorted(map(tuple, graph.renumber(e).collect())) == [(0, 1, 1, 2), (1, 2, 3, 4)]

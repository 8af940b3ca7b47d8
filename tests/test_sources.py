import json

import numpy as np
import pytest

from lattigraph import cli
from lattigraph.operators import approx, graph, ppr, push, walks
from lattigraph.plans.loop import settle
from lattigraph.sources import binary, index, text
from lattigraph.streaming import ingest
from pyspark.sql import functions as F

from .graphs import EXAMPLE, dense, edges_df, random_edges


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_edge_lists(spark, tmp_path):
    f = tmp_path / "g.txt"
    f.write_text("0 1\n\n1\t2  \n 2 0\n")
    assert rows(text.read_edges(spark, str(f)).select("src", "dst")) == [(0, 1), (1, 2), (2, 0)]
    with pytest.raises(Exception, match="outside"):
        text.read_edges(spark, str(f), n=2).collect()
    w = spark.createDataFrame([(0, 1, 2.5)], "src long, dst long, weight double")
    text.write_edges(w, str(tmp_path / "w"), weighted=True)
    assert rows(text.read_edges(spark, str(tmp_path / "w"), weighted=True)) == [(0, 1, 2.5)]
    (tmp_path / "a.txt").write_text("n=3\nm=4\n")
    side = text.read_sidecar(spark, str(tmp_path / "a.txt"))
    assert side == {"n": 3, "m": 4}
    assert text.check_sidecar(graph.symmetric(text.read_edges(spark, str(f))), side) == {"m": (4, 3)}


def test_hierarchy_files(spark, tmp_path):
    (tmp_path / "m.dat").write_text("c0_l1_0\n2\n4\n7\nc0_l1_1\n1\n5\nc0_l2_0\n3\n4\n5\n7\n")
    m = text.read_membership(spark, str(tmp_path / "m.dat"))
    want = [(0, 1, 0, 4), (0, 1, 0, 7), (0, 1, 1, 5), (0, 2, 0, 4), (0, 2, 0, 5), (0, 2, 0, 7)]
    assert rows(m) == want
    text.write_blocks(m, "leaf", str(tmp_path / "out"))
    assert rows(text.read_membership(spark, str(tmp_path / "out"))) == want
    (tmp_path / "r.root").write_text("c0_l2_0\n")
    assert rows(text.read_roots(spark, str(tmp_path / "r.root"))) == [("c0_l2_0", 0, 2, 0)]
    text.write_partition(spark.createDataFrame([(1, 7), (2, 9), (3, 7)], "node long, comm long"), str(tmp_path / "p"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "p")).collect()) == ["1 0", "2 1", "3 0"]


@pytest.mark.parametrize("step", ["2", "100000"])
def test_binary_graph(spark, tmp_path, step):
    a = graph.arcs(spark.createDataFrame([(0, 1, 2.0), (1, 4, 0.5), (0, 4, 1.0)], "src long, dst long, weight double"))
    binary.write_csr(a, str(tmp_path / "g.bin"), str(tmp_path / "g.w"))
    spark.dataSource.register(binary.CsrSource)
    back = spark.read.format("csrgraph").option("path", str(tmp_path / "g.bin")).option("weights", str(tmp_path / "g.w")).option("nodesPerTask", step).load()
    assert rows(back) == rows(a)
    assert rows(binary.read_csr(spark, str(tmp_path / "g.bin")).select("src", "dst")) == rows(a.select("src", "dst"))


def test_positions_and_layouts(spark, tmp_path):
    p = spark.createDataFrame([(0, 1.5, 2.0, 0.1), (1, -1.0, 3.0, 0.2)], "node long, x double, y double, r double")
    binary.write_positions(p, str(tmp_path / "c"))
    assert rows(binary.read_positions(spark, str(tmp_path / "c"))) == rows(p)
    for name in ("l.npy", "l.parquet"):
        binary.write_layout(p.select("node", "x", "y"), str(tmp_path / name))
        assert rows(binary.read_layout(spark, str(tmp_path / name))) == rows(p.select("node", "x", "y"))
    for ext, kind, values in (("src", "<i4", [0]), ("dst", "<i4", [1]), ("ppr", "<f8", [0.5])):
        np.array(values, kind).tofile(tmp_path / f"v.{ext}")
    assert rows(binary.read_ppr(spark, str(tmp_path / "v"))) == [(0, 1, 0.5)]


def test_indexes(spark, tmp_path):
    edges = random_edges(30, 40)
    a = settle(graph.symmetric(edges_df(spark, edges)))
    w = walks.walks(a, graph.nodes(a).select("node", F.lit(200).alias("count")))
    index.save_walks(w, "walks_test", buckets=4)
    stored = index.load_walks(spark, "walks_test")
    assert stored.count() == 6000
    state = settle(push.push(a, ppr.degree_seeds(a, graph.nodes(a).where("node < 3")), 0.2))
    got = dense(index.estimate_from_index(state, stored, 1000), 30)[:3]
    want = dense(ppr.dppr(a, graph.nodes(a).where("node < 3")), 30)[:3]
    assert np.abs(got - want).max() < 0.1 and np.allclose(got.sum(1), want.sum(1))
    member = graph.nodes(a).select("node", F.floor(F.col("node") / 10).cast("long").alias("comm"))
    b = settle(approx.backward_index(a, member, k=200))
    index.save_backward(b, member, str(tmp_path / "b"))
    assert rows(index.load_backward(spark, str(tmp_path / "b"))) == rows(b)
    assert index.load_backward(spark, str(tmp_path / "b"), 0).where("target >= 10").count() == 0
    index.save_dnpr(ppr.dnpr_closed(a), str(tmp_path / "d"))
    assert index.load_dnpr(spark, str(tmp_path / "d")).count() == 30


def test_stream_of_edges(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for batch in ([(0, 1), (1, 0), (2, 2)], [(1, 2), (0, 1)]):
        edges_df(spark, batch).coalesce(1).write.mode("append").parquet(src)
        ingest.follow(spark.readStream.schema("src long, dst long").parquet(src), out, ck).awaitTermination()
    assert rows(ingest.edges_so_far(spark, out).select("src", "dst")) == [(0, 1), (1, 2)]
    ingest.add_batch(edges_df(spark, [(1, 2), (0, 1)]), 1, out)
    assert dict(ingest.degrees(spark, out).collect()) == {0: 1, 1: 2, 2: 1}


def test_command_line(spark, tmp_path, capsys):
    f = tmp_path / "g.txt"
    f.write_text("\n".join(f"{a} {b}" for a, b in EXAMPLE))
    cli.main(["benchmark", "--edges", str(f), "--method", "pivot", "--repeat", "2"])
    cli.main(["benchmark", "--edges", str(f), "--method", "fr", "--mode", "plot", "--out", str(tmp_path / "p.svg")])
    cli.main(["convert", "--edges", str(f), "--out", str(tmp_path / "g.bin")])
    cli.main(["cluster", "--edges", str(f), "--out", str(tmp_path / "h"), "--k", "4"])
    cli.main(["dppr", "--edges", str(f), "--mapping", str(tmp_path / "h/mapping"), "--hierarchy", str(tmp_path / "h/hierarchy"), "--k", "4", "--method", "fora"])
    lines = capsys.readouterr().out.strip().splitlines()
    assert len(lines) == 5 and '"nd"' in lines[0] and '"n": 10' in lines[2] and (tmp_path / "p.svg").read_text().startswith("<svg")
    common = ["dppr", "--edges", str(f), "--mapping", str(tmp_path / "h/mapping"), "--hierarchy", str(tmp_path / "h/hierarchy"), "--k", "4"]
    for method in ("taupush", "fora"):
        cli.main([*common, "--method", method, "--build", str(tmp_path / method)])
        capsys.readouterr()
        cli.main([*common, "--method", method, "--index", str(tmp_path / method), "--hubs", "--sample", "2"])
        found = json.loads(capsys.readouterr().out)["paths"]
        assert len(found) == 2 and all(p["rows"] > 0 and p["hub"] >= 0 for p in found)

import os
import shutil

import duckdb
import pytest

import corpus_pipeline
from lattigraph.llm import quality
from lattigraph.llm.queries import oracle_sql, queries

from .cases import words
from .test_near_dedup import by_hand, variants


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    items = [(i, words(7000 + i, 30)) for i in range(5)]
    good = [(i, words(i, 90)) for i in range(150)] + [(150 + i, t) for i, t in enumerate(variants(30, 30, 90, 1))]
    leaks = [(200 + i, words(i + 400, 40) + " " + t + " " + words(i + 500, 40)) for i, t in items]
    junk = [(300 + i, "### ".join(words(i + 600, 90).upper().split())) for i in range(60)]
    rows = good + leaks + junk
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 300), 0) for i, _ in rows[::2]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    yield str(d), rows
    shutil.rmtree(d)


def test_run_against_brute_force(spark, tables):
    d, rows = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, model).collect() if r.predicted}
    assert not good & set(range(300, 360)) and len(good & set(range(150))) > 140
    component = {i: c for i, _, c in by_hand([r for r in rows if r[0] in good], percent=80)}
    left = {i for i, c in component.items() if i == c and not 200 <= i < 205}
    pieces = corpus_pipeline.run(spark, d).collect()
    assert {p.doc_id for p in pieces} == left
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


def test_stages(spark, tables):
    d, _ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), d).columns == docs.columns
        assert stage(spark, docs, d).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), d).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries()[name](spark, sf)
    want = con.execute(oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11)) and set(oracle_sql()) <= set(queries())

import zlib

import numpy as np
import pytest

from lattigraph.llm import quality

from .cases import awkward, frame, words


def test_risk_learns_from_positives_and_unlabelled():
    r = np.random.default_rng(0)
    good, bad = r.normal(0.5, 0.5, (600, quality.SIZE)), r.normal(-0.5, 0.5, (150, quality.SIZE))
    model = quality.fit(good[:200].astype(np.float32), np.vstack([good[200:], bad[:100]]).astype(np.float32), 0.8)
    assert model.score(good).min() > 0.5 > model.score(bad[100:]).max()


@pytest.mark.parametrize("mean", [1.0, -1.0])
def test_gradient_of_the_risk(mean):
    """Against differences, on both sides of the sign change; the terms by their definition."""
    r = np.random.default_rng(4)
    p, u, w, b, prior = r.normal(mean, 1, (40, 6)), r.normal(-mean, 1, (70, 6)), np.full(6, 0.3), 0.1, 0.6
    positive, negative, grad = quality.risk(p, u, w, b, prior)
    loss = lambda z: np.log1p(np.exp(-z)).mean()
    assert positive == pytest.approx(prior * loss(p @ w + b)) and negative == pytest.approx(loss(-(u @ w + b)) - prior * loss(-(p @ w + b)))
    assert (negative < 0) == (mean > 0)

    def value(v):
        a, n, _ = quality.risk(p, u, v[:-1], v[-1], prior)
        return a + n if negative >= 0 else -n

    at = np.append(w, b)
    for i in range(7):
        step = np.eye(7)[i] * 1e-5
        assert grad[i] == pytest.approx((value(at + step) - value(at - step)) / 2e-5, abs=1e-5)


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.85])
def test_prior_from_positives_and_unlabelled(prior):
    r = np.random.default_rng(5)
    good, bad = r.normal(0.25, 0.5, (4000, quality.SIZE)), r.normal(-0.25, 0.5, (4000, quality.SIZE))
    n = int(4000 * prior)
    mixed = np.vstack([good[:n], bad[: 4000 - n]])[r.permutation(4000)]
    fresh = r.normal(0.25, 0.5, (2000, quality.SIZE))
    assert quality.estimate_prior(fresh.astype(np.float32), mixed.astype(np.float32)) == pytest.approx(prior, abs=0.05)


def test_scores_by_hand():
    model = quality.Model(np.arange(quality.SIZE) / 300, -0.4, np.full(quality.SIZE, 0.01), np.full(quality.SIZE, 2.0))
    x = quality.features("Some words.")
    z = sum((x[i] - 0.01) / 2 * i / 300 for i in range(quality.SIZE)) - 0.4
    assert model.score(x[None])[0] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-5)
    raw = b"Some words."
    assert x[ord("o")] == pytest.approx((raw.count(b"o") / (len(raw) + quality.SMOOTH)) ** 0.5)


def test_repeated_ids_are_gathered_once(spark):
    """However many rows an id has, one text of it is learnt from."""
    rows = [(i, words(i, 40)) for i in range(40)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)], "doc_id long, quality int, toxic int")
    once, often = quality.train(frame(spark, rows), labels), quality.train(frame(spark, rows + rows[:6] * 50), labels)
    assert np.allclose(once.weights, often.weights) and once.bias == often.bias


def test_end_to_end(spark):
    good = [(i, words(i, 80)) for i in range(0, 240)]
    junk = [(i, "!! ".join(words(i, 80).upper().split())) for i in range(240, 300)]
    rows = good + junk + [(i and i + 1000, t) for i, t in awkward()]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i < 240), 0) for i in range(0, 300, 2)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    out = quality.score(docs, model).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    right = [r.predicted == int(r.doc_id < 240) for r in out if r.doc_id is not None and 0 <= r.doc_id < 300 and r.held_out]
    assert len(right) > 30 and np.mean(right) > 0.95
    empty = {r.score for r in out if r.doc_id in (1002, 1003)}
    assert len(empty) == 1
    kept = quality.filter_quality(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in out)
    assert quality.score(frame(spark, []), model).count() == 0


def test_ids_labels_and_sources_are_no_features(spark):
    docs = frame(spark, [(i, words(i, 50)) for i in range(60)])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    moved = docs.selectExpr("doc_id + 7000 as doc_id", "text", "'xx' as lang", "'other' as source")
    a = sorted(r.score for r in quality.score(docs, model).collect())
    assert a == sorted(r.score for r in quality.score(moved, model).collect())


def test_nothing_to_learn_from(spark):
    docs = frame(spark, awkward())
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {round(r.score, 6) for r in quality.score(docs, model).collect()} == {0.5}


def test_features_cover_the_whole_text():
    a = words(1, 5000)
    assert not np.allclose(quality.features(a), quality.features(a + " " + "###" * 3000))
    assert quality.features(None).sum() == 0 == quality.features("").sum()
    assert quality.features("a") is not None and quality.features("\ud800 x") is not None


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in quality.op4_quality_classifier(spark, sf).collect()}
    known = [(out[r.doc_id], r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [(r.predicted, q) for r, q in known if r.held_out]
    assert np.mean([p == q for p, q in held]) > 0.95

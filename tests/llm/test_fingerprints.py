import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattigraph.llm import fingerprints as fp

from .cases import awkward, frame, words


def weighted_terms(text):
    w = text.lower().split()
    return collections.Counter(zip(w, w[1:] + [None]))


def jaccard(a, b):
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / max(1, sum(max(a[k], b[k]) for k in keys))


def test_awkward_rows(spark):
    rows = awkward()
    got = fp.fingerprints(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    prints = {}
    for r in got:
        if r.doc_id in (1, 5, 6):
            prints.setdefault(r.doc_id if r.doc_id == 6 else 1, set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert {r.fingerprint for r in got if r.doc_id in (2, 3, 4)} == {""}
    assert fp.fingerprints(frame(spark, [])).count() == 0
    alone = fp.fingerprints(frame(spark, [(1, "abcd efgh")])).first()
    assert alone.near_next == 1 and alone.edited_sha256 == hashlib.sha256(b"abcd efab").hexdigest()


def test_edits_and_likeness(spark):
    rows = [(i * 3, words(i, 30 + 5 * i, 60)) for i in range(40)] + [(200, ""), (201, "é𝒳ü")]
    got = {r.doc_id: r for r in fp.fingerprints(frame(spark, rows)).collect()}
    error = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        error.append(r.near_edited - (jaccard(weighted_terms(t), weighted_terms(edited)) if t else 1))
    assert abs(np.mean(error)) < 0.03 and np.abs(error).mean() < 0.1


def signed(spark, pairs, samples=fp.SAMPLES):
    """The likeness of each pair of texts."""
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i long, a string, b string").repartition(4)
    got = fp.signatures(df, ["i"], {"a": "pa", "b": "pb"}, samples).select("i", fp.likeness(F.col("pa"), F.col("pb")).alias("near")).collect()
    return [r.near for r in sorted(got)]


@pytest.mark.parametrize("size, kinds", [(300, 50), (400, 40), (2000, 30), (200, 2), (60, 1000)])
def test_collision_rate_is_the_generalised_jaccard(spark, size, kinds):
    """Unbiased over flat and skewed weights, with the variance of independent samples."""
    pairs, zipf = [], 1 / np.arange(1, kinds + 1)
    for s in range(240):
        r = np.random.default_rng(s)
        base = r.choice(kinds, size, p=zipf / zipf.sum())
        other = np.where(r.random(size) < s / 240, r.integers(0, kinds, size), base)
        pairs.append((" ".join(f"w{s}x{x}" for x in base), " ".join(f"w{s}x{x}" for x in other)))
    truth = np.array([jaccard(weighted_terms(a), weighted_terms(b)) for a, b in pairs])
    error = np.array(signed(spark, pairs, 96)) - truth
    spread = (truth * (1 - truth) / 96).mean() ** 0.5
    assert abs(error.mean()) < max(0.006, 3 * spread / len(error) ** 0.5)
    assert (error**2).mean() ** 0.5 < 1.15 * spread + 0.004


def test_samples_by_hand(spark):
    """Every weight and text gets the sample that the formulas give."""
    texts = ["a a a a b a b", "x", "one two three two three"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.i: r.p for r in fp.signatures(df, ["i"], {"t": "p"}, 16).collect()}
    mask, u64 = (1 << fp.CODE) - 1, lambda v: v & (2**64 - 1)
    for i, text in enumerate(texts):
        best = [None] * 16
        for term, n in weighted_terms(text).items():
            words_ = [spark.range(1).select(F.xxhash64(F.lit(w))).first()[0] for w in term if w is not None]
            if term[1] is None:
                words_.append(None)
            h = spark.range(1).select(F.xxhash64(F.lit(words_[0]).cast("long"), F.lit(words_[1]).cast("long"))).first()[0]
            drawn = spark.range(1).select(*(F.xxhash64(F.lit(h).cast("long"), F.lit(j)) for j in range(32))).first()
            for j in range(16):
                one, two = u64(drawn[2 * j]), u64(drawn[2 * j + 1])
                r = -np.log(((one >> 40) + 0.5) / 2**24 * (((one >> 16) & 0xFFFFFF) + 0.5) / 2**24)
                beta = ((one & 0xFFFF) + 0.5) / 2**16
                c = -np.log(((two >> 32) + 0.5) / 2**32 * ((two & 0xFFFFFFFF) + 0.5) / 2**32)
                t = int(np.floor(np.log(n) / r + beta))
                a = c / (np.exp(r * (t - beta)) * np.exp(r))
                if best[j] is None or a < best[j][0]:
                    best[j] = (a, (h ^ (t * 40503)) & mask)
        assert got[i] == [b[1] for b in best]


def test_the_plan_has_no_python(spark):
    plan = fp.fingerprints(frame(spark, awkward()[:4]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

import re

import numpy as np
import pytest

from lattigraph.llm import near_dedup as nd
from lattigraph.llm.components import components

from .cases import awkward, frame, words


def set_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return ({tuple(w)} if w else set()) if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def by_hand(rows, percent=85):
    """(doc_id, n_shingles, component_id) by all pairs; rows have ids."""
    sets = [set_of(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    low = {x: min(r[0] for r, y in zip(rows, label) if x == y) for x in set(label)}
    return sorted((r[0], len(s), low[x] if s else r[0]) for r, s, x in zip(rows, sets, label))


def variants(seed, n, length=146, edits=4):
    """Near copies of one text, most of them close to the threshold."""
    r = np.random.default_rng(seed)
    base = words(seed, length).split()
    out = []
    for _ in range(n):
        w = list(base)
        for k in r.choice(length, r.integers(0, edits + 1), replace=False):
            w[k] = f"edit{r.integers(10**6)}"
        out.append(" ".join(w))
    return out


def test_groups_against_all_pairs(spark):
    rows = [r for r in awkward() if r[0] is not None and r[0] != 6] + [(6, awkward()[5][1])]
    texts = variants(20, 60) + variants(21, 40, 80, 3) + [words(s, 60) for s in range(100, 140)]
    rows += [(1000 + i, t) for i, t in enumerate(texts)]
    got = nd.link(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == by_hand(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("percent", [80, 95])
def test_other_thresholds(spark, percent):
    rows = [(i, t) for i, t in enumerate(variants(25, 50, 100, 5))]
    got = nd.link(frame(spark, rows), percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == by_hand(rows, percent)


def test_awkward_rows(spark):
    got = nd.link(frame(spark, awkward())).collect()
    assert len(got) == len(awkward())
    alone = [r for r in got if r.n_shingles == 0]
    assert {r.doc_id for r in alone} == {2, 3, 4, None} and all(r.component_id == r.doc_id and r.kept for r in alone)
    assert {(r.component_id, r.kept) for r in got if r.doc_id == 6} == {(6, True)}
    assert {r.component_id for r in got if r.doc_id in (1, 5, 9)} == {1}
    assert nd.link(frame(spark, [])).count() == 0


def test_deduplicate_keeps_one_of_each_group_and_all_columns(spark):
    df = frame(spark, awkward())
    out = nd.deduplicate(df)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == df.columns
    assert sorted(i for i in ids if i is not None) == [-12, 1, 2, 3, 4, 6, 7, 8, 10, 13]
    assert ids.count(None) == 2


def test_deduplicate_tells_repeated_and_null_ids_apart(spark):
    a, b, c, d = (words(300 + i, 80) for i in range(4))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, d), (3, d), (None, a), (None, words(400, 80)), (None, words(400, 80)), (None, "")]
    got = [(r.doc_id, r.text) for r in nd.deduplicate(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted([(1, a), (2, b), (3, c), (3, d), (None, words(400, 80)), (None, "")], key=repr)


def test_deduplicate_loses_no_group_where_ids_are_repeated(spark):
    """The smallest id of a group may be that of another text, too."""
    b = words(900, 146)
    rows = [(1, words(901, 146)), (2, words(901, 146)), (2, b), (3, variants(900, 2)[1]), (4, words(902, 90)), (4, words(903, 90))]
    rows[3] = (3, b + " tail")
    got = sorted((r.doc_id, r.text) for r in nd.deduplicate(frame(spark, rows)).collect())
    assert got == sorted([rows[0], rows[2], rows[4], rows[5]])


def test_deduplicate_takes_columns_of_any_name(spark):
    df = frame(spark, [(1, words(5, 50)), (2, words(5, 50)), (2, words(6, 50))])
    for name in ("gone", "again", "k1", "k2", "comp", "named", "hub"):
        df = df.withColumnRenamed("part", name).withColumn("part", df["row"]) if name == "gone" else df.withColumn(name, df["row"])
    out = nd.deduplicate(df)
    assert out.columns == df.columns and sorted((r.doc_id, r.text) for r in out.collect()) == sorted([(1, words(5, 50)), (2, words(6, 50))])


def test_a_hub_of_many_near_copies(spark):
    """Thousands of texts near one: their pairs are dealt over blocks."""
    base, same = words(40, 200).split(), words(41, 90)
    rows = [(i, " ".join([*base[:-1], f"last{i}"])) for i in range(3000)] + [(5000 + i, same) for i in range(3000)]
    got = nd.link(frame(spark, rows)).groupBy("component_id").count().collect()
    assert {(r.component_id, r["count"]) for r in got} == {(0, 3000), (5000, 3000)}


def test_equal_short_keys_are_told_apart(spark):
    whole = nd._key(nd.shingle_set("one two three"))
    assert len(whole) == 2 and whole[0] != whole[1]


def test_components_after_late_links(spark):
    comps = spark.createDataFrame([(2, 1), (3, 1), (5, 4), (7, 6)], "key long, comp long")
    late = spark.createDataFrame([(3, 5), (8, 7), (9, 10)], "a long, b long")
    assert dict(nd._joined(comps, late).collect()) == {2: 1, 3: 1, 5: 1, 4: 1, 7: 6, 8: 6, 10: 9}


def test_bands_reach_the_threshold():
    missed = total = 0
    for a, b in zip(variants(50, 150, 400, 6), variants(50, 300, 400, 6)[150:]):
        x, y = nd.shingle_set(a), nd.shingle_set(b)
        both = len(np.intersect1d(x, y))
        if 100 * both >= 85 * (len(x) + len(y) - both):
            total += 1
            missed += not (nd.band_keys(nd.minhash(x)) == nd.band_keys(nd.minhash(y))).any()
    assert total > 30 and missed == 0


def test_sketches():
    popcount = lambda a, b: sum(bin(int(v) & (2**64 - 1)).count("1") for v in a ^ b)
    for a, b in zip(variants(7, 40), variants(8, 20) + variants(7, 60)[40:]):
        x, y = nd.shingle_set(a), nd.shingle_set(b)
        both = len(np.intersect1d(x, y))
        assert popcount(nd.parity(x), nd.parity(y)) <= len(x) + len(y) - 2 * both
        if both >= 0.85 * (len(x) + len(y) - both):
            assert popcount(nd.odd_sketch(nd.minhash(x)), nd.odd_sketch(nd.minhash(y))) <= nd.sketch_limit()
    far = popcount(nd.odd_sketch(nd.minhash(nd.shingle_set(words(1, 300)))), nd.odd_sketch(nd.minhash(nd.shingle_set(words(2, 300)))))
    assert far > nd.sketch_limit()


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 50), (60, 50), (7, 7)], "a long, b long")
    assert dict(components(edges).collect()) == {**{i: 0 for i in range(1, 21)}, 60: 50, 100: 50}

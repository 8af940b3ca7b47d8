import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattigraph.llm import decontamination as dc

from .cases import awkward, frame, words


def edit_fit(pattern, text):
    """The smallest edit distance of ``pattern`` to any run of ``text``, by the table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=12), st.lists(st.integers(0, 4), max_size=25))
def test_bit_vector_search(pattern, text):
    d, end = dc.fit_distance(pattern, text)
    assert d == edit_fit(pattern, text) and 0 <= end <= len(text)


def edited(text, edits, seed):
    r, w = np.random.default_rng(seed), text.split()
    for _ in range(edits):
        k = int(r.integers(len(w)))
        kind = int(r.integers(3))
        w[k : k + (kind > 0)] = ["zz" + str(r.integers(1000))] * (kind < 2)
    return " ".join(w)


def planted(share, seed=0):
    """Items, and documents that hold an edited item between other words."""
    items = [(i, words(500 + i, 16 + i)) for i in range(40)]
    rows = [(i, words(900 + i, 80) + " " + edited(t, int(share * len(t.split())), seed + i) + " " + words(1900 + i, 80)) for i, t in items]
    return items, rows


@pytest.mark.parametrize("share", [0.0, 0.1, 0.2])
def test_recall_against_brute_force(share):
    items, rows = planted(share)
    index = dc.LeakIndex(items)
    found = index.search([t for _, t in rows])
    want = hit = 0
    for (i, t), got in zip(rows, found):
        have = {g[0]: g[2] for g in got}
        for item, text in items:
            d = edit_fit(text.split(), t.split())
            if d <= int(0.2 * len(text.split()) + 1e-9):
                want += 1
                hit += have.get(item) == d
            else:
                assert item not in have
    assert want > 20 and hit == want


@pytest.mark.parametrize("deletions", [False, True])
@pytest.mark.parametrize("size", [5, 9, 16, 20, 24, 25, 40, 80, 200, 300])
def test_recall_at_the_largest_distance(size, deletions):
    """Every item is planted once with all the edits it may have."""
    items, hit, want = [(i, words(100 * size + i, size)) for i in range(40)], 0, 0
    index = dc.LeakIndex(items)
    rows = []
    for i, text in items:
        w, k = text.split(), int(0.2 * size)
        left = " ".join(w[j] for j in sorted(np.random.default_rng(size + i).permutation(size)[k:])) if deletions else edited(text, k, size + i)
        rows.append(words(7000 + i, 20) + " " + left + " " + words(8000 + i, 20))
    for (i, text), row, got in zip(items, rows, index.search(rows)):
        d = dc.fit_distance(text.split(), row.split())[0]
        if d <= int(0.2 * size):
            want += 1
            hit += {g[0]: g[2] for g in got}.get(i) == d
    assert want > 35 and hit >= 0.99 * want


def test_more_walks_for_more_edits():
    need = [dc.walks_needed(24, k, dc.RECALL, dc.SAMPLED, 11) for k in range(5)]
    assert need[0] == 1 and need == sorted(need) and need[-1] < dc.MOST_WALKS


def test_only_shared_buckets_propose():
    items, rows = planted(0.2, 5)
    index = dc.LeakIndex(items, recall=0.3)  # fewer walks: leaks are lost, so buckets decide what is looked at
    full = dc.LeakIndex(items)
    texts = [t for _, t in rows]
    assert sum(map(len, index.search(texts))) < sum(map(len, full.search(texts)))


def test_where_a_leak_lies():
    item = words(1, 30)
    [[got]] = dc.LeakIndex([(1, item)]).search([words(2, 50) + " " + item + " " + words(3, 50)])
    assert got[4:] == (50, 79)


def test_blocks_are_held_one_at_a_time(spark):
    items, rows = planted(0.1)
    bench = spark.createDataFrame(items + items[:2], "item_id long, text string")
    got = dc.leaks(frame(spark, rows), bench, block_bytes=800).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted([(i, i) for i, _ in items] + [(0, 0), (1, 1)])


@pytest.mark.parametrize("deletions", [False, True])
@pytest.mark.parametrize("size", [30, 100, 400, 1000])
def test_no_leak_is_lost_at_any_length(size, deletions):
    items = [(i, words(100 * size + i, size)) for i in range(8)]
    rows = []
    for i, text in items:
        w, k = text.split(), int(0.2 * size)
        if deletions:
            w = [w[j] for j in sorted(np.random.default_rng(size + i).permutation(size)[k:])]
        rows.append(words(7000 + i, 40) + " " + (" ".join(w) if deletions else edited(text, k, size + i)) + " " + words(8000 + i, 40))
    found = dc.LeakIndex(items).search(rows)
    for (i, text), row, got in zip(items, rows, found):
        assert {g[0]: g[2] for g in got}[i] == dc.fit_distance(text.split(), row.split())[0] <= 0.2 * size


def test_a_leak_is_reported_once_however_many_windows_it_has():
    text = "one two three four " * 30
    found = dc.LeakIndex([(1, text)]).search([text * 200])
    assert len(found[0]) == 1 and found[0][0][2] == 0


def test_leaks_and_filter(spark):
    items, rows = planted(0.1)
    clean = [(10_000 + i, words(5000 + i, 100)) for i in range(40)]
    docs = frame(spark, rows + clean + [(i and i + 20_000, t) for i, t in awkward()])
    bench = spark.createDataFrame(items + [(900, None), (901, ""), (902, "!!"), (None, "one two three four")], "item_id long, text string")
    out = dc.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in out} == {(i, i) for i, _ in items} | {(20_008, None)}
    for r in out:
        assert r.edits <= 0.2 * r.n_words and r.similarity == pytest.approx(1 - r.edits / r.n_words) and r.first_word <= r.last_word
    blocks = dc.leaks(docs, bench, block_bytes=800).collect()
    assert sorted(map(tuple, blocks), key=repr) == sorted(map(tuple, out), key=repr)
    kept = dc.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 41
    assert dc.leaks(frame(spark, []), bench).count() == 0
    assert dc.leaks(docs, bench.limit(0)).count() == 0 and dc.decontaminate(docs, bench.limit(0)).count() == docs.count()

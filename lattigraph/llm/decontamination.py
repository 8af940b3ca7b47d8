"""Benchmark decontamination (operator 3): CGK embeddings and bit-sampling LSH.

A document leaks a benchmark item when some run of its words is within floor(0.2 * L) word edits of the item's L
words (words: runs of letters, digits and underscores, lower case).

1. An item of up to ``PIECE`` words is one piece; a longer one is cut into equal pieces of up to ``PIECE`` words, one
   of which has no more than its share of the item's edits. Any piece that is found proposes its item.
2. Documents are read as piece-sized windows. A window is embedded only if it may hold a piece: enough of its words are
   words of some item, and some run of them (``RUN`` words at most, by the pigeonhole principle unchanged) is a run of
   some piece. This gate knows no items and loses no leak.
3. Pieces and windows are embedded by CGK random walks: reading position i of the string at step j, the symbol is
   written out and a random bit of (j, symbol) says whether i moves on. Strings at a small edit distance get embeddings at
   a small Hamming distance. Every walk gives one hash table; ``sampled`` random positions of the embedding are the
   key. A window is compared only with the pieces it meets in a bucket. The number of walks is worked out for each
   size of pieces and their edits, so that simulated pieces at the largest distance meet with the probability ``recall``.
4. Items proposed near one place are confirmed by the exact edit distance of the whole item to the best run of words
   there (Myers' bit-vector search); places that lack too many of its words need no search.

The benchmark's index goes to the tasks in blocks of at most ``block_bytes`` of text, each broadcast on its own; neither
driver nor tasks hold more than a block at once, however large the benchmark is. Documents are read once.

Defined results: null and empty texts leak nothing and null or wordless items are in no document; repeated
document rows are reported each, repeated items likewise; an empty table on either side yields no leaks; other
columns are not read. ``decontaminate`` keeps the input's columns.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, table

SIMILARITY = 0.8
RECALL, SAMPLED, MOST_WALKS = 0.999, 3, 256
PIECE, RUN = 24, 4
BLOCK_BYTES = 4 << 20
#: Windows that are embedded at once, and proposals that are gathered before they are confirmed.
WINDOWS, PROPOSALS = 4096, 200_000
_WORD = re.compile(r"\w+")
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD1342543DE82EF95)


class _Numbers(dict):
    """Words to numbers; 0 for words of no item."""

    def __missing__(self, key):
        return 0


def fit_distance(pattern: list[int], text: list[int], anchored: bool = False) -> tuple[int, int]:
    """The smallest edit distance of the whole ``pattern`` to a run of ``text``, and where the first such run ends.
    An ``anchored`` run begins where the text does."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[int, int] = {}
    for i, s in enumerate(pattern):
        peq[s] = peq.get(s, 0) | 1 << i
    vp, vn, d = full, 0, m
    best, end = m, 0
    for j, s in enumerate(text, 1):
        x = peq.get(s, 0) | vn
        d0 = ((((x & vp) + vp) ^ vp) | x) & full
        hn, hp = vp & d0, (vn | ~(vp | d0)) & full
        d += bool(hp & top) - bool(hn & top)
        x = (hp << 1 | anchored) & full
        vn, vp = x & d0, ((hn << 1) | ~(x | d0)) & full
        if d < best:
            best, end = d, j
    return best, end


def embed(strings: np.ndarray, walks: int, sampled: int, seed: int) -> np.ndarray:
    """The keys (strings x walks) of the rows of ``strings``: of each walk's embedding the symbols at ``sampled`` steps.
    Steps lie in 0 .. 2m-1, where a walk is mostly still inside the string."""
    n, m = strings.shape
    walk = np.arange(1, walks + 1, dtype=np.uint64) * _Q + np.uint64(seed)
    draws = mix64(walk[:, None] + np.arange(1, sampled + 1, dtype=np.uint64)[None] * _P)
    steps = (draws % np.uint64(2 * m)).astype(np.int64)
    keys = np.repeat(mix64(walk)[None], n, axis=0)
    at, rows = np.zeros((n, walks), np.int64), np.arange(n)[:, None]
    padded = np.concatenate([strings, np.zeros((n, 1), np.uint64)], axis=1)
    for j in range(2 * m):
        symbol = padded[rows, at]
        drawn = np.flatnonzero((steps == j).any(axis=1))
        if len(drawn):
            keys[:, drawn] = mix64(keys[:, drawn] * _P + symbol[:, drawn])
        move = (mix64(symbol * _P + walk[None] + np.uint64(j * 0xDA942042E4DD58B5 % 2**64)) >> np.uint64(63)).astype(np.int64)
        at = np.minimum(at + move, m)
    return keys


@functools.cache
def walks_needed(m: int, edits: int, recall: float, sampled: int, seed: int, trials: int = 300) -> int:
    """The number of walks with which strings of ``m`` words at ``edits`` edits share a key with the probability ``recall``, by
    simulation of mixed edits, of deletions and of insertions; the worst of the three counts."""
    r, need = np.random.default_rng((m, edits)), 1
    for kind in ("mixed", "delete", "insert") if edits else ():
        one, two = np.zeros((trials, m), np.uint64), np.zeros((trials, m), np.uint64)
        for i in range(trials):
            words = list(range(1, 2 * m + 1))
            one[i] = words[:m]
            for e in range(edits):
                at = int(r.integers(m))
                what = kind if kind != "mixed" else ("delete", "insert", "replace")[r.integers(3)]
                words[at : at + (what != "insert")] = [] if what == "delete" else [1000 + e]
            two[i] = words[:m]
        # numbers stand for words of any kind: each trial has its own
        own = (np.arange(trials, dtype=np.uint64) << np.uint64(32))[:, None]
        meets = embed(one + own, 128, sampled, seed) == embed(two + own, 128, sampled, seed)
        apart = 1 - meets.mean(axis=1)
        while need < MOST_WALKS and (apart**need).mean() > 1 - recall:
            need += 1
    return need


def _codes(ids: np.ndarray, at: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the runs of ``q`` ids at the places ``at``."""
    h = ids[at]
    for i in range(1, q):
        h = h * _P + ids[at + i]
    return mix64(h)


class _Tables:
    """The hash tables of all pieces of one size and one number of edits."""

    def __init__(self, size: int, edits: int, pieces: list[tuple[int, int, list[int]]], recall: float, sampled: int, seed: int):
        self.size, self.edits, self.sampled, self.seed = size, edits, sampled, seed
        self.run = min(RUN, -(-(size - edits) // (edits + 1)))
        self.walks = walks_needed(size, edits, recall, sampled, seed)
        strings = np.array([p[2] for p in pieces], np.uint64)
        keys = embed(strings, self.walks, sampled, seed)
        order = np.argsort(keys, axis=None, kind="stable")
        flat = keys.ravel()[order]
        self.codes, begin = np.unique(flat, return_index=True)
        self.begin, self.count = begin, np.diff(np.append(begin, len(flat)))
        piece = order // self.walks
        self.item = np.array([p[0] for p in pieces], np.int64)[piece]
        self.offset = np.array([p[1] for p in pieces], np.int64)[piece]
        self.runs = np.unique(np.concatenate([_codes(s, np.arange(size - self.run + 1), self.run) for s in strings]))

    def windows(self, known: np.ndarray, end: np.ndarray, runs: dict[int, tuple], ids: np.ndarray) -> np.ndarray:
        """Where windows begin that may hold a piece. ``end``: for each place the end of its text; ``runs``: places of runs of
        known words and their hashes, by length."""
        total = np.concatenate([[0], np.cumsum(known)])
        if self.run not in runs:
            at = np.flatnonzero(total[self.run :] - total[: -self.run] == self.run)
            runs[self.run] = at, _codes(ids, at, self.run)
        at, codes = runs[self.run]
        hit = at[self.runs[np.minimum(np.searchsorted(self.runs, codes), len(self.runs) - 1)] == codes]
        if not len(hit):
            return hit
        span = self.size + self.edits
        cover = np.zeros(len(known) + 1, np.int64)
        np.add.at(cover, np.maximum(hit - (span - self.run), 0), 1)
        np.add.at(cover, hit + 1, -1)
        start = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        return start[total[np.minimum(start + span, end[start])] - total[start] >= self.size - self.edits]

    def proposals(self, ids: np.ndarray, doc: np.ndarray, end: np.ndarray, start: np.ndarray) -> Iterator[np.ndarray]:
        """Rows (item, text, place) where a window shares a bucket with a piece; place: where the item would begin."""
        for block in range(0, len(start), WINDOWS):
            some = start[block : block + WINDOWS]
            at = some[:, None] + np.arange(self.size)[None]
            inside = at < end[some][:, None]
            keys = embed(np.where(inside, ids[np.where(inside, at, 0)], np.uint64(0)), self.walks, self.sampled, self.seed)
            place = np.minimum(np.searchsorted(self.codes, keys), len(self.codes) - 1)
            row, walk = np.nonzero(self.codes[place] == keys)
            place = place[row, walk]
            count = self.count[place]
            low = 0
            while low < len(place):  # so many buckets that their entries are few enough, one at least
                high = max(low + 1, int(np.searchsorted(np.cumsum(count[low:]), PROPOSALS, side="right")) + low)
                c = count[low:high]
                which = np.repeat(self.begin[place[low:high]], c) + np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
                at = np.repeat(some[row[low:high]], c)
                yield np.unique(np.stack([self.item[which], doc[at], at - self.offset[which]], axis=1), axis=0)
                low = high


class LeakIndex:
    """A block of benchmark items, ready to search texts."""

    def __init__(self, items: list[tuple], similarity: float = SIMILARITY, recall: float = RECALL, sampled: int = SAMPLED, seed: int = 11):
        self.numbers, self.items = _Numbers(), []
        classes: dict[tuple[int, int], list] = {}
        for item_id, text in items:
            words = _WORD.findall((text or "").lower())
            if not words:
                continue
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            most, parts = int(len(ids) * (1 - similarity) + 1e-9), -(-len(ids) // PIECE)
            cuts = [len(ids) * p // parts for p in range(parts + 1)]
            for a, b in zip(cuts, cuts[1:]):
                classes.setdefault((b - a, most // parts), []).append((len(self.items), a, ids[a:b]))
            self.items.append((item_id, ids, most, Counter(ids)))
        self.tables = [_Tables(m, k, pieces, recall, sampled, seed) for (m, k), pieces in sorted(classes.items())]

    def search(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text the leaks (item_id, n_words, edits, similarity, first_word, last_word)."""
        found: list[list[tuple]] = [[] for _ in texts]
        if not self.items:
            return found
        words = [_WORD.findall(t.lower()) if t else [] for t in texts]
        n = np.array([len(w) for w in words], np.int64)
        lo = np.cumsum(n + 1) - (n + 1)  # a zero parts neighbours
        ids = np.zeros(int((n + 1).sum()), np.uint64)
        for w, at in zip(words, lo):
            ids[at : at + len(w)] = np.fromiter(map(self.numbers.__getitem__, w), np.uint64, len(w))
        known, doc = ids != 0, np.repeat(np.arange(len(texts)), n + 1)
        end, runs = (lo + n)[doc], {}
        best: dict[tuple[int, int], tuple] = {}
        gathered, total = [], 0
        for tables in self.tables:
            for some in tables.proposals(ids, doc, end, tables.windows(known, end, runs, ids)):
                gathered.append(some)
                total += len(some)
                if total > PROPOSALS:
                    self._confirm(ids, lo, n, gathered, best)
                    gathered, total = [], 0
        self._confirm(ids, lo, n, gathered, best)
        for (doc, item), (edits, first, last) in sorted(best.items()):
            item_id, pattern, _, _ = self.items[item]
            found[doc].append((item_id, len(pattern), edits, 1 - edits / len(pattern), first, last))
        return found

    def _confirm(self, ids, lo, n, gathered: list[np.ndarray], best: dict) -> None:
        """Look for the proposed items in the words around where they would begin; places that overlap are looked at once."""
        if not gathered:
            return
        item, doc, place = np.unique(np.concatenate(gathered), axis=0).T.tolist()
        at = 0
        while at < len(item):
            i, d = item[at], doc[at]
            _, pattern, most, bag = self.items[i]
            first, last = place[at] - most - 2, place[at]
            while at < len(item) and item[at] == i and doc[at] == d and place[at] - most - 2 <= last + len(pattern) + most + 2:
                last = place[at]
                at += 1
            begin, stop = max(first, int(lo[d])), min(last + len(pattern) + most + 2, int(lo[d] + n[d]))
            text = ids[begin:stop].tolist()
            if (bag - Counter(text)).total() > most:
                continue
            edits, size = fit_distance(pattern, text)
            if edits <= most:
                back = fit_distance(pattern[::-1], text[:size][::-1], anchored=True)[1]
                row = (edits, begin + size - back - int(lo[d]), begin + size - 1 - int(lo[d]))
                best[d, i] = min(best.get((d, i), row), row)


def _blocks(benchmark: DataFrame, block_bytes: int, **how) -> Iterator:
    """The benchmark as broadcast indexes of a bounded size each, with the number of rows that each item stands for."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // block_bytes))
    for part in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).groupBy("item_id", "text").agg(F.count("*").alias("times"))
        rows = sorted(((r.item_id, r.text, r.times) for r in mine.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        yield benchmark.sparkSession.sparkContext.broadcast(LeakIndex([((i, times), text) for i, text, times in rows], **how))


def _searched(indexes: list, texts: pa.Array) -> list[list[tuple]]:
    """For each text the leaks of all blocks; a task holds one block at a time."""
    found: list[list[tuple]] = [[] for _ in range(len(texts))]
    for index in indexes:
        for at in range(0, len(texts), 256):
            for i, rows in enumerate(index.value.search(texts.slice(at, 256).to_pylist()), at):
                found[i].extend((item, *x) for (item, times), *x in rows for _ in range(times))
        if len(indexes) > 1:
            index.__dict__.pop("_value", None)  # it is read again from the task's disk
    return found


def leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, **how) -> DataFrame:
    """A row for each document and item it leaks."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    indexes = list(_blocks(benchmark, block_bytes, **how))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.float64()] + [pa.int64()] * 2
        for batch in batches:
            rows = [(d, *x) for d, r in zip(batch.column(0).to_pylist(), _searched(indexes, batch.column(1))) for x in r]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "item_id", "n_words", "edits", "similarity", "first_word", "last_word"])

    return text.mapInArrow(work, "doc_id long, item_id long, n_words long, edits long, similarity double, first_word long, last_word long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, **how) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns."""
    place = docs.columns.index("text")
    indexes = list(_blocks(benchmark, block_bytes, **how))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not r for r in _searched(indexes, batch.column(place).cast(pa.string()))], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of ``benchmark`` in ``documents``."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

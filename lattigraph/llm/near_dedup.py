"""MinHash near-dedup with odd sketches (operator 8).

A document's set: the distinct five-word shingles of its text (A-Z lowered, words apart by ASCII white space);
with fewer words the whole sequence; nothing without words. Documents are linked when 100 * |A n B| >= 85 *
|A u B|, and a group is a connected component of links.

1. Each text gives 128 MinHash samples. 25 bands of 5 samples propose pairs (a pair at 0.85 is missed with
   probability (1 - 0.85^5)^25 = 4e-7). The samples are also folded into an odd sketch of 512 parity bits: the
   population count of two sketches' XOR estimates their similarity closely where it is high, and pairs
   whose count lies beyond five standard deviations of what 0.85 gives are not looked at further. A second odd
   sketch holds the whole set: sets differ in at least as many elements as these sketches differ in bits, so
   this bound never refuses a link.
2. Documents with equal sets (equal 128-bit hashes of all their elements) are one node. In each bucket every node is paired
   with the bucket's smallest and largest node only; pairs are confirmed on the full sets of their texts. A node that many pairs
   share (a hub) is dealt over blocks of ``BLOCK`` pairs, and its text goes to each block once.
3. That compares all pairs in buckets of up to three nodes. Nodes in larger buckets that still hold several components
   are compared across components: prefix filtering on their full sets proposes every pair that can reach
   0.85, and these are confirmed as well. Pairs inside a component cannot change the result, so nothing is lost and no
   group is expanded into all its pairs.
4. Components come from alternating star steps; later links join the components found before. Every intermediate is a
   written table, removed when nothing reads it any more.

Shingles are compared by 64-bit hashes.

Defined results: null and empty texts have ``n_shingles`` 0 and their own component; equal rows with one id
share its result; a row with a null id is linked with equal sets only, and is kept only if its component has
no id; an empty table yields no rows; other columns are not read. ``deduplicate`` keeps the input's columns and one row
of each group.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from .common import drop, fresh, mix64, staged, table
from .components import components

WORDS = 5
PERCENT = 85
BANDS, ROWS, SAMPLES = 25, 5, 128
BITS = 512
#: Pairs of one hub that share its text, and parts over which a bucket is dealt where its ends are joined to its nodes.
BLOCK, PARTS = 128, 8
_P = np.uint64(0x9E3779B97F4A7C15)
_SALTS = mix64(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_FACTORS = mix64(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0xDA942042E4DD58B5)) | np.uint64(1)
_NUMBERS = mix64(np.arange(SAMPLES, dtype=np.uint64) + np.uint64(77))


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted 64-bit hashes of the text's set."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    if n < WORDS:
        h = np.uint64(n)
        with np.errstate(over="ignore"):
            for x in w:
                h = h * _P + x
            return mix64(np.array([h ^ np.uint64(0x5851F42D4C957F2D)]))
    h = w[: n - WORDS + 1].copy()
    for i in range(1, WORDS):
        h *= _P
        h += w[i : n - WORDS + 1 + i]
    return np.unique(mix64(h))


def minhash(hashes: np.ndarray) -> np.ndarray:
    """The samples of a non-empty set."""
    out = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(out, ((hashes[None, at : at + 2048] ^ _SALTS[:, None]) * _FACTORS[:, None]).min(axis=1), out=out)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    m = samples[: BANDS * ROWS].reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * _P
    for i in range(ROWS):
        h = h * _P + m[:, i]
    return mix64(h).view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """The parity bitmap of the numbered samples, as 64-bit words."""
    return parity(samples ^ _NUMBERS)


def parity(values: np.ndarray) -> np.ndarray:
    """The parity bitmap of a set of hashes, as 64-bit words. Two sets differ in at least as many elements as their
    bitmaps differ in bits."""
    places = (mix64(values) % np.uint64(BITS)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def sketch_limit(percent: int = PERCENT, sigmas: float = 5.0) -> int:
    """The largest XOR population count that a pair at the threshold has, within ``sigmas``."""
    j = percent / 100
    differing = SAMPLES * (1 - j) + sigmas * (SAMPLES * j * (1 - j)) ** 0.5
    return int(BITS * (1 - (1 - 2 / BITS) ** (2 * differing)) / 2) + 2


_LOWS = [f"s{i}" for i in range(BITS // 64)]
_WHOLE = [f"p{i}" for i in range(BITS // 64)]
_BANDS = [f"b{i}" for i in range(BANDS)]


def _key(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    return struct.unpack("<qq", xxh3_128_digest(hashes.tobytes()))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, b0.., s0.., p0..): k1 and k2 name the set and are null for an empty one; bands, the odd
    sketch of the samples and that of the whole set."""
    names = ["doc_id", "n_shingles", "k1", "k2", *_BANDS, *_LOWS, *_WHOLE]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.int64()
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                n, keys, rest = [], [], np.zeros((batch.num_rows, BANDS + 2 * len(_LOWS)), np.int64)
                for i, text in enumerate(batch.column(1).to_pylist()):
                    h = shingle_set(text)
                    n.append(len(h))
                    keys.append(_key(h) if len(h) else (None, None))
                    if len(h):
                        samples = minhash(h)
                        rest[i] = np.concatenate([band_keys(samples), odd_sketch(samples), parity(h)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, kinds), *(pa.array([k[i] for k in keys], kinds) for i in (0, 1)), *(pa.array(np.ascontiguousarray(c)) for c in rest.T)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, ", ".join(f"{c} long" for c in names))


def _close(a: str, b: str, limit: int):
    """The bound on two rows' sketches of samples."""
    return _differing(a, b, _LOWS) <= limit


def _differing(a: str, b: str, words: list[str]):
    total = F.lit(0)
    for s in words:
        total = total + F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}")))
    return total


def _may_link(a: str, b: str, percent: int):
    """What sizes and whole-set sketches allow; it never refuses a link."""
    sizes = 100 * F.least(f"{a}.n", f"{b}.n") >= percent * F.greatest(f"{a}.n", f"{b}.n")
    return sizes & ((100 + percent) * _differing(a, b, _WHOLE) <= (100 - percent) * (F.col(f"{a}.n") + F.col(f"{b}.n")))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, text) of one document for each of the ``wanted`` (key, doc_id, k1, k2)."""

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # several rows of one id may hold the set: a task passes one on
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                ok = []
                for key, text, k1, k2 in zip(*(c.to_pylist() for c in some.columns)):
                    ok.append(key not in seen and _key(shingle_set(text)) == (k1, k2))
                    if ok[-1]:
                        seen.add(key)
                yield some.select(["key", "text"]).filter(pa.array(ok, pa.bool_()))

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.join(wanted, "doc_id").select("key", "text", "k1", "k2").mapInArrow(same, "key long, text string")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (hub, other) those whose full sets are similar enough, as (a, b). A hub's pairs are dealt over blocks; its
    text comes once to each, before the others."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                a, b = [], []
                for key, other, text in zip(*(whole.column(i).slice(at, 512).to_pylist() for i in range(3))):
                    x = shingle_set(text)
                    if other is None:
                        hub, own = key, x
                    elif hub == key:
                        both = len(np.intersect1d(own, x, assume_unique=True))
                        if 100 * both >= percent * (len(own) + len(x) - both):
                            a.append(min(key, other))
                            b.append(max(key, other))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    blocks = parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = pairs.join(parts, "hub").select("hub", F.pmod(F.xxhash64("other"), F.col("parts")).cast("int").alias("part"), "other")
    first = blocks.join(texts.select(F.col("key").alias("hub"), "text"), "hub").select("hub", F.lit(None).cast("long").alias("other"), "text", "part")
    rest = dealt.join(texts.select(F.col("key").alias("other"), "text"), "other").select("hub", "other", "text", "part")
    routed = first.unionByName(rest).repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("other").asc_nulls_first())
    return routed.select("hub", "other", "text").mapInArrow(work, "a long, b long").distinct()


def _across(left: DataFrame, texts: DataFrame, known: DataFrame, percent: int) -> tuple[DataFrame, str, list[str]]:
    """Pairs (hub, other) across components among the nodes ``left`` (key, comp, inner, n, p0..), by prefix filtering: a set has
    ceil(percent * n) / 100 elements or more in common with any partner, so partners share one of its first
    n - that + 1 elements in an order from rare to frequent; elements of one set alone come first and count for nothing. ``inner`` nodes belong to the largest component of all
    their buckets, and two of them in different components share no bucket."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                sets = [shingle_set(t) for t in batch.column(4).to_pylist()]
                row = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(row) for i in range(4)), pa.array(np.concatenate(sets).view(np.int64))], ["key", "comp", "inner", "n", "element"])

    elements, path = staged(left.join(texts.dropDuplicates(["key"]), "key").select("key", "comp", "inner", "n", "text").mapInArrow(explode, "key long, comp long, inner boolean, n long, element long"), "elements")
    often = elements.groupBy("element").agg(F.count("*").alias("df")).where("df > 1")
    by_rarity = Window.partitionBy("key").orderBy("df", "element")
    need = F.floor((percent * F.col("n") + 99) / 100)
    ranked = elements.join(often, "element").select("key", "comp", "inner", "n", "element", F.row_number().over(by_rarity).alias("rank"), F.count("*").over(Window.partitionBy("key")).alias("common"))
    prefix, prefix_path = staged(ranked.where(F.col("rank") <= F.col("common") - need + 1).join(left.select("key", *_WHOLE), "key"), "prefixes")
    x, y = prefix.where("not inner").alias("x"), prefix.alias("y")
    fits = (F.col("x.comp") != F.col("y.comp")) & (F.col("y.inner") | (F.col("x.key") < F.col("y.key"))) & _may_link("x", "y", percent)
    # at the first element that two sets share, all they have in common is that one and what comes behind it in both
    bound = 1 + F.least(F.col("x.common") - F.col("x.rank"), F.col("y.common") - F.col("y.rank"))
    fits &= (100 + percent) * bound >= percent * (F.col("x.n") + F.col("y.n"))
    met = x.join(y, (F.col("x.element") == F.col("y.element")) & fits).select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()
    more, more_path = staged(met.join(known, ["a", "b"], "left_anti").select(F.col("a").alias("hub"), F.col("b").alias("other")), "pairs")
    return more, more_path, [path, prefix_path]


def _joined(comps: DataFrame, late: DataFrame) -> DataFrame:
    """The components (key, comp) after the links ``late`` (a, b): only the components that these join are looked at."""
    x, y = comps.alias("x"), comps.alias("y")
    ends = late.join(x, F.col("a") == F.col("x.key"), "left").join(y, F.col("b") == F.col("y.key"), "left")
    merged = components(ends.select(F.coalesce("x.comp", "a").alias("a"), F.coalesce("y.comp", "b").alias("b")))
    up = merged.select(F.col("key").alias("_from"), F.col("comp").alias("_to"))
    moved = comps.join(up, F.col("comp") == F.col("_from"), "left").select("key", F.coalesce("_to", "comp").alias("comp"))
    return moved.unionByName(merged)  # what these join are roots, and a root is no key


def _linked(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, k1, k2, comp) for every row of ``docs``; see the module."""
    spark, limit = docs.sparkSession, sketch_limit(percent)
    rows, _ = staged(signatures(docs), "signatures")
    sets = rows.where("k1 is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), *(F.max(c).alias(c) for c in [*_BANDS, *_LOWS, *_WHOLE]))
    # a written row keeps its number
    nodes, nodes_path = staged(sets.withColumn("key", F.monotonically_increasing_id()), "nodes")
    members = nodes.select("key", F.explode(F.array(*_BANDS)).alias("bucket"))
    buckets, buckets_path = staged(members.groupBy("bucket").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("size")).where("lo < hi"), "buckets")
    part = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    shared, shared_path = staged(members.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int")).join(buckets.withColumn("part", part), ["bucket", "part"]).drop("part"), "members")

    sketch = nodes.select("key", "n", *_LOWS, *_WHOLE)
    star = shared.select(F.col("lo").alias("hub"), F.col("key").alias("other")).unionByName(shared.select(F.col("hi").alias("hub"), F.col("key").alias("other"))).where("hub <> other")
    star = star.groupBy(F.least("hub", "other").alias("a"), F.greatest("hub", "other").alias("b")).agg(F.min("hub").alias("hub"))
    likely = star.join(sketch.alias("x"), F.col("a") == F.col("x.key")).join(sketch.alias("y"), (F.col("b") == F.col("y.key")) & _close("x", "y", limit) & _may_link("x", "y", percent))
    pairs, pairs_path = staged(likely.select("a", "b", "hub", F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("other")), "pairs")
    open_buckets = shared.where("size > 3")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("key")).unionByName(open_buckets.select("key")).distinct()
    texts, texts_path = staged(_texts(docs, nodes.select("key", "doc_id", "k1", "k2").join(ids, "key", "left_semi")), "texts")
    edges, edges_path = staged(_confirmed(pairs.select("hub", "other"), texts, percent), "links")
    comps = components(edges)

    # nodes of one larger bucket in several components: all that is left to compare
    placed = open_buckets.select("bucket", "key").join(comps, "key", "left").select("bucket", "key", F.coalesce("comp", "key").alias("comp"))
    counts = placed.groupBy("bucket", "comp").agg(F.count("*").alias("c"))
    largest = counts.groupBy("bucket").agg(F.count("*").alias("comps"), F.max(F.struct("c", "comp"))["comp"].alias("largest")).where("comps > 1")
    salted = placed.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int")).join(largest.withColumn("part", part), ["bucket", "part"])
    left, left_path = staged(salted.groupBy("key").agg(F.min("comp").alias("comp"), F.min(F.col("comp") == F.col("largest")).alias("inner")).join(nodes.select("key", "n", *_WHOLE), "key"), "left")
    drop(spark, buckets_path, shared_path)
    if left.head(1):
        more, more_path, left_paths = _across(left, texts, pairs.select("a", "b"), percent)
        late, late_path = staged(_confirmed(more, texts, percent), "links")
        if late.head(1):
            comps = staged(_joined(comps, late), "components")[0]
        drop(spark, more_path, late_path, *left_paths)
    drop(spark, pairs_path, texts_path, left_path, edges_path)

    named = nodes.select("k1", "k2", "key", "doc_id").join(comps, "key", "left").select("k1", "k2", "doc_id", F.coalesce("comp", "key").alias("comp"))
    smallest = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    final, _ = staged(named.join(smallest, "comp").select("k1", "k2", "comp", "component_id"), "components")
    drop(spark, nodes_path)
    out = rows.select("doc_id", "n_shingles", "k1", "k2").join(final, ["k1", "k2"], "left")
    component = F.when(F.col("k1").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"), "k1", "k2", "comp")


def link(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``."""
    return _linked(docs, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _keyed(docs: DataFrame, k1: str, k2: str) -> DataFrame:
    """``docs`` with the name of each row's set as two more columns."""
    place = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                sets = map(shingle_set, batch.column(place).to_pylist())
                keys = [_key(h) if len(h) else (None, None) for h in sets]
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1))], [*batch.schema.names, k1, k2])

    return docs.mapInArrow(work, StructType([*docs.schema.fields, StructField(k1, LongType()), StructField(k2, LongType())]))


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns. Rows without words stay, one for each
    id that is not null, all those whose id is null. Rows whose id is null or repeated are told apart by id and set."""
    found, _ = staged(_linked(docs, percent), "groups")
    a, b, c, d, e, g = fresh(docs, "gone", "again", "k1", "k2", "comp", "named")
    gone = found.where("not kept and doc_id is not null").select(F.col("doc_id").alias(a)).distinct()
    repeated = found.where("doc_id is not null").groupBy(F.col("doc_id").alias(b)).count().where("count > 1").select(b)
    is_gone, is_again = F.col("doc_id").cast("long") == F.col(a), F.col("doc_id").cast("long") == F.col(b)
    if not repeated.head(1) and not found.where("doc_id is null and k1 is not null").head(1):
        return docs.join(gone, is_gone, "left_anti")
    plain = docs.where("doc_id is not null").join(repeated, is_again, "left_anti").join(gone, is_gone, "left_anti")
    unclear = _keyed(docs.join(repeated, is_again, "left_semi").unionByName(docs.where("doc_id is null")), c, d)
    groups = found.where("k1 is not null").select(F.col("k1").alias(c), F.col("k2").alias(d), F.col("comp").alias(e), F.col("component_id").alias(g)).distinct()
    one = unclear.where(F.col(c).isNotNull()).dropDuplicates(["doc_id", c, d]).join(groups, [c, d]).where(F.col("doc_id").cast("long").eqNullSafe(F.col(g))).dropDuplicates([e])
    empty = unclear.where(F.col(c).isNull())
    empty = empty.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(empty.where("doc_id is null"))
    return plain.unionByName(one.select(*docs.columns)).unionByName(empty.select(*docs.columns))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))

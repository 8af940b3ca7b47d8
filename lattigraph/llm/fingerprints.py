"""Document fingerprints (operator 9): consistent weighted sampling, in DataFrame functions only.

A text's terms are its pairs of neighbouring words (lower case; the last word also stands alone), weighted by their counts. A
sample draws for every term gamma-distributed r and c and a uniform beta from hashes of the term; for weight w

    t = floor(ln(w) / r + beta),   y = exp(r * (t - beta)),   a = c / (y * exp(r)).

The sample is the term with the smallest a together with t: two weighted sets share a sample with a probability
equal to their generalised Jaccard similarity, sum of minima over sum of maxima. A signature has ``SAMPLES`` samples, each with draws of
its own from all terms. The likeness of two signatures is their share of equal samples: unbiased, with the variance of so many
independent trials.

A text's terms and weights are array functions inside its row. Terms are then expanded and folded into the smallest
sample of each kind in the same stage, by a hash aggregation that holds a few rows for a text; nothing but samples would be
shuffled, and texts that come from one shuffle need none. For the edited texts, rows are numbered in the order of id and
text hash, from these small columns alone; texts are shuffled once by them, and each lends the characters asked for, and
at last its signature, to the document before it. Rows with the same id are in the order of their texts' hashes.

Defined results: a null text is empty; a text without words has an empty fingerprint, which is like another
empty one (1) and unlike any other (0); repeated rows and ids are documents of their own, and the next one may
be a repeat; a single document is its own next; an empty table yields no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, staged, table
from .sharding import numbered

SAMPLES = 40
#: Samples that one expanded row of a term updates.
WIDTH = 8
#: The smallest a of a text is exponential in the sum of its weights: with a probability of exp(-SURE) it is above SURE over
#: that sum. Terms whose a is surely above are not worked out.
SURE = 25.0
#: A sample is one integer: the fourth root of a, scaled, then bits that name term and t.
SCALE, CODE = float(1 << 35), 24


def _words(text: Column) -> Column:
    """The hashes of the text's words; none for a text of white space alone."""
    blank = lambda t: F.trim(F.regexp_replace(t, r"\s+", " ")) == ""
    words = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.xxhash64(w))
    # the whole text is only looked through for words if its beginning is blank
    return F.when(blank(F.substring(text, 1, 64)) & blank(text), F.array().cast("array<bigint>")).otherwise(words)


def _terms(words: str) -> Column:
    """The sorted hashes of the terms, repeated as often as they come."""
    return F.sort_array(F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.xxhash64(a, b)))


def _begins(terms: str) -> Column:
    """Where the sorted ``terms`` change."""
    at = F.filter(F.sequence(F.lit(0), F.size(terms) - 1), lambda i: (i == 0) | (F.col(terms)[i] != F.col(terms)[i - 1]))
    return F.when(F.size(terms) == 0, F.array().cast("array<int>")).otherwise(at)


def _weighted(terms: str, begins: str, kind: int) -> Column:
    """The distinct of the sorted ``terms`` with their numbers."""
    ends = F.concat(F.slice(begins, F.lit(2), F.greatest(F.size(begins), F.lit(1))), F.array(F.size(terms)))
    both = F.zip_with(begins, ends, lambda i, j: F.struct(F.lit(kind).alias("kind"), F.col(terms)[i].alias("h"), (j - i).alias("n")))
    return F.when(F.size(begins) == 0, F.array().cast("array<struct<kind:int,h:bigint,n:int>>")).otherwise(both)


def _uniform(h: Column, low: int, bits: int) -> Column:
    return (F.shiftrightunsigned(h, low).bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(0.5)) * F.lit(2.0**-bits)


def signatures(df: DataFrame, keys: list[str], texts: dict[str, str], samples: int = SAMPLES) -> DataFrame:
    """(keys, signatures) of the columns ``texts`` (column: name of its signature) of ``df``, whose rows the ``keys`` tell apart. A
    signature is an array of ``samples`` integers, empty for a text without words. No helper's name clashes with ``keys``."""
    if samples % WIDTH:
        raise ValueError(f"samples must be a multiple of {WIDTH}")
    named = [f"k{i}" for i in range(len(keys))]
    df = df.select(*(F.col(k).alias(n) for k, n in zip(keys, named)), *(_words(F.col(t)).alias(f"words{i}") for i, t in enumerate(texts)))
    df = df.select(*named, *(_terms(f"words{i}").alias(f"terms{i}") for i in range(len(texts))))
    df = df.select(*named, *(f"terms{i}" for i in range(len(texts))), *(_begins(f"terms{i}").alias(f"begins{i}") for i in range(len(texts))))
    sizes = F.array(*(F.size(f"terms{i}") for i in range(len(texts)))).alias("sizes")
    df = df.select(*named, sizes, F.concat(*(_weighted(f"terms{i}", f"begins{i}", i) for i in range(len(texts)))).alias("all"))
    # a row without any term stays, with nulls
    df = df.select(*named, "sizes", F.explode_outer("all").alias("x"))
    df = df.select(*named, "x.kind", "x.h", F.ln("x.n").alias("w"), (F.lit(SURE) * F.col("x.n") / F.get("sizes", F.col("x.kind"))).alias("most"))
    df = df.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(samples // WIDTH - 1))))

    def sample(i: int) -> Column:
        one, two = (F.xxhash64("h", F.col("block") * (2 * WIDTH) + (2 * i + k)) for k in (0, 1))
        product = _uniform(one, 40, 24) * _uniform(one, 16, 24)  # exp(-r)
        x = _uniform(two, 32, 32) * _uniform(two, 0, 32)
        r, beta, c, z = -F.ln(product), _uniform(one, 0, 16), -F.ln(x), 1 - x
        t = F.floor(F.col("w") / r + beta)
        value = F.floor(F.least(F.sqrt(F.sqrt(c * product * F.exp(r * (beta - t)))), F.lit(7.99)) * F.lit(SCALE))
        drawn = F.shiftleft(value, CODE).bitwiseOR(F.col("h").bitwiseXOR(t * F.lit(40503)).bitwiseAND(F.lit((1 << CODE) - 1)))
        # y is at most w, and c at least the first terms of its series
        return F.when(product * z * (1 + z * (F.lit(0.5) + z * F.lit(0.3))) <= F.col("most"), drawn)

    folded = df.groupBy(*named, "kind", "block").agg(*(F.min(sample(i)).alias(f"s{i}") for i in range(WIDTH)))
    rows = folded.groupBy(*named).agg(F.collect_list(F.struct("kind", "block", F.array(*(f"s{i}" for i in range(WIDTH))).alias("s"))).alias("rows"))

    def signature(kind: int) -> Column:
        mine = F.sort_array(F.filter("rows", lambda x: x["kind"] == kind))
        return F.transform(F.flatten(F.transform(mine, lambda x: x["s"])), lambda v: F.coalesce(v.bitwiseAND(F.lit((1 << CODE) - 1)), F.lit(0)).cast("int"))

    return rows.select(*(F.col(n).alias(k) for k, n in zip(keys, named)), *(signature(i).alias(out) for i, out in enumerate(texts.values())))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples of two signatures; an empty one is like an empty one alone."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).when(F.size(a) == 0, F.lit(1.0)).otherwise(same / F.size(a))


def as_text(signature: Column) -> Column:
    """A signature as text: six hex digits for each sample."""
    return F.lower(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x), 6, "0")), ""))


def _neighbours(docs: DataFrame) -> DataFrame:
    """(k, h, doc_id, n, copies, and for the distinct row before it: bk, bh and the characters it asks for) for each
    distinct row of ``docs`` (k, h, doc_id, text)."""
    spark = docs.sparkSession
    small, path = staged(docs.groupBy("k", "h").agg(F.max("doc_id").alias("doc_id"), F.max(F.char_length("text").cast("long")).alias("n"), F.count("*").alias("copies")), "lengths")
    rows, base, total = numbered(small, ["k", "h"], "ranks")
    drop(spark, path)
    before = spark.createDataFrame(sorted(base.items()), "part int, before long")  # a row for each partition
    ranked = rows.join(F.broadcast(before), "part").select("k", "h", "doc_id", "n", "copies", (F.col("before") + F.col("idx")).alias("rank"))
    asks = ranked.select(F.pmod(F.col("rank") + 1, F.lit(max(total, 1))).alias("rank"), F.col("k").alias("bk"), F.col("h").alias("bh"), F.floor(F.col("n") / 4).alias("asked"))
    return staged(ranked.join(asks, "rank").drop("rank"), "neighbours")[0]


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row for each document; see the module. Rows are named by (k, h): the id and a hash of the text; rows alike in both
    are alike, and are carried once with their number."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ident = F.col("doc_id").cast("long")
    texts = docs.select(F.coalesce(ident, F.lit(-(1 << 63))).alias("k"), F.xxhash64(text, ident.isNull()).alias("h"), ident.alias("doc_id"), text.alias("text"))
    near = _neighbours(texts)
    own = texts.groupBy("k", "h").agg(F.first("text").alias("text")).join(near, ["k", "h"])
    loans = own.select(F.col("bk").alias("k"), F.col("bh").alias("h"), F.expr("substring(text, 1, cast(asked as int))").alias("head"))
    both = own.join(loans, ["k", "h"])
    # all copies of a row but the last have a copy as the next document
    copies = F.expr("if(copies > 1, array(named_struct('self', false, 'times', 1L), named_struct('self', true, 'times', copies - 1)), array(named_struct('self', false, 'times', 1L)))")
    both = both.select("k", "h", "bk", "bh", "doc_id", "n", "text", "head", F.explode(copies).alias("copy"))
    head = F.when(F.col("copy.self"), F.expr("substring(text, 1, cast(floor(n / 4) as int))")).otherwise(F.col("head"))
    both = both.select("k", "h", "bk", "bh", "doc_id", "n", "copy.self", "copy.times", "text", F.concat(F.expr("substring(text, 1, cast(n - floor(n / 4) as int))"), head).alias("edited"))
    both = both.withColumn("sha", F.sha2("edited", 256))
    printed, _ = staged(signatures(both, ["k", "h", "bk", "bh", "doc_id", "n", "self", "times", "sha"], {"text": "print", "edited": "edited_print"}), "signatures")
    lent = printed.where("not self").select(F.col("bk").alias("k"), F.col("bh").alias("h"), F.col("print").alias("lent"))
    done = printed.join(lent, ["k", "h"]).withColumn("next_print", F.when(F.col("self"), F.col("print")).otherwise(F.col("lent")))
    out = done.select(
        "times",
        "doc_id",
        F.col("n").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("copy", "times")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))

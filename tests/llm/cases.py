"""Awkward documents that every operator has to take."""

import functools

import numpy as np

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, row long, key long, score double, n long"


@functools.cache
def words(seed, n, vocabulary=400):
    r = np.random.default_rng(seed)
    names = ["".join(r.choice(list("abcdefghiklmnoprstuvé"), r.integers(2, 8))) for _ in range(vocabulary)]
    return " ".join(names[i] for i in np.random.default_rng(seed + 1).integers(0, vocabulary, n))


def awkward():
    """(doc_id, text): null and empty texts, blanks, a null id, repeated rows, equal texts, one very long text."""
    base = words(1, 120)
    long = words(2, 60_000, 3000)
    return [(1, base), (2, None), (3, ""), (4, " \n\t "), (5, base), (6, long), (6, long), (7, "One"), (8, "One two three four"), (9, "".join(c.upper() if c.isascii() else c for c in base.replace(" ", "\n", 3))), (None, words(3, 30)), (None, None), (10, "ÀÉ ß x² ﬁ 𝒳 " * 9), (11, base.rsplit(" ", 4)[0] + " changed the last words"), (-12, words(4, 900)), (13, "x" * 3000)]


def frame(spark, rows, partitions=3):
    """Documents with extra columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", None, 1, 2, 3, 0.5, 4) for i, t in rows], SCHEMA).repartition(partitions) if rows else spark.createDataFrame([], SCHEMA)

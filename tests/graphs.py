"""Small graphs, and their exact values by dense algebra."""

import numpy as np

# The worked example's edges.
EXAMPLE = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (2, 5), (3, 5), (4, 5), (5, 7), (6, 9), (7, 8)]


def random_edges(n=60, m=150, seed=5):
    r = np.random.default_rng(seed)
    ring = [(i, (i + 1) % n) for i in range(n)]
    return sorted({(min(a, b), max(a, b)) for a, b in [*ring, *r.integers(0, n, (m, 2)).tolist()] if a != b})


def edges_df(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def matrix(edges, n):
    a = np.zeros((n, n))
    for s, d in edges:
        a[s, d] = a[d, s] = 1
    return a


def exact_ppr(edges, n, alpha=0.2):
    a = matrix(edges, n)
    return alpha * np.linalg.inv(np.eye(n) - (1 - alpha) * a / a.sum(1, keepdims=True))


def dense(df, n, value="value", i="source", j="node"):
    out = np.zeros((n, n))
    for r in df.select(i, j, value).collect():
        out[r[0], r[1]] = r[2]
    return out

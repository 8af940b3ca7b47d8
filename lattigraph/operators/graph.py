"""Graphs as DataFrames: edges(src, dst[, weight]) and arcs(src, dst, w), each edge as two arcs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.loop import settle


def weighted(edges: DataFrame) -> DataFrame:
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    return edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), weight.alias("weight"))


def canonical(edges: DataFrame, self_loops: str = "drop", sum_parallel: bool = False) -> DataFrame:
    """Each undirected edge once, src <= dst. ``self_loops``: drop or keep; parallel edges collapse to weight 1
    or, with ``sum_parallel``, to the sum of their weights."""
    if self_loops not in ("drop", "keep"):
        raise ValueError(f"self_loops is {self_loops!r}")
    e = weighted(edges).where("src is not null and dst is not null")
    if self_loops == "drop":
        e = e.where("src <> dst")
    total = F.sum("weight") if sum_parallel else F.lit(1.0)
    return e.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(total.alias("weight"))


def arcs(edges: DataFrame) -> DataFrame:
    """Both directions of each edge; a self-loop stays one arc. The edges are worked out once, not for each direction."""
    there, back = F.struct("src", "dst", F.col("weight").alias("w")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("w"))
    return weighted(edges).select(F.inline(F.when(F.col("src") == F.col("dst"), F.array(there)).otherwise(F.array(there, back))))


def symmetric(edges: DataFrame, self_loops: str = "drop", sum_parallel: bool = False) -> DataFrame:
    return arcs(canonical(edges, self_loops, sum_parallel))


def degree(a: DataFrame, loops_twice: bool = True) -> DataFrame:
    """(node, deg): arcs that leave a node; a self-loop counts twice or once."""
    one = F.when(F.col("src") == F.col("dst"), 2 if loops_twice else 1).otherwise(1)
    return a.groupBy(F.col("src").alias("node")).agg(F.sum(one).cast("long").alias("deg"))


def known(a: DataFrame) -> dict:
    """What was found out about a DataFrame of arcs."""
    return a.__dict__.setdefault("_lattigraph", {})


def weighted_degree(a: DataFrame) -> DataFrame:
    if "degrees" in known(a):
        return known(a)["degrees"]
    return a.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("wdeg"))


def community_weighted_degree(a: DataFrame, membership: DataFrame) -> DataFrame:
    """(comm, wdeg): the weighted degrees of a community's nodes together."""
    return a.join(membership, F.col("src") == F.col("node")).groupBy("comm").agg(F.sum("w").alias("wdeg"))


def self_loop_weight(a: DataFrame) -> DataFrame:
    """(node, loop): weight of a node's self-loop, 0 without."""
    return a.groupBy(F.col("src").alias("node")).agg(F.sum(F.when(F.col("src") == F.col("dst"), F.col("w")).otherwise(0.0)).alias("loop"))


def neighbours(a: DataFrame, node: int) -> DataFrame:
    return a.where(F.col("src") == node).select("dst", "w")


def stats(a: DataFrame) -> DataFrame:
    """One row (n, m, avg_degree); m counts undirected edges."""
    if "size" in known(a):
        s = a.sparkSession.createDataFrame([known(a)["size"]], "n long, m long")
        return s.select("n", "m", (2 * F.col("m") / F.col("n")).alias("avg_degree"))
    s = a.agg(F.countDistinct("src").alias("n"), F.sum(F.when(F.col("src") <= F.col("dst"), 1).otherwise(0)).cast("long").alias("m"))
    return s.select("n", "m", (2 * F.col("m") / F.col("n")).alias("avg_degree"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def dense_ids(ids: DataFrame, column: str = "node") -> DataFrame:
    """(``column``, new): 0.. in the order of ``column``. Ranges are numbered apart and joined by prefix sums over
    their counts, so no task sees all rows."""
    spread = settle(ids.select(column).distinct().repartitionByRange(column).sortWithinPartitions(column).withColumns({"part": F.spark_partition_id(), "idx": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    base, total = [], 0
    for part, n in sorted(spread.groupBy("part").count().collect()):  # one row for each partition
        base.append((part, total))
        total += n
    before = ids.sparkSession.createDataFrame(base, "part int, before long")
    return spread.join(F.broadcast(before), "part").select(column, (F.col("before") + F.col("idx")).alias("new"))


def renumber(edges: DataFrame) -> DataFrame:
    """Edges over dense ids; isolated ids vanish, the order of ids is kept."""
    edges = settle(edges)  # read for the ids and for the edges
    ids = settle(dense_ids(nodes(edges)))
    a, b = fresh(edges, "new_src", "new_dst")
    out = edges.join(ids.select(F.col("node").alias("src"), F.col("new").alias(a)), "src").join(ids.select(F.col("node").alias("dst"), F.col("new").alias(b)), "dst")
    return out.select(F.col(a).alias("src"), F.col(b).alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def induced(a: DataFrame, members: DataFrame) -> DataFrame:
    """Arcs between ``members`` (node)."""
    m = members.select("node").distinct()
    return a.join(m.withColumnRenamed("node", "src"), "src", "left_semi").join(m.withColumnRenamed("node", "dst"), "dst", "left_semi").select(*a.columns)


def induced_renumbered(a: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The induced subgraph over dense ids, and (node, new)."""
    ids = dense_ids(members.select("node"))
    left, right = ids.select(F.col("node").alias("src"), F.col("new").alias("a")), ids.select(F.col("node").alias("dst"), F.col("new").alias("b"))
    return a.join(left, "src").join(right, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "w"), ids


def symmetry_violations(a: DataFrame) -> DataFrame:
    """Arcs (src, dst, w, back) whose reverse is absent or has another weight."""
    back = a.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("back"))
    return a.join(back, ["src", "dst"], "left").where("back is null or back <> w").select("src", "dst", "w", "back")


def row_normalised(a: DataFrame) -> DataFrame:
    """(src, dst, p): weights over their row's sum. Sums are taken partially and joined, so that a hub's row may be split."""
    total = a.groupBy("src").agg(F.sum("w").alias("row"))
    return a.join(total, "src").select("src", "dst", (F.col("w") / F.col("row")).alias("p"))


def reverse_arcs(a: DataFrame) -> DataFrame:
    """The arcs to smaller ids."""
    return a.where("src > dst")

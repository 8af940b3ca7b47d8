"""Components, modularity, Louvain and size-bounded Louvain+ hierarchies."""

from __future__ import annotations

from collections import deque
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import supernode_name, uniform
from ..plans.loop import Settled, settle
from . import graph
from . import levels as mapped
from .csr import Shared, compact


#: Graphs up to so many arcs are handled inside one task where an algorithm is sequential or takes many rounds.
SEQUENTIAL = 500_000


#: In distributed rounds the arcs of a hub are dealt over so many parts.
SALTS = 16


def _small(a: DataFrame, engine: str) -> bool:
    return engine == "sequential" or engine == "auto" and a.limit(SEQUENTIAL + 1).count() <= SEQUENTIAL


def _mapped(a: DataFrame, engine: str) -> mapped.Level | None:
    """The rows of a large graph, where tasks can map them."""
    found = compact(a, 0 if engine == "mapped" else SEQUENTIAL) if engine in ("auto", "mapped") else None
    return mapped.opened(found) if isinstance(found, Shared) else None


def _dense(comm: np.ndarray) -> tuple[np.ndarray, int]:
    """Communities renumbered from 0 in the order of their names, and how many."""
    names, place = np.unique(comm, return_inverse=True)
    return place.astype(np.int32), len(names)


def _in_one_task(a: DataFrame, run, schema: str) -> DataFrame:
    """``run`` on all arcs (src, dst, w) of a graph of a checked size."""
    return a.select("src", "dst", "w").groupBy(F.lit(0).alias("g")).applyInPandas(lambda rows: run(rows), schema)


def _least_reachable(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node each is connected to."""
    ids = np.unique(np.concatenate([src, dst]))
    s, d = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        low = np.minimum(label[s], label[d])
        np.minimum.at(new, s, low)
        np.minimum.at(new, d, low)
        np.minimum.at(new, label, new[np.arange(len(ids))])
        new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def components(a: DataFrame, engine: str = "auto") -> DataFrame:
    """(node, comp): the smallest node of each connected component; beyond ``SEQUENTIAL`` arcs by alternating large-star
    and small-star steps."""
    if _small(a, engine):

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            node, comp = _least_reachable(rows["src"].to_numpy(), rows["dst"].to_numpy())
            return pd.DataFrame({"node": node, "comp": comp})

        return _in_one_task(a, run, "node long, comp long")
    now = Settled(a.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        mark = now.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        salted = both.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
        copies = low.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        large = Settled(salted.join(copies.hint("merge"), ["u", "salt"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.df.groupBy("u").agg(F.min("v").alias("m"))
        small = large.df.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = Settled(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now.remove()
        large.remove()
        now = new
    return graph.nodes(a).join(now.df, F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("comp"))


def largest_component(comps: DataFrame) -> DataFrame:
    """The nodes of the largest component; among equals, of the one with the smallest id."""
    best = comps.groupBy("comp").count().orderBy(F.desc("count"), "comp").limit(1)
    return comps.join(F.broadcast(best), "comp", "left_semi").select("node")


def singletons(nodes: DataFrame) -> DataFrame:
    return nodes.select("node", F.col("node").alias("comm"))


def move(membership: DataFrame, moves: DataFrame) -> DataFrame:
    """``membership`` with the nodes of ``moves`` (node, comm) taken out of their community and put into another."""
    return membership.join(moves.select("node", F.col("comm").alias("to")), "node", "left").select("node", F.coalesce("to", "comm").alias("comm"))


def neighbour_communities(a: DataFrame, membership: DataFrame) -> DataFrame:
    """(node, comm, w): weight from a node to each community, without its self-loop; membership (node, comm)."""
    to = membership.select(F.col("node").alias("dst"), "comm")
    return a.where("src <> dst").join(to, "dst").groupBy(F.col("src").alias("node"), "comm").agg(F.sum("w").alias("w"))


def community_weights(a: DataFrame, membership: DataFrame) -> DataFrame:
    """(cs, cd, w): weight of arcs between communities."""
    s, d = membership.select(F.col("node").alias("src"), F.col("comm").alias("cs")), membership.select(F.col("node").alias("dst"), F.col("comm").alias("cd"))
    return a.join(s, "src").join(d, "dst").groupBy("cs", "cd").agg(F.sum("w").alias("w"))


def coarsen(a: DataFrame, membership: DataFrame) -> DataFrame:
    """Arcs between communities; arcs inside one make its self-loop, each counted as it comes."""
    return community_weights(a, membership).select(F.col("cs").alias("src"), F.col("cd").alias("dst"), "w")


def modularity(a: DataFrame, membership: DataFrame) -> DataFrame:
    """One row (modularity): sum over communities of in / 2m - (tot / 2m)^2."""
    between = community_weights(a, membership)
    per = between.groupBy("cs").agg(F.sum(F.when(F.col("cs") == F.col("cd"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("tot"))
    total = a.agg(F.sum("w").alias("m2"))
    return per.join(F.broadcast(total)).agg(F.sum(F.col("inside") / F.col("m2") - (F.col("tot") / F.col("m2")) * (F.col("tot") / F.col("m2"))).alias("modularity"))


def merge_gain(a: DataFrame, membership: DataFrame) -> DataFrame:
    """(node, comm, gain): w(node, comm) - tot(comm) * deg(node) / 2m for each neighbouring community."""
    deg = graph.weighted_degree(a)
    tot = graph.community_weighted_degree(a, membership).withColumnRenamed("wdeg", "tot")
    total = a.agg(F.sum("w").alias("m2"))
    rows = neighbour_communities(a, membership).join(deg, "node").join(tot, "comm").join(F.broadcast(total))
    return rows.select("node", "comm", (F.col("w") - F.col("tot") * F.col("wdeg") / F.col("m2")).alias("gain"))


def size_stats(membership: DataFrame) -> DataFrame:
    """One row: smallest, largest and mean (whole) community size."""
    s = membership.groupBy("comm").agg(F.count("*").alias("size"))
    return s.agg(F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.floor(F.avg("size")).alias("avg_size"))


def _relabel(membership: DataFrame) -> DataFrame:
    """Communities renumbered from 0 in the order of their ids."""
    ids = graph.dense_ids(membership.select(F.col("comm").alias("node"))).select(F.col("node").alias("comm"), "new")
    return membership.join(ids, "comm").select("node", F.col("new").alias("comm"))


def _sequential_moves(src, dst, w, seed: int, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Louvain local moving over nodes in a seeded order, until a pass gains at most ``epsilon`` modularity."""
    ids = np.unique(np.concatenate([src, dst]))
    s, d = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    order = np.lexsort((d, s))
    s, d, w = s[order], d[order], w[order]
    n = len(ids)
    starts = np.searchsorted(s, np.arange(n + 1))
    deg = np.bincount(s, w, n)
    m2 = w.sum()
    comm, tot = np.arange(n), deg.copy()
    visit = np.random.default_rng(seed).permutation(n)
    while m2 > 0:
        gained = 0.0
        for v in visit:
            a, b = starts[v], starts[v + 1]
            near: dict[int, float] = {}
            for u, x in zip(d[a:b].tolist(), w[a:b].tolist()):
                if u != v:
                    near[comm[u]] = near.get(comm[u], 0.0) + x
            old = comm[v]
            tot[old] -= deg[v]
            best, best_gain = old, near.get(old, 0.0) - tot[old] * deg[v] / m2
            stay = best_gain
            for c, x in near.items():
                g = x - tot[c] * deg[v] / m2
                if g > best_gain + 1e-15:
                    best, best_gain = c, g
            comm[v] = best
            tot[best] += deg[v]
            gained += 2 * (best_gain - stay) / m2
        if gained <= epsilon:
            break
    return ids, comm


def local_moves(a: DataFrame, seed: int = 1, epsilon: float = 1e-6, engine: str = "auto") -> DataFrame:
    """(node, comm) after one level of Louvain: nodes move one by one in a small graph, in synchronous rounds in a large one,
    until a pass, or the moves that are left, gain at most ``epsilon`` modularity."""
    if _small(a, engine):

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            ids, comm = _sequential_moves(rows["src"].to_numpy(), rows["dst"].to_numpy(), rows["w"].to_numpy(float), seed, epsilon)
            return pd.DataFrame({"node": ids, "comm": ids[comm]})

        return settle(_in_one_task(a, run, "node long, comm long"))
    now = Settled(singletons(graph.nodes(a)))
    quality = modularity(a, now.df).first()[0]
    deg = settle(graph.weighted_degree(a))
    m2 = a.agg(F.sum("w")).first()[0]
    share = 0.5  # of the nodes that would gain, so many move in a round, so that neighbours do not swap
    for i in count():
        tot = now.df.join(deg, "node").groupBy("comm").agg(F.sum("wdeg").alias("tot"))
        # every node looks at its own community too
        options = neighbour_communities(a, now.df).unionByName(now.df.select("node", "comm", F.lit(0.0).alias("w"))).groupBy("node", "comm").agg(F.sum("w").alias("w"))
        rated = options.join(tot, "comm").join(deg, "node").join(now.df.select("node", F.col("comm").alias("own")), "node")
        gain = F.col("w") - (F.col("tot") - F.when(F.col("own") == F.col("comm"), F.col("wdeg")).otherwise(0.0)) * F.col("wdeg") / m2
        best = rated.groupBy("node").agg(F.max(F.struct(gain.alias("gain"), (-F.col("comm")).alias("c"))).alias("best"), F.max(F.when(F.col("own") == F.col("comm"), gain)).alias("stay"))
        up = F.col("best")["gain"] - F.col("stay")
        wanted = Settled(best.where(up > 1e-15).select("node", (-F.col("best")["c"]).alias("comm"), up.alias("up")))
        if 2 * (wanted.df.agg(F.sum("up")).first()[0] or 0.0) / m2 <= epsilon:
            wanted.remove()
            break
        new = Settled(move(now.df, wanted.df.where(uniform(seed + i, F.col("node")) < share)))
        better = modularity(a, new.df).first()[0]
        wanted.remove()
        if better > quality:
            now.remove()
            now, quality, share = new, better, min(0.5, 2 * share)
        else:  # moves that spoil one another, or none drawn: fewer of them next time, at least one in expectation
            new.remove()
            share = max(share / 2, 1e-9) if better < quality else min(0.5, 2 * share)
    return now.df


def louvain(a: DataFrame, seed: int = 1, epsilon: float = 1e-6, levels: int | None = None, engine: str = "auto") -> list[DataFrame]:
    """Memberships (node, comm) of each level over the original nodes, from fine to coarse."""
    if (rows := _mapped(a, engine)) is not None:
        return _mapped_louvain(a, rows, seed, epsilon, levels, engine)
    out: list[DataFrame] = []
    level, carried = a, singletons(graph.nodes(a))
    for i in count() if levels is None else range(levels):
        moved = settle(_relabel(local_moves(level, seed + i, epsilon, engine=engine)))
        if moved.select("comm").distinct().count() == moved.count():
            break
        carried = settle(carried.select("node", F.col("comm").alias("at")).join(moved.select(F.col("node").alias("at"), F.col("comm")), "at").select("node", "comm"))
        out.append(carried)
        level = settle(coarsen(level, moved))
    return out or [carried]


def _mapped_louvain(a: DataFrame, rows: mapped.Level, seed: int, epsilon: float, levels: int | None, engine: str) -> list[DataFrame]:
    """The same over mapped rows; a level of few arcs is handled in one task, as elsewhere."""
    spark, ids = a.sparkSession, np.load(f"{rows.folder}/ids.npy")
    out, level, carried, home = [], rows, np.arange(rows.n), rows.folder
    for i in count() if levels is None else range(levels):
        if engine == "auto" and len(level.dst) <= SEQUENTIAL:
            moved = mapped.alone(spark, level, lambda s, d, w: _sequential_moves(s, d, w, seed + i, epsilon))  # noqa: B023
        else:
            moved = mapped.local_moves(spark, level, seed + i, epsilon)
        moved, groups = _dense(moved)
        if groups == level.n:
            break
        carried = moved[carried]
        out.append(mapped.table(spark, home, {"node": ids, "comm": carried.astype(np.int64)}, "node long, comm long"))
        level = mapped.coarse(spark, level, moved, groups)
    return out or [mapped.table(spark, home, {"node": ids, "comm": ids}, "node long, comm long")]


def merge_proposals(a: DataFrame, sizes: DataFrame, k: int, hard_cap: bool = False) -> DataFrame:
    """(src, ss, dst, sd, fits): what each community below k, of size ss, would join: the neighbour with the largest gain among
    those it fits with (sizes sum to at most k), else the smallest neighbour (not with ``hard_cap``)."""
    deg = graph.weighted_degree(a)
    m2 = a.agg(F.sum("w").alias("m2"))
    s = sizes.select(F.col("comm").alias("src"), F.col("size").alias("ss")).join(deg.select(F.col("node").alias("src"), F.col("wdeg").alias("ds")), "src", "left")
    d = sizes.select(F.col("comm").alias("dst"), F.col("size").alias("sd")).join(deg.select(F.col("node").alias("dst"), F.col("wdeg").alias("dd")), "dst", "left")
    rated = a.where("src <> dst").join(s, "src").join(d, "dst").join(F.broadcast(m2)).where(F.col("ss") < k)
    fits = F.col("ss") + F.col("sd") <= k
    gain = F.col("w") - F.col("dd") * F.col("ds") / F.col("m2")
    if hard_cap:
        rated = rated.where(fits)
    score = F.struct(fits.cast("int").alias("fits"), F.when(fits, gain).otherwise(-F.col("sd").cast("double")).alias("score"), (-F.col("dst")).alias("tie"), "sd")
    best = rated.groupBy("src").agg(F.max(score).alias("best"), F.max("ss").alias("ss"))
    return best.select("src", "ss", (-F.col("best")["tie"]).alias("dst"), F.col("best")["sd"].alias("sd"), (F.col("best")["fits"] == 1).alias("fits"))


def merge_round(proposals: DataFrame, k: int, seed: int) -> DataFrame:
    """(a, b): community b joins a. In a round a community below k either joins or is joined, by a hashed coin; those of k
    and more are joined. Any number join one community; of those that fit with it, as many as fit together."""
    coin = lambda c: uniform(seed, F.col(c)) < 0.5
    moving = proposals.where(coin("src") & ((F.col("sd") >= k) | ~coin("dst"))).withColumns({"p": F.xxhash64("src", F.lit(seed)), "salt": F.pmod(F.xxhash64("src"), F.lit(SALTS))})
    fitting = moving.where("fits")
    for key in (["dst", "salt"], ["dst"]):  # a part of a hub's proposals leaves no more than fit, then all parts together
        so_far = F.sum("ss").over(Window.partitionBy(*key).orderBy("p", "src").rowsBetween(Window.unboundedPreceding, 0))
        fitting = fitting.withColumn("so_far", so_far).where(F.col("sd") + F.col("so_far") <= k).drop("so_far")
    return fitting.unionByName(moving.where("not fits")).select(F.col("dst").alias("a"), F.col("src").alias("b"))


def _merge_in_order(src, dst, w, k: int, seed: int, hard_cap: bool) -> tuple[np.ndarray, np.ndarray]:
    """Size-bounded merging with a queue: a community below k joins the neighbour of the largest gain it fits with, else
    the smallest one (not with ``hard_cap``), and comes back to the queue while it is below k."""
    ids = np.unique(np.concatenate([src, dst]))
    n = len(ids)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for s, d, x in zip(np.searchsorted(ids, src).tolist(), np.searchsorted(ids, dst).tolist(), w.tolist()):
        near[s][d] = near[s].get(d, 0.0) + x
    deg = [sum(x.values()) for x in near]
    m2 = sum(deg)
    size, owner = [1] * n, list(range(n))
    queue = deque(np.random.default_rng(seed).permutation(n).tolist())
    while queue:
        v = queue.popleft()
        if owner[v] != v or size[v] >= k:
            continue
        options = [u for u in near[v] if u != v]
        fit = [u for u in options if size[u] + size[v] <= k]
        if fit:
            t = max(fit, key=lambda u: (near[v][u] - deg[u] * deg[v] / m2, -u))
        elif options and not hard_cap:
            t = min(options, key=lambda u: (size[u], u))
        else:
            continue
        a, b = (t, v) if len(near[t]) >= len(near[v]) else (v, t)
        for u, x in near[b].items():
            to = a if u in (a, b) else u
            near[a][to] = near[a].get(to, 0.0) + x
            if u not in (a, b):
                near[u][a] = near[u].get(a, 0.0) + near[u].pop(b)
        if b in near[a]:
            near[a][a] = near[a].get(a, 0.0) + near[a].pop(b)
        near[b] = {}
        owner[b], size[a], deg[a] = a, size[a] + size[b], deg[a] + deg[b]
        if size[a] < k:
            queue.append(a)

    def root(v: int) -> int:
        while owner[v] != v:
            owner[v] = owner[owner[v]]
            v = owner[v]
        return v

    return ids, np.array([root(v) for v in range(n)])


def size_bounded_level(a: DataFrame, k: int = 25, seed: int = 1, hard_cap: bool = False, engine: str = "auto") -> DataFrame:
    """(node, comm): one level of Louvain+; communities count nodes of this level. A small graph is merged in order, a
    large one in rounds of joins, until no community below k has one to join."""
    if _small(a, engine):

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            ids, comm = _merge_in_order(rows["src"].to_numpy(), rows["dst"].to_numpy(), rows["w"].to_numpy(float), k, seed, hard_cap)
            return pd.DataFrame({"node": ids, "comm": np.unique(comm, return_inverse=True)[1]})

        return _in_one_task(a, run, "node long, comm long")
    member = Settled(singletons(graph.nodes(a)))
    level = Settled(a)
    for i in count():
        proposals = Settled(merge_proposals(level.df, member.df.groupBy("comm").agg(F.count("*").alias("size")), k, hard_cap))
        if not proposals.df.head(1):
            proposals.remove()
            break
        pairs = settle(merge_round(proposals.df, k, seed + i))
        proposals.remove()
        if not pairs.head(1):
            continue
        new_name = pairs.select(F.col("b").alias("comm"), F.col("a").alias("to"))
        new_member = Settled(member.df.join(new_name, "comm", "left").select("node", F.coalesce("to", "comm").alias("comm")))
        ms = pairs.select(F.col("b").alias("src"), F.col("a").alias("s"))
        md = pairs.select(F.col("b").alias("dst"), F.col("a").alias("d"))
        new_level = Settled(level.df.join(ms, "src", "left").join(md, "dst", "left").groupBy(F.coalesce("s", "src").alias("src"), F.coalesce("d", "dst").alias("dst")).agg(F.sum("w").alias("w")))
        member.remove()
        level.remove()
        member, level = new_member, new_level
    return _relabel(member.df)


def louvain_plus(a: DataFrame, k: int = 25, seed: int = 1, hard_cap: bool = False, include_small_components: bool = False, levels: int | None = None, engine: str = "auto") -> tuple[DataFrame, DataFrame]:
    """The hierarchy of every chosen component (the largest, or all): membership (component, level, id, leaf) and
    hierarchy (component, level, id, child_id) from level 2. Levels are built until at most k supernodes are left; then one root joins them."""
    if (rows := _mapped(a, engine)) is not None:
        return _mapped_plus(a, rows, k, seed, hard_cap, include_small_components, levels, engine)
    comps = settle(components(a, engine))
    order = comps.groupBy("comp").agg(F.count("*").alias("c"))
    chosen = order if include_small_components else order.orderBy(F.desc("c"), "comp").limit(1)
    names = settle(graph.dense_ids(chosen.select(F.col("comp").alias("node"))).select(F.col("node").alias("comp"), F.col("new").alias("component")))
    nodes = settle(comps.join(names, "comp").select("node", F.col("component").cast("int").alias("component")))
    level_arcs = settle(graph.induced(a, nodes))
    comp_of = nodes
    leaf_of = nodes.select("node", F.col("node").alias("leaf"))
    memberships, hierarchies = [], []
    for level in count(1) if levels is None else range(1, levels + 1):
        alone = comp_of.join(level_arcs.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
        grouped = size_bounded_level(level_arcs, k, seed + 1000 * level, hard_cap, engine=engine) if level_arcs.head(1) else None
        if grouped is None:
            comm = _relabel(singletons(comp_of.select("node")))
        elif alone.head(1):
            top = (grouped.agg(F.max("comm")).first()[0] or 0) + 1
            comm = grouped.unionByName(_relabel(singletons(alone.select("node"))).select("node", (F.col("comm") + top).alias("comm")))
        else:
            comm = grouped
        comm = settle(comm)
        comp_of_new = settle(comm.join(comp_of, "node").select(F.col("comm").alias("node"), "component").distinct())
        if level > 1:
            hierarchies.append(comm.join(comp_of, "node").select("component", F.lit(level).alias("level"), F.col("comm").alias("id"), F.col("node").alias("child_id")))
        leaf_of = settle(leaf_of.join(comm, "node").select(F.col("comm").alias("node"), "leaf"))
        memberships.append(leaf_of.join(comp_of_new, "node").select("component", F.lit(level).alias("level"), F.col("node").alias("id"), "leaf"))
        level_arcs = settle(coarsen(level_arcs, comm))
        left = comp_of_new.groupBy("component").count().agg(F.max("count")).first()[0]
        stuck = comm.select("comm").distinct().count() == comm.count()
        comp_of = comp_of_new
        if left <= k or stuck:
            if left > 1:
                hierarchies.append(comp_of.select("component", F.lit(level + 1).alias("level"), F.col("component").cast("long").alias("id"), F.col("node").alias("child_id")))
                memberships.append(leaf_of.join(comp_of, "node").select("component", F.lit(level + 1).alias("level"), F.col("component").cast("long").alias("id"), "leaf"))
            break
    schema = "component int, level int, id long, child_id long"
    empty = a.sparkSession.createDataFrame([], schema)
    member = memberships[0]
    for x in memberships[1:]:
        member = member.unionByName(x)
    for x in hierarchies:
        empty = empty.unionByName(x)
    return settle(member), settle(empty)


def _mapped_plus(a: DataFrame, rows: mapped.Level, k: int, seed: int, hard_cap: bool, include_small_components: bool, levels: int | None, engine: str) -> tuple[DataFrame, DataFrame]:
    """The same over mapped rows; a level of few arcs is merged in order, as elsewhere."""
    spark, ids, home = a.sparkSession, np.load(f"{rows.folder}/ids.npy"), rows.folder
    comp = mapped.components(spark, rows)
    sizes = np.bincount(comp, minlength=rows.n)
    chosen = np.flatnonzero(sizes) if include_small_components else np.array([int(np.argmax(sizes))])
    names = np.full(rows.n, -1, np.int32)
    names[chosen] = np.arange(len(chosen))
    comp_of = names[comp]
    leaves = np.flatnonzero(comp_of >= 0)
    of_leaf, leaf_of = comp_of[leaves], leaves
    schemas = "component int, level int, id long, leaf long", "component int, level int, id long, child_id long"
    memberships, hierarchies = [], []

    def member(level, ident):
        memberships.append(mapped.table(spark, home, {"component": of_leaf, "level": np.int32(level), "id": ident.astype(np.int64), "leaf": ids[leaves]}, schemas[0]))

    def above(level, component, ident, child):
        hierarchies.append(mapped.table(spark, home, {"component": component, "level": np.int32(level), "id": ident.astype(np.int64), "child_id": child.astype(np.int64)}, schemas[1]))

    now = rows
    for level in count(1) if levels is None else range(1, levels + 1):
        active = np.flatnonzero(comp_of >= 0)
        if engine == "auto" and len(active) == now.n and len(now.dst) <= SEQUENTIAL:
            comm = mapped.alone(spark, now, lambda s, d, w: _merge_in_order(s, d, w, k, seed + 1000 * level, hard_cap))  # noqa: B023
        else:
            comm = mapped.merged(spark, now, active, k, seed + 1000 * level, hard_cap)
        named = np.full(now.n, -1, np.int32)
        named[active], groups = _dense(comm[active])
        above_of = np.zeros(groups, np.int32)
        above_of[named[active]] = comp_of[active]
        if level > 1:
            above(level, comp_of, named, np.arange(now.n))
        leaf_of = named[leaf_of]
        member(level, leaf_of)
        left, stuck = int(np.bincount(above_of).max()), groups == len(active)
        if left <= k or stuck:
            if left > 1:
                above(level + 1, above_of, above_of, np.arange(groups))
                member(level + 1, of_leaf)
            break
        now, comp_of = mapped.coarse(spark, now, named, groups), above_of
    out, tree = memberships[0], spark.createDataFrame([], schemas[1])
    for x in memberships[1:]:
        out = out.unionByName(x)
    for x in hierarchies:
        tree = tree.unionByName(x)
    return out, settle(tree)


def roots(membership: DataFrame) -> DataFrame:
    """(component, level, id, name) of each component's top level."""
    top = membership.groupBy("component").agg(F.max("level").alias("level"))
    return membership.join(top, ["component", "level"]).select("component", "level", "id", supernode_name(F.col("component"), F.col("level"), F.col("id")).alias("name")).distinct()


def expand(hierarchy: DataFrame, leaves: DataFrame) -> DataFrame:
    """Membership (component, level, id, leaf) of all levels, bottom-up from level 1 ``leaves`` of that form."""
    every = now = settle(leaves.select("component", "level", "id", "leaf"))
    top = hierarchy.agg(F.max("level")).first()[0] or 1
    for level in range(2, top + 1):
        up = hierarchy.where(F.col("level") == level).select("component", F.col("id").alias("up"), F.col("child_id").alias("id"))
        now = settle(now.join(up, ["component", "id"]).select("component", F.lit(level).alias("level"), F.col("up").alias("id"), "leaf"))
        every = every.unionByName(now)
    return every


def children(hierarchy: DataFrame, membership: DataFrame, component: int, level: int, ident: int) -> DataFrame:
    """(child): supernodes of the level below, or leaves at level 1."""
    if level == 1:
        return membership.where((F.col("component") == component) & (F.col("level") == 1) & (F.col("id") == ident)).select(F.col("leaf").alias("child"))
    return hierarchy.where((F.col("component") == component) & (F.col("level") == level) & (F.col("id") == ident)).select(F.col("child_id").alias("child"))


def child_membership(hierarchy: DataFrame, membership: DataFrame, component: int, level: int, ident: int) -> DataFrame:
    """(node, comm): the leaves under each child of a supernode."""
    kids = children(hierarchy, membership, component, level, ident)
    if level == 1:
        return kids.select(F.col("child").alias("node"), F.col("child").alias("comm"))
    below = membership.where((F.col("component") == component) & (F.col("level") == level - 1))
    return below.join(kids, F.col("id") == F.col("child")).select(F.col("leaf").alias("node"), F.col("id").alias("comm"))


def cluster_subgraph(a: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The coarse arcs between the children of a cluster, and their sizes; members (node, comm)."""
    return coarsen(graph.induced(a, members), members).where("src <> dst"), members.groupBy(F.col("comm").alias("node")).agg(F.count("*").alias("size"))


def top_k_hubs(dnpr: DataFrame, membership: DataFrame, k: int) -> DataFrame:
    """(node, dnpr, comm, rank): the k nodes of highest DNPR and their clusters; ties go to the larger node."""
    best = dnpr.join(membership, "node").orderBy(F.desc(F.round("dnpr", 15)), F.desc("node")).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("dnpr", 15)), F.desc("node"))))


def cluster_mean(dnpr: DataFrame, membership: DataFrame) -> DataFrame:
    return dnpr.join(membership, "node").groupBy("comm").agg(F.avg("dnpr").alias("mean_dnpr"))


def random_path(hierarchy: DataFrame, membership: DataFrame, seed: int = 2, component: int = 0) -> list[tuple[int, int]]:
    """(level, id) from the root down, a child drawn by a hash of the seed at each level."""
    own = membership.where(F.col("component") == component)
    level = own.agg(F.max("level")).first()[0]
    ident = own.where(F.col("level") == level).select("id").distinct().orderBy(F.xxhash64("id", F.lit(seed))).first().id
    path = [(level, ident)]
    while level > 1:
        child = children(hierarchy, membership, component, level, ident).orderBy(F.xxhash64("child", F.lit(seed)), "child").first()
        level, ident = level - 1, child.child
        path.append((level, ident))
    return path

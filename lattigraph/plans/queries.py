"""All queries of the engine: name -> (spark, sf_dir) -> DataFrame. Doubles are rounded, so that the order of sums
does not show."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import orientation, parse_supernode, pdist_natural, supernode_name
from ..operators import approx, cluster, csr, distance, graph, layout, metrics, ppr, push, walks
from ..sources import binary, index, text
from .loop import scratch, settle
from .tables import Tables

REGISTRY: dict = {}


def query(f):
    REGISTRY[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
    return f


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def partner_arcs(t: Tables) -> DataFrame:
    return settle(graph.symmetric(t.partners()))


def trade_arcs(t: Tables) -> DataFrame:
    return settle(graph.symmetric(t.trade(), "keep", sum_parallel=True))


def ps_arcs(t: Tables) -> DataFrame:
    return settle(graph.symmetric(t.ps()))


def ps_rows(t: Tables) -> DataFrame:
    """The same for what runs over rows and degrees, not over the table of arcs."""
    return csr.undirected(t.ps())


# graphs


@query
def edges_canonical(t):
    return graph.canonical(t.ps()).select("src", "dst")


@query
def arcs_symmetric(t):
    return graph.symmetric(t.forest()).select("src", "dst")


@query
def degree(t):
    return graph.degree(graph.symmetric(t.ps()))


@query
def weighted_degree(t):
    return graph.weighted_degree(graph.symmetric(t.trade(), "keep", True))


@query
def self_loop_weight(t):
    return graph.self_loop_weight(graph.symmetric(t.trade(), "keep", True))


@query
def graph_stats(t):
    return rounded(graph.stats(graph.symmetric(t.ps())))


@query
def renumber_dense(t):
    return graph.renumber(graph.canonical(t.ps()).select("src", "dst"))


@query
def induced_subgraph(t):
    """Arcs between nodes of at least the mean degree."""
    a = partner_arcs(t)
    deg = graph.degree(a)
    mean = deg.agg(F.avg("deg").alias("mean"))
    return graph.induced(a, deg.join(F.broadcast(mean)).where("deg >= mean")).select("src", "dst")


@query
def symmetry_violations(t):
    return graph.symmetry_violations(t.trade().withColumnRenamed("weight", "w"))


@query
def reverse_arcs(t):
    return graph.reverse_arcs(graph.symmetric(t.partners())).select("src", "dst")


@query
def row_normalized(t):
    return rounded(graph.row_normalised(graph.symmetric(t.trade(), "keep", True)))


# personalised PageRank


@query
def ppr_truncated(t):
    a = partner_arcs(t)
    return rounded(ppr.truncated(a, ppr.unit_seeds(graph.nodes(a))))


@query
def ppr_truncated_ps(t):
    return rounded(ppr.truncated(ps_arcs(t), ppr.unit_seeds(t.ps_sources())))


@query
def dppr_exact_ps(t):
    return rounded(ppr.dppr(ps_arcs(t), t.ps_sources(), tolerance=1e-9), 7)


@query
def dppr_exact(t):
    return rounded(ppr.dppr(partner_arcs(t), tolerance=1e-12), 7)


@query
def dppr_weighted(t):
    return rounded(ppr.dppr(trade_arcs(t), tolerance=1e-9), 5)


@query
def super_dppr(t):
    return rounded(ppr.super_truncated(ps_arcs(t), t.ps_members()))


@query
def dnpr_iter(t):
    return rounded(ppr.dnpr(ps_arcs(t)), 12)


@query
def dnpr_closed(t):
    return rounded(ppr.dnpr_closed(ps_arcs(t)), 12)


@query
def push_forward_rounds(t):
    a = partner_arcs(t)
    return rounded(push.push(a, ppr.degree_seeds(a), 0.01, rounds=5))


@query
def push_backward_rounds(t):
    a = partner_arcs(t)
    return rounded(push.push(a, ppr.unit_seeds(graph.nodes(a)), 0.01, rounds=5, backward=True))


@query
def push_virtual_rounds(t):
    a = ps_arcs(t)
    return rounded(push.push(a, ppr.super_seeds(a, t.ps_members()), 0.0003, rounds=3))


@query
def push_forward_ps(t):
    """Push from the sources until no residue is over the threshold."""
    a = ps_arcs(t)
    return rounded(push.push(a, ppr.degree_seeds(a, t.ps_sources()), 0.0001))


@query
def push_backward_ps(t):
    return rounded(push.push(ps_arcs(t), ppr.unit_seeds(t.ps_sources()), 0.001, backward=True))


def _leaf(t, method):
    return rounded(approx.leaf_dppr(ps_rows(t), settle(t.ps_sources()), method))


@query
def fora(t):
    return _leaf(t, "fora")


@query
def fora_plus(t):
    return _leaf(t, "foraplus")


@query
def fora_tp(t):
    return _leaf(t, "foratp")


@query
def resacc(t):
    return _leaf(t, "foraresacc")


@query
def fpsn(t):
    return _leaf(t, "fpsn")


@query
def tau_push(t):
    a, sources = ps_arcs(t), settle(t.ps_sources())
    index = settle(approx.backward_index(a, sources.select("node", F.lit(0).cast("long").alias("comm"))))
    return rounded(approx.leaf_dppr(a, sources, "taupush", backward=index))


@query
def super_tau_push(t):
    return rounded(approx.super_dppr(ps_arcs(t), settle(t.ps_members()), "taupush"))


@query
def super_fora_tp(t):
    return rounded(approx.super_dppr(partner_arcs(t), settle(t.regions()), "foratp", k=5))


@query
def backward_index(t):
    return rounded(approx.backward_index(ps_arcs(t), settle(t.ps_members())))


@query
def simrank(t):
    return rounded(ppr.simrank(partner_arcs(t), steps=4))


# the engines that graphs beyond one task run on


@query
def ppr_truncated_join(t):
    return rounded(ppr.truncated(ps_arcs(t), ppr.unit_seeds(t.ps_sources()), engine="join"))


@query
def push_forward_join(t):
    a = partner_arcs(t)
    return rounded(push.push(a, ppr.degree_seeds(a), 0.01, rounds=5, engine="join"))


@query
def push_backward_join(t):
    a = partner_arcs(t)
    return rounded(push.push(a, ppr.unit_seeds(graph.nodes(a)), 0.01, rounds=5, backward=True, engine="join"))


@query
def fpsn_join(t):
    return rounded(approx.leaf_dppr(ps_arcs(t), settle(t.ps_sources()), "fpsn", engine="join"))


@query
def components_rounds(t):
    return cluster.components(graph.symmetric(t.chain()), engine="rounds")


@query
def walk_index_counts(t):
    """(source, walks): the walks of an index by their source."""
    return walk_index(t).groupBy("source").agg(F.count("*").alias("walks"))


def walk_index(t, a: DataFrame | None = None) -> DataFrame:
    a = ps_arcs(t) if a is None else a
    csr.compact(a)  # its size and degrees are asked for next
    acc = approx.accuracy(a)
    return walks.walk_index(a, *acc.index_threshold(acc.mean_degree))


REGISTRY["walk_index"] = lambda spark, sf_dir: walk_index(Tables(spark, sf_dir))


def _within(t, engine: str, methods: tuple[str, ...], indexed: bool = False) -> DataFrame:
    """(method, pairs, outside): the pairs of sources, and how many estimates differ from the exact value by more than the relative
    error of one half and the least mass that counts."""
    a, sources = ps_rows(t) if engine == "auto" else ps_arcs(t), settle(t.ps_sources())
    acc = approx.accuracy(a)
    index = settle(walk_index(t, a)) if indexed else None
    exact = settle(ppr.dppr(a, sources, targets=sources))
    least = sources.join(graph.weighted_degree(a), "node").select(F.col("node").alias("source"), (F.col("wdeg") * acc.delta).alias("least"))
    out = None
    for method in methods:
        found = approx.leaf_dppr(a, sources, method, engine=engine, index=index).withColumnRenamed("value", "estimate")
        both = exact.join(found, ["source", "node"], "left").join(least, "source")
        off = F.abs(F.coalesce("estimate", F.lit(0.0)) - F.col("value")) > 0.5 * F.greatest("value", "least")
        one = both.agg(F.count("*").alias("pairs"), F.sum(off.cast("long")).alias("outside")).select(F.lit(method).alias("method"), "pairs", "outside")
        out = one if out is None else out.unionByName(one)
    return out


@query
def walk_methods_bound(t):
    return _within(t, "auto", ("fora", "foraplus", "foratp", "foraresacc"))


@query
def walk_methods_bound_join(t):
    return _within(t, "join", ("fora",))


@query
def fora_indexed_bound(t):
    """With a stored walk index, topped up by walks made now."""
    return _within(t, "join", ("fora",), indexed=True)


# sources and sinks: written from the tables and read back


def _file(t, name: str) -> str:
    """A new path of the shared folder as a mounted file's."""
    path = f"{scratch(t.spark)}/{name}-{uuid.uuid4().hex}"
    if "://" in path and not path.startswith("file:"):
        raise ValueError("binary files need a folder that is mounted on all machines")
    return "/" + path.removeprefix("file:").lstrip("/")


def _folder(t, name: str) -> str:
    return f"{scratch(t.spark)}/{name}-{uuid.uuid4().hex}"


@query
def source_edge_list(t):
    path = _folder(t, "edges")
    text.write_edges(graph.canonical(t.ps()), path)
    return text.read_edges(t.spark, path, n=1 << 40).select("src", "dst")


@query
def source_weighted_edge_list(t):
    path = _folder(t, "edges")
    text.write_edges(t.trade(), path, weighted=True)
    return text.read_edges(t.spark, path, weighted=True)


@query
def source_binary_graph(t):
    path = _file(t, "graph")
    binary.write_csr(graph.symmetric(graph.renumber(graph.canonical(t.ps()).select("src", "dst"))), path, path + ".w")
    return binary.read_csr(t.spark, path, path + ".w")


@query
def source_positions(t):
    stem = _file(t, "positions")
    binary.write_positions(t.supplier_points().withColumn("r", F.col("x") / 2), stem)
    return rounded(binary.read_positions(t.spark, stem))


@query
def source_layout(t):
    path = _folder(t, "layout")
    binary.write_layout(t.supplier_points(), path)
    return rounded(binary.read_layout(t.spark, path))


@query
def source_partition(t):
    path = _folder(t, "partition")
    text.write_partition(t.ps_members(), path)
    cells = F.split("value", " ")
    return t.spark.read.text(path).select(cells[0].cast("long").alias("node"), cells[1].cast("long").alias("comm"))


@query
def source_membership(t):
    """Blocks of suppliers by nation."""
    path = _folder(t, "blocks")
    text.write_blocks(t.supplier.select(F.lit(0).alias("component"), F.lit(1).alias("level"), F.col("s_nationkey").cast("long").alias("id"), F.col("s_suppkey").alias("leaf")), "leaf", path)
    return text.read_membership(t.spark, path).select(F.col("component").cast("int"), F.col("level").cast("int"), F.col("id").cast("long"), "leaf")


@query
def source_hierarchy(t):
    path = _folder(t, "blocks")
    text.write_blocks(t.nation.select(F.lit(0).alias("component"), F.lit(2).alias("level"), F.col("n_regionkey").cast("long").alias("id"), F.col("n_nationkey").cast("long").alias("child_id")), "child_id", path)
    return text.read_hierarchy(t.spark, path).select(F.col("component").cast("int"), F.col("level").cast("int"), F.col("id").cast("long"), "child_id")


@query
def source_dnpr(t):
    path = _folder(t, "dnpr")
    index.save_dnpr(ppr.dnpr_closed(ps_arcs(t)), path)
    return rounded(index.load_dnpr(t.spark, path), 12)


@query
def source_backward_index(t):
    """The stored index of one supernode: the first nation's suppliers."""
    path, members = _folder(t, "backward"), settle(t.ps_members())
    index.save_backward(approx.backward_index(ps_arcs(t), members), members, path)
    return rounded(index.load_backward(t.spark, path, 1000))


@query
def sidecar_counts(t):
    """n and m of a written sidecar."""
    path, found = _folder(t, "sidecar"), graph.stats(graph.symmetric(t.ps())).first()
    t.spark.createDataFrame([(f"n={found.n}",), (f"m={found.m}",)], "value string").coalesce(1).write.text(path)
    return t.spark.createDataFrame(sorted(text.read_sidecar(t.spark, path).items()), "name string, stated long")


@query
def neighbors(t):
    """Of the first nation."""
    return graph.neighbours(partner_arcs(t), 0)


@query
def supernode_names(t):
    """Names of nations under regions, parsed back."""
    name = supernode_name(F.lit(0), F.lit(1), F.col("n_nationkey"))
    c, level, ident = parse_supernode(name)
    return t.nation.select(name.alias("name"), c.cast("int").alias("component"), level.cast("int").alias("level"), ident.cast("long").alias("id"))


# distances


@query
def pdist(t):
    return rounded(distance.ppr_distance(partner_arcs(t)))


@query
def pdist_vanilla(t):
    return rounded(distance.ppr_distance(partner_arcs(t), degree_weighted=False))


@query
def pdist_unclamped(t):
    return rounded(distance.ppr_distance(partner_arcs(t), clamp=False))


@query
def pdist_natural_log(t):
    a = partner_arcs(t)
    return rounded(ppr.symmetrised(ppr.dppr(a, tolerance=1e-12)).select("i", "j", pdist_natural(F.col("value")).alias("d")), 7)


@query
def radius_inflate(t):
    """Distances of nations inflated by radii of their numbers of customers."""
    sizes = t.customer.groupBy(F.col("c_nationkey").cast("long").alias("node")).agg(F.count("*").alias("size"))
    return rounded(distance.inflate(distance.ppr_distance(partner_arcs(t)), sizes)[0])


@query
def component_weight_boost(t):
    a = settle(graph.symmetric(t.chain()))
    return rounded(distance.boost_small(distance.weights(distance.ppr_distance(a, most=None)), settle(cluster.components(a)), share=0.5).select("i", "j", "w"))


@query
def hop_distance(t):
    return distance.hop_distance(partner_arcs(t))


# clusters


@query
def connected_components(t):
    return cluster.components(graph.symmetric(t.forest()))


@query
def largest_component(t):
    return cluster.largest_component(cluster.components(graph.symmetric(t.chain())))


@query
def modularity(t):
    return rounded(cluster.modularity(ps_arcs(t), t.ps_members()))


@query
def merge_gain(t):
    return rounded(cluster.merge_gain(ps_arcs(t), t.ps_members()), 7)


@query
def neighbor_communities(t):
    return cluster.neighbour_communities(ps_arcs(t), t.ps_members())


@query
def coarsen(t):
    return cluster.coarsen(ps_arcs(t), t.ps_members())


@query
def hierarchy_expand(t):
    """Suppliers under nations (level 1) and regions (level 2)."""
    leaves = t.supplier.select(F.lit(0).alias("component"), F.lit(1).alias("level"), F.col("s_nationkey").cast("long").alias("id"), F.col("s_suppkey").alias("leaf"))
    up = t.nation.select(F.lit(0).alias("component"), F.lit(2).alias("level"), F.col("n_regionkey").cast("long").alias("id"), F.col("n_nationkey").cast("long").alias("child_id"))
    return cluster.expand(up, leaves)


@query
def cluster_stats(t):
    return rounded(approx.cluster_stats(ps_arcs(t), t.ps_members()))


@query
def community_sizes(t):
    return cluster.size_stats(t.ps_members())


@query
def cluster_mean_dnpr(t):
    return rounded(cluster.cluster_mean(ppr.dnpr_closed(ps_arcs(t)), t.ps_members()), 12)


@query
def louvain(t):
    return cluster.louvain(ps_rows(t))[-1]


@query
def louvain_plus(t):
    return cluster.louvain_plus(ps_rows(t))[0]


# selection


@query
def top_k_hubs(t):
    return rounded(cluster.top_k_hubs(ppr.dnpr_closed(ps_arcs(t)), t.ps_members(), 25), 12)


@query
def tau_targets(t):
    a = ps_arcs(t)
    return rounded(approx.tau_targets(ppr.dnpr_closed(a), approx.accuracy(a).tau_max / 10), 12)


@query
def tau_split(t):
    a = ps_arcs(t)
    return rounded(approx.tau_split(ppr.dnpr_closed(a), approx.accuracy(a).tau_max / 10), 12)


@query
def zoom_path(t):
    """The supernodes on a seeded way down from the root."""
    membership, hierarchy = cluster.louvain_plus(ps_rows(t))
    return t.spark.createDataFrame(cluster.random_path(hierarchy, membership), "level int, id long")


# layouts


@query
def layout_single(t):
    return layout.single_level(partner_arcs(t))


@query
def layout_cluster(t):
    """The regions' nations as one zoomed-in cluster."""
    a = partner_arcs(t)
    nodes = graph.nodes(a)
    return layout.cluster_layout(settle(ppr.dppr(a)), nodes.select("node", F.lit(1).alias("size")), nodes.count())


@query
def layout_hop_mds(t):
    return layout.hop_mds(partner_arcs(t))


@query
def layout_force(t):
    a = partner_arcs(t)
    return layout.plane_layout(a, "fr").withColumn("method", F.lit("fr")).unionByName(layout.plane_layout(a, "forceatlas").withColumn("method", F.lit("forceatlas"))).unionByName(layout.plane_layout(a, "linlog").withColumn("method", F.lit("linlog")))


@query
def layout_pivot(t):
    return layout.plane_layout(partner_arcs(t), "pivot")


@query
def layout_maxent(t):
    return layout.plane_layout(partner_arcs(t), "maxent")


@query
def min_bounding_box(t):
    return rounded(layout.minimum_box(t.supplier_points()), 6)


@query
def rescale(t):
    return rounded(layout.rescale(t.supplier_points()))


@query
def best_fit(t):
    return rounded(layout.best_fit(t.supplier_points()))


@query
def plot_extent(t):
    return rounded(layout.extent(t.supplier_points().withColumn("r", F.sqrt(F.abs("x")))))


# metrics


@query
def node_distribution(t):
    return rounded(metrics.node_distribution(t.supplier_points()))


@query
def edge_length_cv(t):
    return rounded(metrics.edge_length_cv(graph.canonical(t.partners()), t.nation_points()))


@query
def angular_resolution(t):
    return rounded(metrics.angular_resolution(partner_arcs(t), t.nation_points()))


@query
def segment_orientation(t):
    """The turn at each supplier's neighbour on the chain of its nation."""
    p, e = t.supplier_points(), t.chain()
    rows = e.alias("e").join(e.alias("f"), F.col("e.dst") == F.col("f.src")).select(F.col("e.src").alias("a"), F.col("e.dst").alias("b"), F.col("f.dst").alias("c"))
    for k in "abc":
        rows = rows.join(p.select(F.col("node").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y")), k)
    return rows.select("a", "b", "c", orientation(*(F.col(f"{k}{d}") for k in "abc" for d in "xy")).alias("turn"))


@query
def crossing_ratio(t):
    return rounded(metrics.crossing_ratio(graph.canonical(t.partners()), t.nation_points()))


@query
def evaluate_layout(t):
    return rounded(metrics.evaluate(partner_arcs(t), t.nation_points()))

"""Zooming into a hierarchy: DPPR between the children of a supernode, then their layout."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import approx, cluster, graph, layout, ppr, walks
from .loop import settle


@dataclass
class Atlas:
    """A graph with its hierarchy and the indexes that a method needs."""

    arcs: DataFrame
    membership: DataFrame
    hierarchy: DataFrame
    k: int = 25
    method: str = "taupush"
    seed: int = 2
    backward: DataFrame | None = None
    n: int = field(default=0)
    #: stored walks (source, walk_no, dest); with them the push-and-walk methods run as joins
    walks: DataFrame | None = None
    alpha: float = ppr.ALPHA

    @classmethod
    def build(cls, edges: DataFrame, k: int = 25, method: str = "taupush", seed: int = 2, **how) -> "Atlas":
        """Cluster a graph and build the index of ``method``."""
        arcs = settle(graph.symmetric(edges))
        membership, hierarchy = cluster.louvain_plus(arcs, k, seed, **how)
        atlas = cls(arcs, membership, hierarchy, k, method, seed)
        if method == "taupush":
            atlas.backward = settle(atlas.backward_index())
        return atlas

    def leaves(self) -> DataFrame:
        """(node, comm): level-1 clusters."""
        return self.membership.where("level = 1").select(F.col("leaf").alias("node"), F.col("id").alias("comm"))

    def backward_index(self) -> DataFrame:
        return approx.backward_index(self.arcs, self.leaves(), self.k, self.alpha)

    def walk_index(self) -> DataFrame:
        """The walks that ``method`` asks of an index: those of foratp for k leaves at once, of foraplus with a forced first hop."""
        acc = approx.accuracy(self.arcs, self.k)
        spread = acc.mean_degree * (self.k if self.method == "foratp" else 1)
        return walks.walk_index(self.arcs, *acc.index_threshold(spread), self.alpha, self.seed, plus=self.method == "foraplus")

    def __post_init__(self):
        self.n = self.n or graph.nodes(self.arcs).count()

    def children(self, component: int, level: int, ident: int) -> DataFrame:
        """(node, comm): the leaves of each child."""
        return cluster.child_membership(self.hierarchy, self.membership, component, level, ident)

    def proximity(self, component: int, level: int, ident: int) -> DataFrame:
        """(source, target, value) between the children of a supernode."""
        members = settle(self.children(component, level, ident))
        if level == 1:
            return approx.leaf_dppr(self.arcs, members.select("node"), self.method, self.k, self.alpha, self.seed, backward=self.backward, index=self.walks).withColumnRenamed("node", "target")
        return approx.super_dppr(self.arcs, members, self.method, self.k, self.alpha, self.seed, index=self.walks)

    def zoom(self, component: int, level: int, ident: int) -> DataFrame:
        """(node, x, y, stress, r) of the children."""
        sizes = self.children(component, level, ident).groupBy(F.col("comm").alias("node")).agg(F.count("*").alias("size"))
        return layout.cluster_layout(settle(self.proximity(component, level, ident)), settle(sizes), self.n, self.seed)

    def path(self, component: int = 0, embed: bool = True) -> list[tuple[int, int, DataFrame]]:
        """A random way down: the layout (or the proximity) at each level."""
        step = self.zoom if embed else self.proximity
        return [(level, ident, step(component, level, ident)) for level, ident in cluster.random_path(self.hierarchy, self.membership, self.seed, component)]

    def hubs(self, k: int | None = None) -> DataFrame:
        """The level-1 clusters of the k nodes of highest DNPR."""
        return cluster.top_k_hubs(ppr.dnpr_closed(self.arcs, alpha=self.alpha), self.leaves(), k or self.k)

    def whole(self) -> DataFrame:
        """All nodes as one cluster, exactly; for small graphs."""
        nodes = graph.nodes(self.arcs)
        return layout.cluster_layout(ppr.dppr(self.arcs), nodes.select("node", F.lit(1).alias("size")), self.n, self.seed)

    def draw(self, component: int, level: int, ident: int, **how) -> str:
        """An SVG of the children and the arcs between them."""
        coarse, _ = cluster.cluster_subgraph(self.arcs, self.children(component, level, ident))
        return layout.svg(self.zoom(component, level, ident), coarse.where("src < dst"), **how)

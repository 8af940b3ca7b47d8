"""Command line: benchmark, view, convert, cluster, dppr.

    python -m lattigraph.cli benchmark --edges graph.txt --method ppr --mode metrics --repeat 3
"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import cluster, graph, layout, metrics, ppr
from .plans.loop import settle
from .plans.zoom import Atlas
from .sources import binary, index, text


def _session() -> SparkSession:
    return SparkSession.builder.appName("lattigraph").getOrCreate()


def benchmark(o) -> dict:
    spark = _session()
    arcs = settle(graph.symmetric(text.read_edges(spark, o.edges), self_loops="keep"))
    if o.mode == "plot":
        points = settle(binary.read_layout(spark, o.layout) if o.layout else layout.layout(arcs, o.method, o.seed))
        with open(o.out or f"{o.method}.svg", "w") as f:
            f.write(layout.svg(points, arcs.where("src < dst")))
        return {"points": points.count()}
    runs = []
    for i in range(o.repeat):
        points = settle(binary.read_layout(spark, o.layout) if o.layout else layout.layout(arcs, o.method, o.seed + i))
        runs.append(metrics.evaluate(arcs, points).first())
    return {k: sum(r[k] for r in runs) / len(runs) for k in ("nd", "ulcv", "ar")}


def view(o) -> dict:
    spark = _session()
    arcs = settle(graph.symmetric(text.read_edges(spark, o.edges)))
    atlas = Atlas(arcs, text.read_membership(spark, o.mapping), text.read_hierarchy(spark, o.hierarchy), o.k, o.method, o.seed)
    component, level, ident = (int(x) for x in o.supernode.split(","))
    with open(o.out, "w") as f:
        f.write(atlas.draw(component, level, ident))
    return {"out": o.out}


def convert(o) -> dict:
    edges = text.read_edges(_session(), o.edges, weighted=o.weighted)
    arcs = settle(graph.symmetric(graph.renumber(edges) if o.renumber else edges, "keep", sum_parallel=o.weighted))
    binary.write_csr(arcs, o.out, f"{o.out}.weights" if o.weighted else None)
    return dict(zip(("n", "m", "avg_degree"), graph.stats(arcs).first()))


def cluster_command(o) -> dict:
    arcs = settle(graph.symmetric(text.read_edges(_session(), o.edges)))
    began = time.time()
    if o.method == "louvain":
        levels = cluster.louvain(arcs, o.seed)
        text.write_partition(levels[-1], o.out)
        return {"levels": len(levels), "modularity": cluster.modularity(arcs, levels[-1]).first()[0], "seconds": time.time() - began}
    membership, hierarchy = cluster.louvain_plus(arcs, o.k, o.seed, o.hard_cap, o.all_components)
    text.write_blocks(membership, "leaf", f"{o.out}/mapping")
    text.write_blocks(hierarchy, "child_id", f"{o.out}/hierarchy")
    cluster.roots(membership).select("name").write.text(f"{o.out}/root")
    return {"levels": membership.agg(F.max("level")).first()[0], "seconds": time.time() - began}


def dppr(o) -> dict:
    spark = _session()
    arcs = settle(graph.symmetric(text.read_edges(spark, o.edges)))
    atlas = Atlas(arcs, text.read_membership(spark, o.mapping), text.read_hierarchy(spark, o.hierarchy), o.k, o.method, o.seed)
    atlas.alpha = o.alpha
    indexed = o.method in ("fora", "foraplus", "foratp")
    if o.build:
        began = time.time()
        if o.method == "taupush":
            index.save_backward(atlas.backward_index(), atlas.leaves(), f"{o.build}/backward")
        elif indexed:
            atlas.walk_index().write.mode("overwrite").parquet(f"{o.build}/walks")
        index.save_dnpr(ppr.dnpr_closed(arcs, alpha=o.alpha), f"{o.build}/dnpr")
        return {"index": o.build, "seconds": time.time() - began}
    if o.method == "taupush":
        atlas.backward = index.load_backward(spark, f"{o.index}/backward") if o.index else settle(atlas.backward_index())
    elif indexed and o.index:
        atlas.walks = spark.read.parquet(f"{o.index}/walks")
    ways = None
    if o.hubs:  # the clusters of the nodes of highest DNPR instead of random ways down
        dnpr = index.load_dnpr(spark, f"{o.index}/dnpr") if o.index else ppr.dnpr_closed(arcs, alpha=o.alpha)
        ways = [r.comm for r in cluster.top_k_hubs(dnpr, atlas.leaves(), o.sample).orderBy("rank").collect()]
    out = []
    for i in range(o.sample if ways is None else len(ways)):
        began = time.time()
        if ways is None:
            atlas.seed = o.seed + i
            rows = sum(df.count() for _, _, df in atlas.path(embed=o.embed))
        else:
            rows = (atlas.zoom if o.embed else atlas.proximity)(0, 1, ways[i]).count()
        out.append({"seconds": time.time() - began, "rows": rows} | ({} if ways is None else {"hub": ways[i]}))
    return {"paths": out}


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lattigraph")
    sub = p.add_subparsers(required=True)

    def command(name, run, **flags):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for flag, default in flags.items():
            option = "--" + flag.replace("_", "-")
            if default is False:
                c.add_argument(option, action="store_true")
            elif default is str:
                c.add_argument(option, required=True)
            else:
                c.add_argument(option, default=default, type=type(default) if default is not None else str)

    command("benchmark", benchmark, edges=str, method="ppr", mode="metrics", repeat=1, seed=0, layout=None, out=None)
    command("view", view, edges=str, mapping=str, hierarchy=str, supernode=str, method="taupush", k=25, seed=2, out="view.svg")
    command("convert", convert, edges=str, out=str, weighted=False, renumber=False)
    command("cluster", cluster_command, edges=str, out=str, method="louvainplus", k=25, seed=1, hard_cap=False, all_components=False)
    command("dppr", dppr, edges=str, mapping=str, hierarchy=str, method="taupush", k=25, sample=1, embed=False, seed=2, alpha=0.2, hubs=False, build=None, index=None)
    o = p.parse_args(args)
    print(json.dumps(o.run(o)))


if __name__ == "__main__":
    main()

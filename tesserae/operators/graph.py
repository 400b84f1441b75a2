"""Dependency graphs: edges(src, dst), a directed multigraph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import cut


def fan_in(edges: DataFrame) -> DataFrame:
    """(node, edges, importers): how many edges end at a node, and from how many nodes."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("src").alias("importers"))


def hubs(edges: DataFrame, least: int = 5, python_least: int = 3, sizes: tuple[int, int] = (500, 100), limits: tuple[int, int, int] = (15, 10, 5), sources: DataFrame | None = None) -> DataFrame:
    """(node, edges, rank): nodes of high fan-in, as many as the number of sources allows; without sources, that of linked nodes."""
    counted = fan_in(edges).where(F.col("edges") >= F.when(F.col("node").endswith(".py"), python_least).otherwise(least))
    linked = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct() if sources is None else sources
    nodes = linked.agg(F.count(F.lit(1)).alias("n"))
    limit = F.when(F.col("n") > sizes[0], limits[0]).when(F.col("n") > sizes[1], limits[1]).otherwise(limits[2])
    top = counted.orderBy(F.desc("edges"), "node").limit(max(limits)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("edges"), "node")))
    return top.crossJoin(F.broadcast(nodes)).where(F.col("rank") <= limit).select("node", "edges", "rank")


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 20, damping: float = 0.85) -> DataFrame:
    """(node, score) after so many synchronous rounds from 1/n; dangling mass isn't handed on.

    Multi-edges are folded into weights m / out-degree once. Degrees count edges that leave the node set. Inputs are
    checkpointed, and the state's lineage is cut every fifth round.
    """
    nodes = cut(nodes.select("node").distinct())
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("score"))
    degrees = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    weights = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m")).join(degrees, "src").select("src", "dst", (F.col("m") / F.col("degree")).alias("w"))
    weights = cut(weights.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").join(nodes.select(F.col("node").alias("src")), "src", "left_semi"))
    ranks = nodes.select("node", F.lit(1.0 / n).alias("score"))
    base = nodes.select("node", F.lit((1 - damping) / n).alias("score"))
    for k in range(iterations):
        # What every node gets anyway is a summand too: one join and one aggregation a round.
        given = weights.join(ranks, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), (F.lit(damping) * F.col("w") * F.col("score")).alias("score"))
        ranks = given.unionByName(base).groupBy("node").agg(F.sum("score").alias("score"))
        if k % 5 == 4:
            ranks = cut(ranks)
    return ranks


def cycles(edges: DataFrame, longest: int = 5) -> DataFrame:
    """(length, path) of every simple cycle up to a length, once each, from its smallest node.

    A complete, order-free answer: walks start at a cycle's smallest node and never visit a smaller one. The walks of
    each length are cut, so that none is walked twice.
    """
    e = cut(edges.select("src", "dst").distinct())
    walks = e.where("src <= dst").select(F.col("src").alias("start"), F.col("dst").alias("end"), F.array("src").alias("path"))
    found = []
    for k in range(1, longest + 1):
        found.append(walks.where("start = end").select(F.lit(k).alias("length"), F.array_join(F.col("path").cast("array<string>"), ">").alias("path")))
        if k < longest:
            step = walks.where("start <> end").join(e, F.col("end") == F.col("src"))
            step = step.where((F.col("dst") >= F.col("start")) & ~F.array_contains(F.slice("path", 2, longest), F.col("dst")) & (F.col("dst") != F.col("end")))
            walks = cut(step.select("start", F.col("dst").alias("end"), F.concat("path", F.array("end")).alias("path")))
    return reduce(DataFrame.unionByName, found)


def orphans(nodes: DataFrame, edges: DataFrame, excluded: Column | None = None) -> DataFrame:
    """(node) without any edge."""
    linked = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    out = nodes.select("node").distinct().join(linked, "node", "left_anti")
    return out if excluded is None else out.where(~excluded)


def facades(edges: DataFrame, hub_nodes: DataFrame, is_facade: Column, folder: Column) -> DataFrame:
    """(node, members): what a hub that is_facade (over `src`) passes on from its own folder, hubs left out."""
    hub = hub_nodes.select("node").distinct()
    e = edges.where(is_facade).join(hub.withColumnRenamed("node", "src"), "src", "left_semi").join(hub.withColumnRenamed("node", "dst"), "dst", "left_anti")
    rows = e.select("src", "dst").distinct()
    sides = [rows.select(F.col(c).alias("node")).distinct().select(F.col("node").alias(c), folder.alias(f"f_{c}")) for c in ("src", "dst")]
    rows = rows.join(sides[0], "src").join(sides[1], "dst").where("f_src = f_dst")
    return rows.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_list("dst")).alias("members"))


def two_hops(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(src, dst, ways): nodes reached over one other, not directly and not themselves.

    As many rows as there are ways go through a node, in-edges times out-edges: give `most` to leave out middle nodes of
    more ways than that, as utilities that everything passes through say nothing about a pair.
    """
    e = edges.select("src", "dst").distinct()
    if most is not None:
        ins, outs = e.groupBy(F.col("dst").alias("mid")).agg(F.count(F.lit(1)).alias("i")), e.groupBy(F.col("src").alias("mid")).agg(F.count(F.lit(1)).alias("o"))
        fit = ins.join(outs, "mid").where(F.col("i") * F.col("o") <= most)
        first = e.join(fit.select(F.col("mid").alias("dst")), "dst", "left_semi").select("src", "dst")
    else:
        first = e
    far = first.alias("x").join(e.alias("y"), F.col("x.dst") == F.col("y.src")).select(F.col("x.src").alias("src"), F.col("y.dst").alias("dst")).where("src <> dst")
    return far.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("ways")).join(e, ["src", "dst"], "left_anti")


def blast_radius(edges: DataFrame, fragile: DataFrame, hub_nodes: DataFrame) -> DataFrame:
    """(node, dependents, hub, fragile, risk): high for hubs or ten and more dependents, medium for fragile ones or five."""
    h = hub_nodes.select("node", F.lit(True).alias("hub"))
    f = fragile.select("node", F.lit(True).alias("fragile"))
    out = edges.where("src <> dst").groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("dependents")).join(h, "node", "left").join(f, "node", "left").fillna(False, ["hub", "fragile"])
    risk = F.when(F.col("hub") | (F.col("dependents") >= 10), "high").when(F.col("fragile") | (F.col("dependents") >= 5), "medium").otherwise("low")
    return out.withColumn("risk", risk)


def ring_layout(ranked: DataFrame, rings: tuple[int, ...] = (1, 3, 4, 6, 8), squish: float = 0.6) -> DataFrame:
    """(node, ring, x, y) of nodes (node, rank from 1): the first in the centre, the next on rings around it."""
    ends = [sum(rings[: k + 1]) for k in range(len(rings))]
    ring = F.lit(len(rings) - 1)
    for k in range(len(rings) - 1, -1, -1):
        ring = F.when(F.col("rank") <= ends[k], k).otherwise(ring)
    starts = F.element_at(F.array(*(F.lit(e - r) for e, r in zip(ends, rings, strict=True))), F.col("ring") + 1)
    size = F.element_at(F.array(*map(F.lit, rings)), F.col("ring") + 1)
    angle = 2 * F.pi() * (F.col("rank") - 1 - starts) / size
    rows = ranked.where(F.col("rank") <= ends[-1]).withColumn("ring", ring)
    return rows.select("node", "ring", F.round(F.col("ring") * F.cos(angle), 6).alias("x"), F.round(F.col("ring") * F.sin(angle) * squish, 6).alias("y"))

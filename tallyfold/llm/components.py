"""Connected components by alternating large-star and small-star.

Edges and labels stay distributed. One round is two aggregates (the smallest
neighbour of every node) with their joins, written to the shared folder; only three counts
reach the driver, to see that every node hangs on a root: then no round is left to do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import hot_keys, split_join, staged


def _star(edges: DataFrame, total: int, *, large: bool) -> DataFrame:
    """``edges`` (u, v), u > v. Every node links some neighbours to its smallest one.

    Large star: the larger neighbours. Small star: the smaller ones and itself. ``total`` is about
    the number of edges: the neighbours of a node with a large part of them are split.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")).select("u", F.least("m", "u").alias("m"), "k")
    joined = split_join(both, least.select("u", "m"), ["u"], F.col("v"), hot_keys(least, "u", "k", total))
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def _stars(edges: DataFrame) -> tuple[int, bool]:
    """The number of ``edges`` (u, v), u > v, and whether all are of stars: no node has two smaller neighbours, or smaller and larger ones."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("down")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.down").alias("down"), F.count("*").alias("k"))
    wrong = F.count(F.when((F.col("down") > 1) | ((F.col("down") == 1) & (F.col("k") > 1)), 1))
    found = nodes.agg(F.sum("down").alias("n"), wrong.alias("wrong")).first()
    return found.n or 0, found.wrong == 0


def components(links: DataFrame, *, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node that has a link.

    ``links`` may hold either direction, repeats and self links.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    edges = staged(edges, "links")
    for _ in range(max_rounds):
        total, settled = _stars(edges)
        if settled:
            break
        edges = staged(_star(_star(edges, total, large=True), total, large=False), "star")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )

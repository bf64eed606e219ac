"""Connected components of a table of links, by contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each end of `links` (a long, b long); a component is named by its least node.

    In each round every node goes to the neighbour, or itself, that is least in that round's order, and links are renamed
    and made distinct. The first order is the nodes' own, which stars around their least node need only one round of; the
    others are hashes under a new seed, by which a constant share of the nodes goes each time, so rounds grow with the logarithm
    of the longest path. A node with very many links only ever meets partial aggregates and joins that Spark can split.
    """
    edges = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    where = None
    round_ = 0
    while edges.first() is not None:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = (lambda c: F.xxhash64(c, F.lit(round_))) if round_ else F.col  # noqa: E731, B023
        nearest = both.groupBy(F.col("a").alias("node")).agg(F.min_by("b", order("b")).alias("next"), F.min(order("b")).alias("h"))
        own = order("node")
        step = cut(nearest.select("node", F.when(own <= F.col("h"), F.col("node")).otherwise(F.col("next")).alias("next")))
        to_a, to_b = (step.select(F.col("node").alias(x), F.col("next").alias(f"new_{x}")) for x in "ab")
        renamed = edges.join(to_a, "a").join(to_b, "b").select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b"))
        fewer = cut(renamed.where("a <> b").distinct())
        if where is None:
            now = step.select("node", F.col("next").alias("at"))
        else:
            moved = step.select(F.col("node").alias("at"), "next")
            now = cut(where.join(moved, "at", "left").select("node", F.coalesce("next", "at").alias("at")))
        for old in (edges, *([where] if where is not None else [])):
            drop(old)
        where, edges, round_ = now, fewer, round_ + 1
    drop(edges)
    if where is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component")).where(F.lit(False))
    names = where.groupBy("at").agg(F.min("node").alias("component"))
    return where.join(names, "at").select("node", "component")

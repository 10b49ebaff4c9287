"""Distributed connected components: alternating large-star and small-star rounds.

Each half round is an aggregation (with map-side combine) and an equi-join that adaptive execution can split
where one node has very many neighbours; no neighbourhood is ever gathered in one task or on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stash

#: Rounds needed grow with the logarithm of the longest path; this many would suit any graph that fits a disk.
MOST_ROUNDS = 100


def _is_star_forest(edges: DataFrame) -> bool:
    """edges (a > b): whether every node points at one root, and no root points anywhere."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("out")).unionAll(edges.select(F.col("b"), F.lit(0)))
    bad = ends.groupBy("n").agg(F.sum("out").alias("out"), F.min("out").alias("least")).where("out > 1 or (out = 1 and least = 0)")
    return bad.isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b): (node, component) of every node that has a link, component the smallest node reachable.

    Null ends and loops are ignored; repeated links count once; no links give an empty table.
    """
    edges = stash(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(MOST_ROUNDS):
        if _is_star_forest(edges):
            break
        after = stash(_small_star(_large_star(edges)))
        drop(edges)
        edges = after
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionAll(edges.select(F.col("b"), F.col("b")).distinct())

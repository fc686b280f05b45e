"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import staged
from plumbline.plans.staging import broadcast_if_small


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b long) that is not itself a root.

    Alternating large-star and small-star rounds: neighbours are re-linked to the
    smallest node in reach until every component is a star around its minimum. Groups are
    reduced by map-side minima, which are written and joined back, by broadcast if counted
    few, else so that Spark may split a hub; each round is written to the shared folder.
    """
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = staged(ordered.distinct())
    mark = _mark(now)
    while True:
        now = staged(_small_star(staged(_large_star(now))))
        before, mark = mark, _mark(now)
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """Changes when any edge does: a count and two independent hash sums."""
    parts = [F.sum(F.xxhash64(F.lit(seed), "a", "b").cast("decimal(38,0)")) for seed in (1, 2)]
    return tuple(edges.agg(F.count("*"), *parts).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")))
    joined = both.filter("v > u").join(broadcast_if_small(least), F.col("u") == F.col("w"))
    return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = staged(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("w"), "m"))
    moved = edges.join(broadcast_if_small(least), F.col("a") == F.col("w")).filter("b <> m")
    moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("w").alias("a"), F.col("m").alias("b"))).distinct()

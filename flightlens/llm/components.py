"""Connected components of an edge table, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlens.llm.runtime import forget, staged


def _large_stars(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to the smallest of the node and its neighbours."""
    both = edges.select(F.col("high").alias("u"), F.col("low").alias("v")).union(
        edges.select(F.col("low").alias("u"), F.col("high").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("least"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("high"), F.col("least").alias("low")).distinct()


def _small_stars(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of these."""
    least = edges.groupBy("high").agg(F.min("low").alias("least"))
    moved = edges.join(least, "high").filter("low <> least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return least.select("high", F.col("least").alias("low")).union(moved).distinct()


def components(edges: DataFrame, rounds: list | None = None) -> DataFrame:
    """``node, component`` for every node that ``edges`` (``u, v`` long) link to another: the smallest reachable node.

    A round contracts large stars, then small ones; the edges never become
    more, and a chain of n nodes is one star after about log n rounds (2,000
    shuffled nodes: 10). Rounds end when the edges stand still, each then a
    node and its component. Every round is a written table that replaces the
    one before, so a lost executor repeats one round at most. Only a count and
    a checksum reach the driver. ``rounds`` takes the number of edges after each.
    """
    spark = edges.sparkSession

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("high", "low"))).first())

    now = staged(edges.filter("u <> v").select(F.greatest("u", "v").alias("high"), F.least("u", "v").alias("low")).distinct())
    was = state(now)
    while was[0]:
        new = staged(_small_stars(_large_stars(now)))
        forget(spark, now)
        now, before, was = new, was, state(new)
        if rounds is not None:
            rounds.append(was[0])
        if was == before:
            break
    return now.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(
        now.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())

"""Top-N levels of a factor as a table: for level sets too large for a literal list.

The levels are counted, ranked over all tasks and written; a factor is folded
by a join with the table, whose measured size decides between a broadcast and
a sorted join (where adaptive execution splits a hot level). No level reaches
the driver, and no plan grows with N. For a model's own factors, a design
column per level, the literal list of ``columns.top_or_other`` stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..session import written


def top_level_table(df: DataFrame, col: str, n: int) -> DataFrame:
    """``level, n, rank``: the ``n`` most frequent levels (ties: by the level), written; null is no level.

    Ranks come from sorted ranges: each range is counted where it lies, and a
    level's rank is its place in its range after the rows of the ranges before.
    Only the counts per range are collected; ranges beyond ``n`` are not read again.
    """
    order = (F.col("n").desc(), F.col("level"))
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    ranges = written(counts.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before, wanted = 0, []
    for r in sorted(ranges.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).collect(), key=lambda r: r["part"]):
        if before < n:
            wanted.append((r["part"], before))
        before += r["rows"]
    offsets = df.sparkSession.createDataFrame(wanted, "part int, before long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    ranked = ranges.join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + place)     # a row per range
    return written(ranked.filter(F.col("rank") <= n).select("level", "n", "rank"))


def fold_levels(df: DataFrame, col: str, levels: DataFrame, out: str, other: str = C.OTHER_LEVEL) -> DataFrame:
    """``df`` with ``out``: the level as text if it is in ``levels``, else ``other`` (null too)."""
    known = levels.select(F.col("level").alias("_level"))
    return (df.join(known, F.col(col) == F.col("_level"), "left")
            .withColumn(out, F.coalesce(F.col("_level").cast("string"), F.lit(other))).drop("_level"))


def other_share(df: DataFrame, levels: DataFrame) -> DataFrame:
    """``rows, rows_other, other_pct``: what folding puts into OTHER, from the counts of ``levels``, without a join."""
    top = levels.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("top")).first()["top"]
    n = F.count(F.lit(1))
    return df.agg(n.alias("rows"), (n - F.lit(top)).alias("rows_other"),
                  F.try_divide((n - F.lit(top)).cast("double") * F.lit(100.0), n).alias("other_pct"))

"""Dates within any interval of a table: holiday windows as data.

A range join without comparing every date with every interval: intervals are
cut at the ends of months, and the pieces of a month are merged until none
overlap or touch. What is left has at most 16 rows a month, however many
intervals there are, how long they are and how often they repeat, and a date
lies in one of them at most. So the join is an equality of months with the
range as a residual condition, and no row is doubled. The merged table is
written first; its measured size decides whether it is broadcast.

Intervals with a null end or an end before their start hold no date; a null
date lies in no interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def holiday_windows(holidays: DataFrame, days: int, day_col: str = "day") -> DataFrame:
    """``first_day, last_day``: ``days`` days around each holiday of a table."""
    d = F.col(day_col).cast("date")
    return holidays.select(F.date_sub(d, days).alias("first_day"), F.date_add(d, days).alias("last_day"))


def _month(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d) - 1


def disjoint_by_month(intervals: DataFrame, first: str = "first_day", last: str = "last_day") -> DataFrame:
    """``bucket, first_day, last_day``: the days of all intervals as pieces that do not overlap, month by month."""
    a, b = F.col("first_day"), F.col("last_day")
    start = F.make_date((F.col("bucket") / 12).cast("int"), F.col("bucket") % 12 + 1, F.lit(1))
    cut = (intervals.select(F.col(first).cast("date").alias("first_day"), F.col(last).cast("date").alias("last_day"))
           .filter(a <= b).distinct()
           .select(F.explode(F.sequence(_month(a), _month(b))).alias("bucket"), "first_day", "last_day")
           .select("bucket", F.greatest(a, start).alias("first_day"), F.least(b, F.last_day(start)).alias("last_day")).distinct())
    by_month = Window.partitionBy("bucket").orderBy("first_day", "last_day")      # a few hundred distinct pieces at most
    reach = F.max("last_day").over(by_month.rowsBetween(Window.unboundedPreceding, -1))
    parted = cut.withColumn("fresh", F.when(F.coalesce(a <= F.date_add(reach, 1), F.lit(False)), 0).otherwise(1))
    return (parted.withColumn("island", F.sum("fresh").over(by_month)).groupBy("bucket", "island")
            .agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day")).drop("island"))


def _joined(df: DataFrame, date_col: str, intervals: DataFrame, first: str, last: str, how: str) -> DataFrame:
    pieces = written(disjoint_by_month(intervals, first, last)).select(
        F.col("bucket").alias("_bucket"), F.col("first_day").alias("_first"), F.col("last_day").alias("_last"))
    d = F.col(date_col).cast("date")
    return df.join(pieces, (_month(d) == F.col("_bucket")) & d.between(F.col("_first"), F.col("_last")), how)


def flag_in_intervals(df: DataFrame, date_col: str, intervals: DataFrame, flag: str, first: str = "first_day",
                      last: str = "last_day") -> DataFrame:
    """All rows, with ``flag``: is the date in any interval?"""
    out = _joined(df, date_col, intervals, first, last, "left")
    return out.withColumn(flag, F.col("_bucket").isNotNull()).drop("_bucket", "_first", "_last")


def in_intervals(df: DataFrame, date_col: str, intervals: DataFrame, first: str = "first_day",
                 last: str = "last_day") -> DataFrame:
    """The rows whose date is in any interval."""
    return _joined(df, date_col, intervals, first, last, "left_semi")

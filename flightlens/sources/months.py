"""Tables kept by month: one folder per year and month of a date column.

A month is the unit in which flight files arrive and are sent again. A table
laid out by month lets a date window read only its months (the predicate on
the folder columns prunes before any file is opened), and lets a month that is
sent again replace its own folder and nothing else.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

YEAR, MONTH = "part_year", "part_month"


def _keyed(df: DataFrame, date_col: str) -> DataFrame:
    return df.withColumn(YEAR, F.year(date_col)).withColumn(MONTH, F.month(date_col))


def write_months(df: DataFrame, path: str, date_col: str = "flight_date", together: bool = False) -> None:
    """Write (or overwrite) the whole table, a folder per month.

    ``together``: the rows come month by month already, as files that hold a
    month each do, so every task writes few folders and nothing is shuffled.
    Otherwise rows are rebalanced by month first: a month beyond the advisory
    partition size is split over several tasks, small months share one, and no
    task writes a file into every folder.
    """
    keyed = _keyed(df, date_col)
    if not together:
        keyed = keyed.hint("rebalance", YEAR, MONTH)
    # the writer sorts by folder anyway; in order of the date a window skips row groups of its first and last month
    keyed.sortWithinPartitions(YEAR, MONTH, date_col).write.mode("overwrite").partitionBy(YEAR, MONTH).parquet(path)


def replace_months(rows: DataFrame, path: str, date_col: str = "flight_date") -> None:
    """Rows of some months take the place of those months; other folders stay as they are.

    ``rows`` must not read the table at ``path``.
    """
    (_keyed(rows, date_col).hint("rebalance", YEAR, MONTH).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(YEAR, MONTH).parquet(path))


def remove_months(spark: SparkSession, path: str, months: list[tuple[int, int]]) -> None:
    """Drop the folders of months (that have no rows any more)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for year, month in months:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{YEAR}={year}/{MONTH}={month}")
        folder.getFileSystem(conf).delete(folder, True)


def months_of(df: DataFrame, date_col: str = "flight_date") -> list[tuple[int, int]]:
    """The months that occur, a number the calendar bounds (null dates have none)."""
    d = F.col(date_col)
    rows = df.filter(d.isNotNull()).groupBy(F.year(d).alias("y"), F.month(d).alias("m")).count().collect()
    return sorted((r["y"], r["m"]) for r in rows)


def in_months(months: list[tuple[int, int]]) -> Column:
    """Rows of some months, as a predicate on the folder columns."""
    return (F.col(YEAR) * 12 + F.col(MONTH)).isin([y * 12 + m for y, m in months])


def open_months(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table with its folder columns. Its folders are listed now: windows of it need no further listing.

    ``schema`` has the columns without those of the folders.
    """
    keys = [T.StructField(YEAR, T.IntegerType()), T.StructField(MONTH, T.IntegerType())]
    return spark.read.schema(T.StructType([*schema.fields, *keys])).parquet(path)


def window(table: DataFrame, start: str | None = None, before: str | None = None,
           months: list[tuple[int, int]] | None = None, date_col: str = "flight_date") -> DataFrame:
    """Rows of an opened table with ``start <= date < before``, from the folders that can hold any of them.

    The scan's partition filter keeps whole months; the date predicate, pushed
    to the files, cuts the first and the last one.
    """
    at, df = F.col(YEAR) * 12 + F.col(MONTH), table
    if start is not None:
        d = _dt.date.fromisoformat(start)
        df = df.filter((at >= d.year * 12 + d.month) & (F.col(date_col) >= F.lit(d)))
    if before is not None:
        d = _dt.date.fromisoformat(before)
        last = d - _dt.timedelta(days=1)
        df = df.filter((at <= last.year * 12 + last.month) & (F.col(date_col) < F.lit(d)))
    if months is not None:
        df = df.filter(in_months(months))
    return df.drop(YEAR, MONTH)


def read_months(spark: SparkSession, path: str, schema: T.StructType, start: str | None = None, before: str | None = None,
                months: list[tuple[int, int]] | None = None, date_col: str = "flight_date") -> DataFrame:
    """``window`` of the table at ``path``."""
    return window(open_months(spark, path, schema), start, before, months, date_col)

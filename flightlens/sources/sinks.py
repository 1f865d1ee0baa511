"""Sinks: Parquet stage tables, catalog tables, CSV report export."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, root: str) -> list[str]:
    """Names of the version folders under ``root``, oldest first."""
    p, fs = _folder(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n for n in names if n.startswith("version="))


def publish_table(df: DataFrame, name: str, partition_by: list[str] | None = None, path: str | None = None,
                  keep: int = 2) -> DataFrame:
    """Replace what ``name`` stands for in the catalog (the warehouse load) and return it as read back.

    The rows are written as a new version in a folder of its own; only when it
    is whole, the catalog entry, a view of the version's folder, is switched to
    it. A reader sees the old rows or the new ones, never none; a write that
    fails leaves the entry and the old rows as they were. The schema may change
    from version to version. The last ``keep`` versions stay, so that queries
    that began before the switch can end; older ones are deleted.

    ``path``: keep the versions there instead of in the warehouse folder.
    """
    spark = df.sparkSession
    if spark.catalog.tableExists(name) and spark.catalog.getTable(name).tableType not in ("VIEW", "TEMPORARY"):
        raise ValueError(f"{name} is a table of its own files; publishing replaces views of published versions only")
    root = (path or f"{spark.conf.get('spark.sql.warehouse.dir')}/{name.replace('.', '/')}_versions").rstrip("/")
    last = max([int(v[8:16]) for v in _versions(spark, root)], default=0)
    version = f"{root}/version={last + 1:08}-{uuid.uuid4().hex[:12]}"
    write_parquet(df, version, partition_by)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM parquet.`{version}`")
    finished = [v for v in _versions(spark, root) if _complete(spark, f"{root}/{v}")]
    for old in finished[:-keep]:
        p, fs = _folder(spark, f"{root}/{old}")
        fs.delete(p, True)
    return spark.table(name)


def _complete(spark: SparkSession, version: str) -> bool:
    p, fs = _folder(spark, f"{version}/_SUCCESS")
    return fs.exists(p)


def export_report_csv(report: DataFrame, path: str) -> None:
    """One headed CSV file per report (the dashboard extract).

    A report has a row per carrier, month, weekday, airport or route, so its
    size follows those levels and not the number of flights.
    """
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_report_csv(like: DataFrame, path: str) -> DataFrame:
    """An exported report read back with the columns and types of ``like``."""
    return like.sparkSession.read.schema(like.schema).option("header", True).option("enforceSchema", False).csv(path)

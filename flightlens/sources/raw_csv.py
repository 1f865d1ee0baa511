"""Raw monthly on-time-performance CSV files -> one raw frame, columns by name.

The source files carry a header; their column order is not guaranteed to
be the same across months, and a trailing comma adds a nameless column.
Spark's CSV reader maps columns by position, so files are grouped by their
distinct header and each group is read with its own header; the groups are
then combined by name (``unionByName``, missing columns NULL). Everything is
read as text and typed by the clean stage (``try_cast``), never inferred.

The headers are read by a Spark job (``header_groups``): the file names are a
table, tasks open their files and read the first bytes up to a line's end, and
the files are grouped by that line. The driver opens no file and gets a row per
layout. Files that a task's Python cannot open by their address (a store that
only Spark's readers know) are read through by a text scan instead. Files
without a byte have no header and no rows.

For very many files with one shared layout, ``layout="single"`` reads them
in one scan and lets Spark check every file's header against the first one
(``enforceSchema=false``): a file with another layout fails the job instead
of being silently misaligned.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..session import ship_package

_LINE_END = re.compile(rb"\r\n|\n|\r")
HEAD_BYTES = 1 << 16         # bytes read at a time in search of a header's end
TASK_FILES = 64              # files whose headers one task reads


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Files behind a path or glob (file listing only, no data read)."""
    return sorted(spark.read.format("text").load(path).inputFiles())


def _first_line(address: str) -> str | None:
    """The first line of a file, empty if the file is; None if its address cannot be opened here."""
    try:
        store, path = fs.FileSystem.from_uri(address)
        with store.open_input_stream(path, compression="detect") as stream:
            head = b""
            while not (end := _LINE_END.search(head)) and (more := stream.read(HEAD_BYTES)):
                head += more
    except (OSError, pa.ArrowException):      # an address of another kind, or one that takes Spark's own settings
        return None
    return (head[:end.start()] if end else head).decode("utf-8", "replace")


def _open_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        files = batch.column("file")
        yield pa.RecordBatch.from_arrays([files, pa.array([_first_line(f) for f in files.to_pylist()], pa.string())],
                                         ["file", "line"])


def _read_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first line of each file of a partition, from all its lines."""
    last = None
    for batch in batches:
        take = []
        for i, file in enumerate(batch.column("file").to_pylist()):
            if file != last:
                take.append(i)
                last = file
        if take:
            yield batch.take(pa.array(take))


def _grouped(lines: DataFrame) -> list:
    return lines.groupBy("line").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()


def _names(line: str) -> tuple[str, ...]:
    """Column names of a header line, as Spark's CSV reader names them: empty ones (a trailing comma) are ``_c<i>``."""
    names = next(csv.reader([line.lstrip("\ufeff")]), [])
    return tuple(n.strip() or f"_c{i}" for i, n in enumerate(names))


def header_groups(spark: SparkSession, files: list[str]) -> list[tuple[tuple[str, ...], list[str]]]:
    """(column names, files with this header) per layout, ordered by the first file."""
    ship_package(spark)
    tasks = max(1, min(len(files), max(spark.sparkContext.defaultParallelism, len(files) // TASK_FILES)))
    names = spark.createDataFrame([(f,) for f in files], "file string").repartition(tasks)
    rows = _grouped(names.mapInArrow(_open_files, "file string, line string"))
    closed = [f for r in rows if r["line"] is None for f in r["files"]]
    if closed:
        text = spark.read.text(closed).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"),
                                              F.col("_metadata.file_block_start").alias("at"))
        rows = [r for r in rows if r["line"] is not None] + _grouped(
            text.filter("at = 0").drop("at").mapInArrow(_read_through, "file string, line string"))
    out: dict[tuple[str, ...], list[str]] = {}
    for row in rows:
        if row["line"]:
            out.setdefault(_names(row["line"]), []).extend(row["files"])
    return sorted(((h, sorted(fs)) for h, fs in out.items()), key=lambda x: x[1][0])


def file_header(spark: SparkSession, file: str) -> tuple[str, ...]:
    """Column names of one file's header (none if the file is empty)."""
    return next((h for h, _ in header_groups(spark, [file])), ())


def _text_schema(cols) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in cols])


def _read_group(spark: SparkSession, files: list[str], header: tuple[str, ...]) -> DataFrame:
    df = (spark.read.schema(_text_schema(header)).option("header", True)
          .option("enforceSchema", False).option("mode", "PERMISSIVE").csv(files))
    keep = [c for c in header if c in C.RAW_COLUMN_MAP]
    return df.select(*[F.col(f"`{c}`") for c in keep])


def read_raw_csv(spark: SparkSession, path: str, layout: str = "by_header") -> DataFrame:
    """All raw files under ``path`` with the mapped source columns only.

    layout: "by_header" (files are grouped by their header, however many there
    are) or "single" (the caller knows they are alike: one scan, and Spark
    rejects a file with another header).
    """
    files = list_files(spark, path)
    if not files:
        raise FileNotFoundError(path)
    if layout == "single":
        return _read_group(spark, files, file_header(spark, files[0]))
    groups = header_groups(spark, files)
    if not groups:
        raise FileNotFoundError(f"{path}: only empty files")
    frames = [_read_group(spark, fs, h) for h, fs in groups]
    out = frames[0]
    for fr in frames[1:]:
        out = out.unionByName(fr, allowMissingColumns=True)
    return out


# --- writing raw-layout files (round trips and tests) ----------------------------

LEGACY_DATE_FORMAT = "M/d/yyyy h:mm:ss a"


def write_raw_csv(df: DataFrame, path: str, column_order: list[str] | None = None,
                  legacy_dates: bool = False, extra_column: str | None = None) -> None:
    """Write a raw frame as headed CSV text (one file per task).

    column_order permutes the columns; legacy_dates writes FL_DATE as
    'M/d/yyyy h:mm:ss a'; extra_column adds an unmapped empty column, as the
    source files' trailing comma does.
    """
    cols = column_order or df.columns
    out = []
    for c in cols:
        col = F.col(c)
        if c == "FL_DATE":
            col = (F.date_format(col, LEGACY_DATE_FORMAT) if legacy_dates
                   else F.date_format(col, "yyyy-MM-dd"))
        out.append(col.cast("string").alias(c))
    if extra_column:
        out.append(F.lit(None).cast("string").alias(extra_column))
    df.select(*out).write.mode("overwrite").option("header", True).csv(path)

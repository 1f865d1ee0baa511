"""Helpers every operator of this subpackage uses: staged tables and Arrow columns."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlens.session import ensure_checkpoint_dir, ship_package

CHUNK_BYTES = 1 << 20        # text handled at a time inside a task


def prepare(spark: SparkSession) -> None:
    """Register the shared folder and ship the package to the executors."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/llm/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    The read-back table has true sizes, so the optimiser's choice of a join
    strategy rests on measured bytes.
    """
    spark = df.sparkSession
    path = scratch_folder(spark)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete staged tables that later staged tables have replaced."""
    jvm = spark.sparkContext._jvm
    for df in tables:
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete staged tables that later ones have replaced, and let go of finished shuffles.

    Spark removes shuffle files when the driver's garbage collector finds them
    unused, which may be long after; asking for it keeps the disk use of a
    chain of stages near that of its largest stage.
    """
    forget(spark, *tables)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str = "text"):
    """The column's UTF-8 bytes; null stays null."""
    return F.col(column).cast("string").cast("binary")


def rows_by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into slices of about ``most`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, have = 0, 0
        for i, n in enumerate(sizes):
            if i > start and have + n > most:
                yield batch.slice(start, i - start)
                start, have = i, 0
            have += int(n)
        yield batch.slice(start)

"""Spark session helpers and the shared work folder for stage tables."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings that matter at any scale: AQE re-plans shuffles (coalesce small
# partitions, split skewed ones), ANSI keeps arithmetic errors loud, UTC
# keeps date derivations independent of the host.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    # checkpointed intermediates (cells, sample candidates, ranked scores) are
    # removed from the shared folder once nothing references them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, app: str = "flightlens",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with the project defaults.

    ``master`` is only meant for local runs and tests; on a cluster leave it
    unset so the submitter decides.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        builder = builder.config("spark.ui.enabled", "false")
        builder = builder.config("spark.driver.memory", os.environ.get("FLIGHTLENS_DRIVER_MEM", "16g"))
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder for checkpoints and stage tables.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (a shared
    file system); only when it is unset -- local runs and tests -- a fresh
    local folder is created and registered.
    """
    sc = spark.sparkContext
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        try:
            conf_dir = spark.conf.get("spark.checkpoint.dir", None)
        except Exception:  # not readable as a runtime conf
            conf_dir = None
    if conf_dir:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(conf_dir)
        return conf_dir.rstrip("/")
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            # a driver-local folder is invisible to executors on a cluster
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS or object storage)")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="flightlens-ckpt-"))
    # setCheckpointDir adds a per-context sub folder; use it as is.
    return sc.getCheckpointDir().rstrip("/")


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on every executor (once per application).

    Python functions that run on executors import ``flightlens``. The sources
    are zipped into the shared folder and announced with ``addPyFile``, so a
    cluster needs neither an installed package nor ``--py-files``.
    """
    sc = spark.sparkContext
    if getattr(sc, "_flightlens_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    files = sorted(os.path.join(d, f) for d, _, names in os.walk(top) for f in names if f.endswith(".py"))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for f in files:
            with open(f, "rb") as source:
                z.writestr(zipfile.ZipInfo(os.path.relpath(f, os.path.dirname(top))), source.read())
    data = buffer.getvalue()
    name = f"flightlens-{hashlib.sha256(data).hexdigest()[:16]}.zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark)}/code/{name}")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path, True)
        out.write(bytearray(data))
        out.close()
    sc.addPyFile(fs.makeQualified(path).toString())
    sc._flightlens_shipped = True


def work_root(spark: SparkSession) -> str:
    """Folder under the checkpoint dir that holds materialised stage tables."""
    return ensure_checkpoint_dir(spark) + "/flightlens-stages"


def written(df):
    """``df`` written to the shared folder and read back: survives lost executors, and has a measured size.

    The optimiser knows the bytes of the files, so a join with the table is
    broadcast if they are few and sorted and merged if they are not.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/flightlens-tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reliable_checkpoint(df):
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    Unlike a local checkpoint this survives the loss of the executors that
    computed it; use it for small intermediate tables that later steps read
    several times (sufficient-statistic cells, sample candidates).
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

"""The batch chain as written stage tables.

raw -> flights (clean) -> model_table -> train / test -> train_sample

Each stage ends in a Parquet table under the shared checkpoint folder
(``spark.checkpoint.dir``), exactly where the chain has a file boundary
between steps. Writing cuts lineage (a lost executor re-runs one stage, not
the chain), later steps get column pruning, and every query downstream reads
the stage instead of recomputing the joins of the raw input. The clean stage's
checks are counted while it is written, the others in one aggregation over the
written table.

The clean and the model table are laid out by month (``sources.months``).
Train and test, the fit and validation slices and the recalibration slices are
windows of the model table that read their months only; they are not written
again. A month that is sent again replaces its folder in both tables
(``Study.reload_months``).

Tables are keyed by the input, the parameters and a digest of the code that
builds them, so a changed rule never reads a stale table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import clean as clean_op
from ..operators import prepare as prep_op
from ..operators import split as split_op
from ..params import FIXTURE, StudyParams
from ..session import work_root
from ..sources import fixture, months
from ..sources.raw_csv import read_raw_csv, write_raw_csv

_PKG = Path(__file__).resolve().parent.parent
_CODE_FILES = ["constants.py", "params.py", "functions/columns.py", "sources/fixture.py",
               "sources/raw_csv.py", "sources/months.py", "operators/clean.py", "operators/prepare.py",
               "operators/split.py", "operators/checks.py", "operators/intervals.py", "plans/stages.py"]


def _code_digest() -> str:
    h = hashlib.sha1()
    for rel in _CODE_FILES:
        p = _PKG / rel
        if p.exists():
            h.update(p.read_bytes())
    return h.hexdigest()[:12]


def _exists(spark: SparkSession, path: str) -> bool:
    """Does a (possibly remote) path exist? Hadoop FileSystem, else a read attempt."""
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))
    except AttributeError:
        try:
            spark.read.parquet(path)
            return True
        except AnalysisException:
            return False


def input_state(spark: SparkSession, *patterns: str) -> str:
    """Digest of the names, sizes and modification times of the files behind paths or globs."""
    jvm, conf, seen = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for pattern in patterns:
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        fs = path.getFileSystem(conf)
        for top in fs.globStatus(path) or []:
            files = fs.listFiles(top.getPath(), True)
            while files.hasNext():
                f = files.next()
                seen.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(seen)).encode()).hexdigest()[:16]


def fixture_state(spark: SparkSession, sf_dir: str) -> str:
    return input_state(spark, *(f"{sf_dir.rstrip('/')}/{t}.parquet" for t in fixture.FLIGHT_TABLES))


class Study:
    """Stage tables of one input under one parameter set."""

    def __init__(self, spark: SparkSession, params: StudyParams = FIXTURE,
                 sf_dir: str | None = None, raw: Callable[[], DataFrame] | None = None,
                 source_key: str | None = None, by_month: bool = False, holidays: DataFrame | None = None):
        """``by_month``: the raw rows come month by month, as monthly files do, so laying them out needs no shuffle.

        ``holidays``: a table of holidays (``day``) to take instead of the parameters' list.
        """
        self.spark = spark
        self.params = params
        self.by_month = by_month
        self.holidays = holidays
        if raw is None:
            assert sf_dir is not None, "either sf_dir (shipped tables) or a raw frame builder"
            raw = lambda: fixture.raw_flights(spark, sf_dir)
            source_key = source_key or f"fixture:{sf_dir.rstrip('/')}:{fixture_state(spark, sf_dir)}"
        self._raw = raw
        key = f"{source_key}|{params.key()}|{_code_digest()}"
        if holidays is not None:
            days = holidays.select(F.col("day").cast("date").alias("day")).filter("day IS NOT NULL").distinct()
            key += f"|holidays:{tuple(days.agg(F.count('day'), F.bit_xor(F.xxhash64('day'))).first())}"
        self.key = hashlib.sha1(key.encode()).hexdigest()[:16]
        self.root = f"{work_root(spark)}/{self.key}"
        self._cache: dict[str, DataFrame] = {}
        self._schemas: dict[str, T.StructType] = {}
        self._tables: dict[str, DataFrame] = {}       # tables by month, with their folder columns

    # -- helpers -------------------------------------------------------------
    def _marker(self, name: str) -> str:
        return f"{self.root}/_checked_{name}"

    def _mark(self, name: str) -> None:
        self.spark.range(1).write.mode("overwrite").parquet(self._marker(name))

    def _unmark(self, *names: str) -> None:
        """These stages are to be built (or checked) again."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self._marker(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self._cache.pop(name, None)

    def _stage(self, name: str, build: Callable[[], DataFrame],
               check: Callable[[DataFrame], None] | None = None, by_month: bool | None = None) -> DataFrame:
        """The stage's table, built and checked if it is not there. ``by_month``: laid out by month
        (true: its rows come month by month)."""
        if name in self._cache:
            return self._cache[name]
        path = f"{self.root}/{name}"

        def read():
            if by_month is None:
                return self.spark.read.parquet(path)
            if name not in self._schemas:         # the column order of the plan that builds it; nothing is run
                self._schemas[name] = build().schema
            self._tables[name] = months.open_months(self.spark, path, self._schemas[name])
            return months.window(self._tables[name])

        if _exists(self.spark, self._marker(name)):
            df = read()
        else:
            built = build()
            if by_month is None:
                built.write.mode("overwrite").parquet(path)
            else:
                self._schemas[name] = built.schema
                months.write_months(built, path, together=by_month)
            df = read()
            if check is not None:
                check(df)
            # written only once the checks passed; a failed stage is rebuilt
            self._mark(name)
        self._cache[name] = df
        return df

    # -- stages ----------------------------------------------------------------
    def raw(self) -> DataFrame:
        return self._raw()

    def flights(self) -> DataFrame:
        seen = Observation()      # the checks' counts are taken while the table is written
        return self._stage("flights", lambda: clean_op.clean_flights(self.raw(), seen),
                           lambda _: clean_op.check_clean(seen), by_month=self.by_month)

    def prep_report(self) -> DataFrame:
        return prep_op.prep_report(self.flights(), self.params, self.holidays)

    def model_table(self) -> DataFrame:
        def check(_df):
            prep_op.check_prep(self.prep_report().collect()[0], self.flights(), f"{self.root}/quarantine_model_table")
        return self._stage("model_table", lambda: prep_op.model_table(self.flights(), self.params, self.holidays), check,
                           by_month=True)        # the clean table's files hold a month each

    def split_proof(self) -> DataFrame:
        return split_op.split_proof(self.model_table(), self.params.split_date)

    def _split(self) -> None:
        """The split is proved once per model table; its sides are windows of that table."""
        if "split" in self._cache:
            return
        self.model_table()
        if not _exists(self.spark, self._marker("split")):
            proof = self.split_proof().collect()[0]
            split_op.check_split(proof, self.params.split_date)
            self.spark.createDataFrame([proof], self.split_proof().schema).write.mode("overwrite").parquet(self._marker("split"))
        self._cache["split"] = self.spark.read.parquet(self._marker("split"))

    def train_rows(self) -> int:
        """Rows of train, from the written proof of the split."""
        self._split()
        return self._cache["split"].first()["rows_before"]

    def _window(self, start: str | None, before: str | None) -> DataFrame:
        self.model_table()
        return months.window(self._tables["model_table"], start, before)

    def train(self, start: str | None = None, before: str | None = None) -> DataFrame:
        """Train rows (``start <= flight_date < before``): only the months of the window are read."""
        self._split()
        return self._window(start, min(filter(None, (before, self.params.split_date))))

    def test(self, start: str | None = None, before: str | None = None) -> DataFrame:
        """Test rows (``start <= flight_date < before``): only the months of the window are read."""
        self._split()
        return self._window(max(filter(None, (start, self.params.split_date))), before)

    def train_sample(self) -> DataFrame:
        return self._stage("train_sample", lambda: split_op.exact_sample(
            self.train(), self.params.sample_size, self.params.sample_seed, total=self.train_rows()))

    # -- months that are sent again ---------------------------------------------
    def reload_months(self, raw: DataFrame) -> list[tuple[int, int]]:
        """Replace every month that ``raw`` holds, in the clean and in the model table; returns these months.

        The new rows are cleaned and checked on the side first, so bad rows
        change nothing. Only the folders of their months are rewritten; the
        split is proved anew and the sample drawn anew when next asked for.
        A run that fails half-way can be repeated: its model table counts as
        missing until it is whole again.
        """
        self.model_table()
        incoming, seen = f"{self.root}/incoming", Observation()
        months.write_months(clean_op.clean_flights(raw, seen), incoming)
        clean_op.check_clean(seen)
        new = months.read_months(self.spark, incoming, self._schemas["flights"])
        found = months.months_of(new)
        prep_op.check_prep(prep_op.prep_report(new, self.params, self.holidays).collect()[0], new, f"{self.root}/quarantine_incoming")
        self._unmark("model_table", "split", "train_sample")
        months.replace_months(new, f"{self.root}/flights")
        self._cache.pop("flights", None)
        flights = months.read_months(self.spark, f"{self.root}/flights", self._schemas["flights"], months=found)
        model = prep_op.model_table(flights, self.params, self.holidays)
        months.replace_months(model, f"{self.root}/model_table")
        left = set(months.months_of(model))
        months.remove_months(self.spark, f"{self.root}/model_table", [m for m in found if m not in left])
        self._mark("model_table")
        return found


_STUDIES: dict[tuple, Study] = {}


def study_for(spark: SparkSession, sf_dir: str, params: StudyParams = FIXTURE) -> Study:
    """Shared Study per (session, input, parameters) so queries reuse stage tables."""
    k, state = (id(spark), sf_dir.rstrip("/"), params.key()), fixture_state(spark, sf_dir)
    st = _STUDIES.get(k)
    if st is None or st.spark is not spark or getattr(st, "state", state) != state:
        st = Study(spark, params, sf_dir=sf_dir)     # new, or the files are not those of last time
        st.state = state
        _STUDIES[k] = st
    return st


def flights_view(spark: SparkSession, sf_dir: str, params: StudyParams = FIXTURE,
                 name: str = "flights_2024") -> DataFrame:
    """Register the clean table as the warehouse view the dashboard SQL reads."""
    df = study_for(spark, sf_dir, params).flights()
    df.createOrReplaceTempView(name)
    return df




def csv_study(spark: SparkSession, sf_dir: str, params: StudyParams = FIXTURE) -> Study:
    """The same chain fed from raw CSV files instead of the typed fixture.

    The fixture rows are written once as raw monthly-style CSV in two
    layouts -- January-June in source order with ISO dates, July-December
    with the columns reversed, legacy 'M/d/yyyy h:mm:ss a' dates and an extra
    unmapped column -- and read back by column name.
    """
    from pyspark.sql import functions as F
    base = study_for(spark, sf_dir, params)
    root = f"{base.root}/raw_csv"
    marker = f"{root}/_written"
    if not _exists(spark, marker):
        raw = fixture.raw_flights(spark, sf_dir)
        first_half = F.month("FL_DATE") <= 6
        write_raw_csv(raw.filter(first_half), f"{root}/layout_a")
        write_raw_csv(raw.filter(~first_half), f"{root}/layout_b", column_order=list(reversed(raw.columns)),
                      legacy_dates=True, extra_column="_c23")
        spark.range(1).write.mode("overwrite").parquet(marker)
    key = ("csv", id(spark), root)
    st = _STUDIES.get(key)
    if st is None or st.spark is not spark:
        st = Study(spark, params, raw=lambda: read_raw_csv(spark, f"{root}/layout_*"),
                   source_key=f"csv:{root}")
        _STUDIES[key] = st
    return st

"""Stage tables by month: pruned windows, months that are sent again, failures on the way."""

import contextlib
import io
import re
import uuid

import pytest
from pyspark.sql import functions as F

from fixture_paths import SF0001
from flightlens.operators.checks import DataQualityError
from flightlens.params import FIXTURE
from flightlens.plans.risk import Risk, reference_first
from flightlens.plans.stages import Study, study_for
from flightlens.sources import fixture, months


def _plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode="formatted")
    return out.getvalue()


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_slices_read_their_months_only(spark):
    r = Risk(study_for(spark, SF0001))
    full = r.study.model_table()
    d = F.col("flight_date")
    for name, rows, lo, hi, folders in (
            ("train", r.study.train(), "1900-01-01", "2000-09-30", 69), ("test", r.study.test(), "2000-10-01", "2100-01-01", 14),
            ("fit", r.fit_rows, "1900-01-01", "2000-08-31", 68), ("validation", r.val_rows, "2000-09-01", "2000-09-30", 1),
            ("recalibration", r.recal_rows, "2000-10-01", "2000-10-14", 1),
            ("remainder", r.remaining_rows, "2000-10-15", "2100-01-01", 14)):
        plan = _plan(rows)
        filters = re.findall(r"PartitionFilters: \[(.*)\]", plan)
        assert filters and all("part_year" in f and "part_month" in f for f in filters), name
        assert rows.count() == full.filter(d.between(lo, hi)).count(), name
        read = {f.split("part_year=")[1].rsplit("/", 1)[0] for f in rows.select("flight_date").inputFiles()}
        scanned = rows.select(F.year(d) * 12 + F.month(d)).distinct().count()
        assert scanned <= folders and read, name


def test_windows_cut_inside_a_month(spark, tmp_dir):
    df = spark.sql("SELECT explode(sequence(DATE'2023-12-20', DATE'2024-03-05')) AS flight_date").withColumn("v", F.lit(1))
    months.write_months(df.unionByName(spark.createDataFrame([(None, 7)], "flight_date date, v int")), tmp_dir)
    got = months.read_months(spark, tmp_dir, df.schema, "2023-12-31", "2024-02-02")
    assert got.count() == 33 and got.agg(F.min("flight_date"), F.max("flight_date")).collect()[0] == tuple(
        spark.sql("SELECT DATE'2023-12-31', DATE'2024-02-01'").collect()[0])
    assert months.read_months(spark, tmp_dir, df.schema, before="2024-01-01").count() == 12
    assert months.read_months(spark, tmp_dir, df.schema).count() == 78
    assert months.months_of(months.read_months(spark, tmp_dir, df.schema)) == [(2023, 12), (2024, 1), (2024, 2), (2024, 3)]


def test_large_month_is_split_and_small_months_share_tasks(spark, tmp_dir):
    df = spark.range(200_000).select(F.expr("CASE WHEN id % 3 = 0 THEN DATE'2024-05-05' ELSE "
                                            "date_add(DATE'2020-01-01', int(id % 1500)) END AS flight_date"), F.uuid().alias("v"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        months.write_months(df.repartition(8), tmp_dir)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = spark.read.parquet(tmp_dir).inputFiles()
    per_month = {}
    for f in files:
        per_month[f.rsplit("/", 1)[0]] = per_month.get(f.rsplit("/", 1)[0], 0) + 1
    hot = next(n for k, n in per_month.items() if k.endswith("part_year=2024/part_month=5"))
    assert hot >= 4 and sum(per_month.values()) < 8 * len(per_month) * 3 / 4


def _study(spark, raw):
    return Study(spark, FIXTURE, raw=lambda: raw, source_key=uuid.uuid4().hex)


def test_month_sent_again_replaces_only_its_folder(spark):
    raw = fixture.raw_flights(spark, SF0001)
    st = _study(spark, raw)
    before = {n: {f.rsplit("/", 1)[0]: f for f in getattr(st, n)().inputFiles()} for n in ("flights", "model_table")}
    st.train_sample()
    new = raw.filter("FL_DATE BETWEEN DATE'1998-03-01' AND DATE'1998-04-30'").withColumn("DISTANCE", F.lit(7.0))
    new = new.filter("month(FL_DATE) = 3 OR CANCELLED = 1 OR DIVERTED = 1")     # April: no row for the model table
    assert st.reload_months(new) == [(1998, 3), (1998, 4)]
    for n in before:
        after = {f.rsplit("/", 1)[0]: f for f in getattr(st, n)().inputFiles()}
        changed = {k.split("part_year=")[1] for k in set(before[n]) | set(after) if before[n].get(k) != after.get(k)}
        assert changed == {"1998/part_month=3", "1998/part_month=4"}, n
    rest = raw.filter("FL_DATE NOT BETWEEN DATE'1998-03-01' AND DATE'1998-04-30'")
    whole = _study(spark, rest.unionByName(new))
    for n in ("flights", "model_table", "train", "test", "train_sample"):
        assert _rows(getattr(st, n)()) == _rows(getattr(whole, n)()), n


def test_month_with_bad_rows_changes_nothing(spark):
    raw = fixture.raw_flights(spark, SF0001).filter("FL_DATE < DATE'1996-01-01'")
    st = _study(spark, raw)
    flights, model = _rows(st.flights()), _rows(st.model_table())
    bad = raw.filter("month(FL_DATE) = 5").withColumn("CANCELLED", F.when(F.col("OP_CARRIER_FL_NUM") % 2 == 0, F.col("CANCELLED")))
    with pytest.raises(DataQualityError, match="cancelled_missing"):
        st.reload_months(bad)
    assert _rows(st.flights()) == flights and _rows(st.model_table()) == model


def test_reload_that_stops_half_way_is_made_whole(spark, monkeypatch):
    raw = fixture.raw_flights(spark, SF0001).filter("FL_DATE < DATE'1996-01-01'")
    st = _study(spark, raw)
    st.model_table()
    new = raw.filter("month(FL_DATE) = 5").withColumn("DISTANCE", F.lit(9.0))
    real, calls = months.replace_months, []

    def stop(rows, path, **kw):
        calls.append(path)
        if len(calls) == 2:
            raise RuntimeError("executors lost")
        real(rows, path, **kw)

    monkeypatch.setattr(months, "replace_months", stop)
    with pytest.raises(RuntimeError):
        st.reload_months(new)
    monkeypatch.undo()
    assert st.model_table().filter("distance = 9").count() == st.flights().filter("distance = 9 AND NOT cancelled AND NOT diverted").count() > 0


def test_reference_level_must_occur():
    assert reference_first(["a", "b", "c"], "b", "x") == ("b", "a", "c")
    with pytest.raises(DataQualityError, match="reference level 'z'"):
        reference_first(["a"], "z", "x")

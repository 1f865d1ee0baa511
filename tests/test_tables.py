"""Interval tables, level tables, quarantined rows and published versions."""

import datetime as dt
import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fixture_paths import SF0001
from flightlens.functions import columns as X
from flightlens.operators import checks, intervals, levels
from flightlens.params import FIXTURE
from flightlens.plans.stages import study_for
from flightlens.sources import fixture
from flightlens.sources.sinks import publish_table

DAY0 = dt.date(2023, 12, 20)


def _day(n):
    return None if n is None else DAY0 + dt.timedelta(days=n)


# --- intervals ---------------------------------------------------------------------

@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 150)), st.one_of(st.none(), st.integers(-3, 160))), max_size=25))
def test_dates_in_overlapping_null_and_reversed_intervals(spark, pairs):
    table = spark.createDataFrame([(_day(a), _day(b)) for a, b in pairs + pairs[:3]], "first_day date, last_day date")
    points = spark.createDataFrame([(i, _day(i % 170)) for i in range(340)] + [(999, None)], "id int, d date")
    got = {r.id: r.f for r in intervals.flag_in_intervals(points, "d", table, "f").collect()}
    assert got == {i: any(a is not None and b is not None and a <= i % 170 <= b for a, b in pairs) for i in range(340)} | {999: False}
    assert intervals.in_intervals(points, "d", table).count() == sum(got.values())


def test_interval_table_is_small_however_many_intervals(spark):
    many = spark.range(200_000).select(F.expr("date_add(DATE'2020-01-01', int(id % 900))").alias("first_day"),
                                       F.expr("date_add(DATE'2020-01-01', int(id % 900) + int(id % 3) * 4000)").alias("last_day"))
    pieces = intervals.disjoint_by_month(many)
    assert pieces.count() == pieces.select("bucket").distinct().count() < 600
    assert intervals.disjoint_by_month(many.limit(0)).count() == 0


def test_holiday_table_gives_the_literal_windows(spark):
    """The model table's holiday flag, from a table of holidays instead of literals, over overlapping windows."""
    mt = study_for(spark, SF0001).model_table()
    table = spark.createDataFrame([(d,) for d in FIXTURE.holidays] * 2 + [(None,)], "day string")
    for days in (FIXTURE.holiday_window_days, 40):
        flagged = intervals.flag_in_intervals(mt, "flight_date", intervals.holiday_windows(table, days), "in_window")
        assert flagged.count() == mt.count()
        assert flagged.filter(F.col("in_window") != X.holiday_flag("flight_date", FIXTURE.holidays, days)).count() == 0
        assert flagged.filter("in_window").count() > 0
    plan = flagged._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" not in plan and "2000-07-04" not in plan


# --- levels ------------------------------------------------------------------------

def test_a_hundred_thousand_levels(spark):
    df = spark.range(300_000).select(F.expr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 1000 = 1 THEN NULL ELSE "
                                            "concat('L', id * 7919 % 100003) END").alias("level_of"), "id")
    table = levels.top_level_table(df, "level_of", 50_000)
    counted = [(r["level_of"], r["count"]) for r in df.groupBy("level_of").count().collect() if r["level_of"] is not None]
    expected = sorted(counted, key=lambda r: (-r[1], r[0]))[:50_000]
    assert len(counted) > 99_000
    assert [(r["level"], r["n"], r["rank"]) for r in table.orderBy("rank").collect()] == \
        [(lv, n, i) for i, (lv, n) in enumerate(expected, 1)]
    folded = levels.fold_levels(df, "level_of", table, "folded")
    text = folded._jdf.queryExecution().toString()
    assert len(text) < 20_000 and "L12" not in text                    # no literal list
    got = {r["folded"]: r["count"] for r in folded.groupBy("folded").count().collect()}
    assert got == dict(expected) | {"OTHER": 300_000 - sum(n for _, n in expected)}
    share = levels.other_share(df, table).first()
    assert (share["rows"], share["rows_other"]) == (300_000, got["OTHER"])


def test_level_table_agrees_with_the_literal_list(spark):
    mt = study_for(spark, SF0001).model_table()
    from flightlens.operators import profile
    top = profile.top_levels(mt, "origin", 7)
    table = levels.top_level_table(mt, "origin", 7)
    assert [r["level"] for r in table.orderBy("rank").collect()] == top
    both = levels.fold_levels(mt, "origin", table, "folded").select("folded", X.top_or_other("origin", top).alias("literal"))
    assert both.filter("folded <> literal").count() == 0
    assert levels.top_level_table(mt.limit(0), "origin", 3).count() == 0
    assert levels.other_share(mt.limit(0), table).first()["other_pct"] is None


# --- quarantine --------------------------------------------------------------------

def _rules():
    return {"negative": F.col("x") < 0, "odd": F.col("x") % 2 == 1, "unknown": F.col("x").isNull(), "never": F.lit(False)}


def test_quarantine_keeps_rows_and_names_rules(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a"), (-3, "b"), (4, "c"), (None, "d"), (-2, "e"), (4, "c")], "x int, name string")
    q = checks.quarantine(df, _rules(), os.path.join(tmp_dir, "q"))
    assert sorted(map(tuple, q.good.collect())) == [(4, "c"), (4, "c")]
    assert {r.name: r.broken_rules for r in q.bad.collect()} == {"a": ["odd"], "b": ["negative"], "d": ["unknown"], "e": ["negative"]}
    assert q.counts == {"negative": 2, "odd": 1, "unknown": 1, "never": 0} and q.rows_bad == 4
    assert sorted(map(tuple, checks.rule_counts(q).collect())) == [("negative", 2, 2), ("odd", 1, 1), ("unknown", 1, 1)]
    with pytest.raises(checks.DataQualityError, match=r"'negative': 2.*4 rows in .*'broken_rules': \['"):
        q.raise_if_any("loading")


def test_quarantine_of_clean_and_empty_tables(spark, tmp_dir):
    df = spark.createDataFrame([(4, "c")], "x int, name string")
    for i, part in enumerate((df, df.limit(0))):
        q = checks.quarantine(part, _rules(), os.path.join(tmp_dir, f"q{i}"))
        q.raise_if_any("loading")
        assert (q.rows_bad, q.good.count(), q.bad.count()) == (0, part.count(), 0)
    assert checks.quarantine(df, {}, os.path.join(tmp_dir, "none")).good.count() == 1


def test_failed_model_table_names_rows(spark):
    import uuid
    from flightlens.plans.stages import Study
    from flightlens.sources import fixture
    raw = fixture.raw_flights(spark, SF0001).withColumn(
        "CRS_DEP_TIME", F.when(F.col("OP_CARRIER_FL_NUM") == 7, F.lit(2500)).otherwise(F.col("CRS_DEP_TIME")))
    st_ = Study(spark, FIXTURE, raw=lambda: raw, source_key=uuid.uuid4().hex)
    with pytest.raises(checks.DataQualityError, match=r"bad_dep_hour.*rows in .*2500"):
        st_.model_table()


# --- published versions --------------------------------------------------------------

def test_readers_never_see_a_gap(spark, tmp_dir):
    name, root = "flights_published", os.path.join(tmp_dir, "pub")
    one = spark.createDataFrame([("AA", 3)], "airline string, total_flights long")
    assert [tuple(r) for r in publish_table(one, name, path=root).collect()] == [("AA", 3)]
    before = spark.table(name)
    broken = spark.range(100).select(F.lit("ZZ").alias("airline"), F.when(F.col("id") == 99, F.raise_error(F.lit("lost")).cast("long"))
                                     .otherwise(F.col("id")).alias("total_flights"))
    with pytest.raises(Exception, match="lost"):
        publish_table(broken, name, path=root)
    assert [tuple(r) for r in spark.table(name).collect()] == [("AA", 3)]
    wider = spark.createDataFrame([("BB", 4, 2024), ("CC", 5, 2025)], "airline string, total_flights long, year int")
    assert sorted(map(tuple, publish_table(wider, name, partition_by=["year"], path=root).collect())) == [("BB", 4, 2024), ("CC", 5, 2025)]
    assert [tuple(r) for r in before.collect()] == [("AA", 3)]                       # a query from before the switch
    for i in range(3):
        publish_table(spark.createDataFrame([("AA", i)], one.schema), name, path=root)
    assert [tuple(r) for r in spark.table(name).collect()] == [("AA", 2)]
    assert sum(os.path.exists(os.path.join(root, v, "_SUCCESS")) for v in os.listdir(root)) == 2
    spark.sql(f"DROP VIEW {name}")


def test_a_table_of_its_own_is_not_replaced(spark):
    spark.range(3).write.mode("overwrite").saveAsTable("own_table")
    with pytest.raises(ValueError, match="own_table"):
        publish_table(spark.range(1), "own_table")
    assert spark.table("own_table").count() == 3
    spark.sql("DROP TABLE own_table")


def test_study_with_a_table_of_holidays(spark):
    import uuid
    from flightlens.plans.stages import Study
    raw = fixture.raw_flights(spark, SF0001).filter("FL_DATE < DATE'1997-01-01'")
    key = uuid.uuid4().hex
    table = spark.createDataFrame([(d,) for d in FIXTURE.holidays], "day string")
    literal, from_table = (Study(spark, FIXTURE, raw=lambda: raw, source_key=key, holidays=h) for h in (None, table))
    other = Study(spark, FIXTURE, raw=lambda: raw, source_key=key, holidays=table.limit(2))
    assert len({literal.key, from_table.key, other.key}) == 3
    assert sorted(map(repr, from_table.model_table().collect())) == sorted(map(repr, literal.model_table().collect()))
    assert from_table.prep_report().collect() == literal.prep_report().collect()
    assert 0 < other.model_table().filter("holiday_flag").count() < literal.model_table().filter("holiday_flag").count()

"""Dashboard reports: SQL text = DataFrame version = one-pass grouping sets; edge rows."""

import datetime as dt

from pyspark.sql import functions as F

from fixture_paths import SF0001
from flightlens.operators import reports as R
from flightlens.params import FIXTURE
from flightlens.plans.dashboard import report_sql
from flightlens.plans.stages import flights_view, study_for


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_sql_text_matches_dataframe_reports(spark):
    fl = flights_view(spark, SF0001)
    sql = report_sql(airport_min_flights=FIXTURE.airport_min_flights // 10,
                     route_min_flights=FIXTURE.route_min_flights // 10)
    pairs = {
        "delay_by_airline": R.delay_by_airline(fl),
        "delay_by_month": R.delay_by_month(fl),
        "delay_by_dow": R.delay_by_dow(fl),
        "delay_by_airport": R.delay_by_airport(fl, FIXTURE.airport_min_flights // 10, FIXTURE.airport_top_k),
        "worst_routes": R.worst_routes(fl, FIXTURE.route_min_flights // 10),
        "delay_heatmap_dow_month": R.delay_heatmap(fl),
    }
    for name, df in pairs.items():
        assert _rows(spark.sql(sql[name])) == _rows(df), name
        assert spark.sql(sql[name]).columns == df.columns


def test_one_pass_equals_separate_reports(spark):
    fl = study_for(spark, SF0001).flights()
    lo_air, lo_route = 100, 5
    one = R.dashboard_one_pass(fl, lo_air, 30, lo_route)
    for name, df in {"delay_by_airline": R.delay_by_airline(fl),
                     "worst_routes": R.worst_routes(fl, lo_route),
                     "delay_by_airport": R.delay_by_airport(fl, lo_air, 30)}.items():
        a = sorted((r["key"], r["total_flights"], r["delayed_flights"], r["delay_rate_pct"], r["avg_dep_delay_min"])
                   for r in one.filter(F.col("report") == name).collect())
        b = sorted(tuple(r) for r in df.collect())
        assert a == b, name
    heat = one.filter(F.col("report") == "delay_heatmap_dow_month")
    assert heat.count() == R.delay_heatmap(fl).count()


def test_cancelled_rows_count_but_are_not_delayed(spark):
    rows = [("AA", True, None, None), ("AA", False, 20.0, 10.0), ("AA", False, 15.0, -3.0), ("BB", False, 14.0, 1.0)]
    df = spark.createDataFrame(rows, "airline string, cancelled boolean, arr_delay_min double, dep_delay double")
    df = df.withColumn("is_delayed", F.coalesce(F.col("arr_delay_min") >= 15, F.lit(False)))
    got = {r["airline"]: r for r in R.delay_by_airline(df).collect()}
    assert got["AA"]["total_flights"] == 3 and got["AA"]["delayed_flights"] == 2
    assert got["AA"]["delay_rate_pct"] == 66.67
    assert got["AA"]["avg_dep_delay_min"] == 3.5        # AVG skips the cancelled flight's NULL
    assert got["BB"]["delay_rate_pct"] == 0.0


def test_airport_topk_ties_are_stable(spark):
    rows = [(o, False, 1.0) for o in ["B", "A", "C", "A", "B", "C", "D"]]
    df = spark.createDataFrame(rows, "origin string, is_delayed boolean, dep_delay double")
    got = [r["origin"] for r in R.delay_by_airport(df, min_flights=0, top_k=2).collect()]
    assert got == ["A", "B"]    # tie on volume broken by the key


def test_dow_report_order(spark):
    days = [dt.date(2024, 1, d) for d in range(1, 8)]
    from flightlens.functions import columns as X
    df = spark.createDataFrame([(d,) for d in days], "d date").select(
        X.day_name("d").alias("day_of_week"), F.lit(False).alias("is_delayed"), F.lit(0.0).alias("dep_delay"))
    assert [r[0] for r in R.delay_by_dow(df).collect()] == ["Monday", "Tuesday", "Wednesday", "Thursday",
                                                            "Friday", "Saturday", "Sunday"]


def test_report_totals_are_consistent(spark):
    """Every flight is counted once in each single-key report, cancelled ones included."""
    fl = study_for(spark, SF0001).flights()
    n = fl.count()
    n_delayed = fl.filter("is_delayed").count()
    for df in (R.delay_by_airline(fl), R.delay_by_month(fl), R.delay_by_dow(fl), R.delay_heatmap(fl),
               R.delay_by_airline_export(fl), R.delay_heatmap_export(fl)):
        assert df.agg(F.sum("total_flights")).collect()[0][0] == n
    for df in (R.delay_by_month(fl), R.delay_by_dow(fl)):
        assert df.agg(F.sum("delayed_flights")).collect()[0][0] == n_delayed


def test_route_export_floor_is_inclusive(spark):
    rows = [("A-B", "A", "B", True, 1.0)] * 3 + [("A-C", "A", "C", False, 1.0)] * 2
    df = spark.createDataFrame(rows, "route string, origin string, dest string, is_delayed boolean, arr_delay double")
    got = {r["route"]: r for r in R.worst_routes_export(df, min_flights=2).collect()}
    assert set(got) == {"A-B", "A-C"}                  # exactly at the floor is kept
    assert list(got["A-B"].asDict()) == ["route", "origin", "dest", "total_flights", "delay_rate_pct",
                                         "avg_arr_delay_min"]

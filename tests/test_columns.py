"""Edge rows for the derived columns (bin edges, nulls, 2400, holidays, weekday)."""

import datetime as dt

from pyspark.sql import functions as F

from flightlens import constants as C
from flightlens.functions import columns as X


def test_is_delayed_and_bucket_edges(spark):
    vals = [None, 0.0, 1.0, 14.0, 15.0, 16.0, 60.0, 61.0, 180.0, 181.0, -5.0]
    df = spark.createDataFrame([(v,) for v in vals], "arr_delay_min double")
    got = {r["arr_delay_min"]: (r["d"], r["b"]) for r in df.select(
        "arr_delay_min", X.is_delayed("arr_delay_min").alias("d"), X.delay_bucket("arr_delay_min").alias("b")).collect()}
    assert got[None] == (False, None)          # cancelled: not delayed, no bucket
    assert got[0.0] == (False, "on_time_or_early")
    assert got[-5.0] == (False, "on_time_or_early")
    assert got[1.0] == (False, "minor")
    assert got[14.0] == (False, "minor")
    assert got[15.0] == (True, "minor")         # right-closed bin, yet delayed
    assert got[16.0] == (True, "moderate")
    assert got[60.0] == (True, "moderate")
    assert got[61.0] == (True, "severe")
    assert got[180.0] == (True, "severe")
    assert got[181.0] == (True, "extreme")


def test_dep_hour_and_bins(spark):
    times = [0, 59, 459, 500, 759, 800, 2359, 2400]
    df = spark.createDataFrame([(t,) for t in times], "t int")
    rows = df.select("t", X.dep_hour("t").alias("h")).select("t", "h", X.dep_hour_bin("h").alias("b")).collect()
    got = {r["t"]: (r["h"], r["b"]) for r in rows}
    assert got[0] == (0, "red_eye")
    assert got[59] == (0, "red_eye")
    assert got[459] == (4, "red_eye")
    assert got[500] == (5, "early_morning")
    assert got[759] == (7, "early_morning")
    assert got[800] == (8, "morning")
    assert got[2359] == (23, "night")
    assert got[2400] == (0, "red_eye")          # midnight convention


def test_holiday_window_edges(spark):
    h = dt.date(2024, 7, 4)
    days = [h, h + dt.timedelta(days=3), h - dt.timedelta(days=3), h + dt.timedelta(days=4), h - dt.timedelta(days=4)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    flags = [r[0] for r in df.select(X.holiday_flag("d", list(C.HOLIDAYS_2024.values()), 3)).collect()]
    assert flags == [True, True, True, False, False]


def test_route_weekend_dayname_and_ordinal(spark):
    df = spark.createDataFrame([("ATL", "DEN", dt.date(2024, 1, 6)), ("ATL", None, dt.date(2024, 1, 8))],
                               "o string, d string, dt date")
    r = df.select(X.route("o", "d").alias("r"), X.is_weekend("dt").alias("w"), X.day_name("dt").alias("n"),
                  X.level_ordinal(X.day_name("dt"), C.DOW_ORDER).alias("k"),
                  X.level_ordinal(F.lit("Funday"), C.DOW_ORDER).alias("u")).collect()
    assert r[0]["r"] == "ATL-DEN" and r[1]["r"] is None       # missing code -> missing route
    assert r[0]["w"] is True and r[1]["w"] is False           # Saturday / Monday
    assert r[0]["n"] == "Saturday" and r[1]["k"] == 1
    assert r[0]["u"] is None                                  # unknown level -> NULL, not 0


def test_half_away_rounding(spark):
    df = spark.createDataFrame([(1.005,), (0.285,), (-0.125,), (2.675,)], "x double")
    got = [r[0] for r in df.select(X.half_away_round("x", 2)).collect()]
    assert got == [1.01, 0.29, -0.13, 2.68]


def test_flag_cast_and_top_or_other(spark):
    df = spark.createDataFrame([(1.0, "A"), (0.0, "B"), (None, "C")], "f double, a string")
    r = df.select(X.flag_to_bool("f").alias("b"), X.top_or_other("a", ["A"]).alias("t")).collect()
    assert [x["b"] for x in r] == [True, False, None]
    assert [x["t"] for x in r] == ["A", "OTHER", "OTHER"]

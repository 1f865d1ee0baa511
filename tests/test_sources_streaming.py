"""Raw CSV by name (trailing comma, reordered headers, legacy dates), sinks, streaming ingest."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from flightlens import constants as C
from flightlens.operators.checks import DataQualityError
from flightlens.operators.clean import CLEAN_COLUMNS, clean_flights
from flightlens.sources.raw_csv import read_raw_csv
from flightlens.sources.sinks import export_report_csv, publish_table
from flightlens.streaming.monthly_ingest import start_monthly_ingest

HEADER = list(C.RAW_COLUMN_MAP)


def _line(values: dict, order) -> str:
    return ",".join(str(values.get(c, "")) for c in order)


def _rows(month: int):
    base = {c: "" for c in HEADER}
    out = []
    for i, (arr, canc, div) in enumerate([(20.0, 0.0, 0.0), ("", 1.0, 0.0), ("", 0.0, 1.0), (-4.0, 0.0, 0.0)]):
        r = dict(base)
        r.update({"FL_DATE": f"{month}/{i + 1}/2024 12:00:00 AM", "OP_UNIQUE_CARRIER": "WN", "OP_CARRIER_FL_NUM": 100 + i,
                  "ORIGIN": "ATL", "DEST": "DEN", "CRS_DEP_TIME": 2400 if i == 0 else 905, "ARR_DELAY": arr,
                  "ARR_DELAY_NEW": (max(arr, 0.0) if arr != "" else ""), "CANCELLED": canc, "DIVERTED": div,
                  "DEP_DELAY": 3.0, "DISTANCE": 1199.0, "CARRIER_DELAY": (20.0 if arr == 20.0 else "")})
        out.append(r)
    return out


def _write(path, rows, order, trailing_comma):
    with open(path, "w") as f:
        f.write(",".join(order) + ("," if trailing_comma else "") + "\n")
        for r in rows:
            f.write(_line(r, order) + ("," if trailing_comma else "") + "\n")


def test_read_by_name_across_layouts(spark, tmp_dir):
    _write(os.path.join(tmp_dir, "jan.csv"), _rows(1), HEADER, trailing_comma=True)
    _write(os.path.join(tmp_dir, "feb.csv"), _rows(2), list(reversed(HEADER)), trailing_comma=False)
    short = [c for c in HEADER if c != "SECURITY_DELAY"]          # a column absent in one month
    _write(os.path.join(tmp_dir, "mar.csv"), _rows(3), short, trailing_comma=True)
    raw = read_raw_csv(spark, tmp_dir + "/*.csv")
    fl = clean_flights(raw)
    assert fl.columns == CLEAN_COLUMNS
    rows = fl.orderBy("flight_date", "flight_number").collect()
    assert len(rows) == 12
    jan = rows[:4]
    assert str(jan[0]["flight_date"]) == "2024-01-01" and jan[0]["airline"] == "WN"
    assert jan[0]["scheduled_dep_time"] == 2400 and jan[0]["is_delayed"] is True
    assert jan[1]["cancelled"] is True and jan[1]["is_delayed"] is False and jan[1]["delay_bucket"] is None
    assert jan[0]["carrier_delay"] == 20.0 and jan[3]["carrier_delay"] == 0.0      # filled
    assert {r["security_delay"] for r in rows} == {0.0}
    assert [r["route"] for r in rows] == ["ATL-DEN"] * 12
    feb = rows[4:8]
    assert feb[0]["arr_delay"] == 20.0 and feb[0]["distance"] == 1199.0   # reversed file mapped by name


def test_publish_table_and_export(spark, tmp_dir):
    df = spark.createDataFrame([("AA", 3)], "airline string, total_flights long")
    t = publish_table(df, "flights_test_table")
    assert t.collect()[0]["airline"] == "AA"
    out = os.path.join(tmp_dir, "report")
    export_report_csv(df, out)
    files = [f for f in os.listdir(out) if f.endswith(".csv")]
    assert len(files) == 1


def test_streaming_ingest_is_incremental_and_exactly_once(spark, tmp_dir):
    raw = os.path.join(tmp_dir, "raw")
    os.makedirs(raw)
    _write(os.path.join(raw, "m01.csv"), _rows(1), HEADER, trailing_comma=True)
    out, ck = os.path.join(tmp_dir, "clean"), os.path.join(tmp_dir, "ckpt")
    q = start_monthly_ingest(spark, raw, out, ck)
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 4
    _write(os.path.join(raw, "m02.csv"), _rows(2), HEADER, trailing_comma=True)
    q = start_monthly_ingest(spark, raw, out, ck)       # rerun: only the new month
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == 8
    assert got.select("flight_date", "flight_number").distinct().count() == 8
    assert got.filter(F.col("is_delayed")).count() == 2


def test_single_layout_scan_validates_every_header(spark, tmp_dir):
    import pytest
    good = os.path.join(tmp_dir, "good")
    os.makedirs(good)
    _write(os.path.join(good, "a.csv"), _rows(1), HEADER, trailing_comma=True)
    _write(os.path.join(good, "b.csv"), _rows(2), HEADER, trailing_comma=True)
    assert clean_flights(read_raw_csv(spark, good + "/*.csv", layout="single")).count() == 8
    bad = os.path.join(tmp_dir, "bad")
    os.makedirs(bad)
    _write(os.path.join(bad, "a.csv"), _rows(1), HEADER, trailing_comma=True)
    _write(os.path.join(bad, "b.csv"), _rows(2), list(reversed(HEADER)), trailing_comma=True)
    with pytest.raises(Exception):
        read_raw_csv(spark, bad + "/*.csv", layout="single").collect()
    # grouped by header, the same files read correctly
    assert clean_flights(read_raw_csv(spark, bad + "/*.csv", layout="by_header")).count() == 8


def _check(spark, path):
    from pyspark.sql import Observation
    from flightlens.operators.clean import check_clean
    seen = Observation()
    clean_flights(read_raw_csv(spark, path), seen).write.format("noop").mode("overwrite").save()
    check_clean(seen)


@pytest.mark.parametrize("column, value, rule", [
    ("FL_DATE", "not a date", "flight_date_unparsed"), ("CANCELLED", "", "cancelled_missing"), ("DIVERTED", "", "diverted_missing"),
    ("ARR_DELAY", "12x", "values_unreadable"), ("DISTANCE", "abc", "values_unreadable")])
def test_clean_checks_stop_on_missing_and_unreadable_values(spark, tmp_dir, column, value, rule):
    rows = _rows(1)
    _write(os.path.join(tmp_dir, "good.csv"), rows, HEADER, trailing_comma=True)
    _check(spark, os.path.join(tmp_dir, "good.csv"))
    rows[2][column] = value
    _write(os.path.join(tmp_dir, "bad.csv"), rows, HEADER, trailing_comma=True)
    with pytest.raises(DataQualityError, match=rule):
        _check(spark, os.path.join(tmp_dir, "*.csv"))


def test_ingest_stops_on_a_row_without_flag(spark, tmp_dir):
    rows = _rows(1)
    rows[1]["CANCELLED"] = ""
    os.mkdir(os.path.join(tmp_dir, "raw"))
    _write(os.path.join(tmp_dir, "raw", "jan.csv"), rows, HEADER, trailing_comma=False)
    q = start_monthly_ingest(spark, os.path.join(tmp_dir, "raw"), os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck"))
    with pytest.raises(Exception, match="without date"):
        q.awaitTermination(120)


def test_only_columns_that_can_lose_a_value_are_looked_at(spark):
    """Numbers and dates always have a typed form: the check leaves no text of them in the plan."""
    from pyspark.sql import Observation
    from flightlens.operators import clean

    raw = spark.createDataFrame([(dt.date(2024, 1, 1), "AA", 3, 12.5, 0.0, "x")],
                                "FL_DATE date, OP_UNIQUE_CARRIER string, OP_CARRIER_FL_NUM int, DISTANCE double, CANCELLED double, AIR_TIME string")
    assert list(clean._doubtful(raw)) == ["air_time"]
    seen = Observation()
    clean.clean_flights(raw, seen).write.format("noop").mode("overwrite").save()
    assert seen.get["values_unreadable"] == 1


def test_checked_text_columns_stay_within_what_is_compiled(spark):
    """HotSpot compiles no method beyond 8,000 bytes of bytecode; typing the text of all columns has to stay below."""
    from pyspark.sql import Observation
    from flightlens.operators import clean

    raw = spark.range(10).select(*[F.col("id").cast("string").alias(c) for c in C.RAW_COLUMN_MAP])
    old = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        stages = clean.clean_flights(raw, Observation())._jdf.queryExecution().debug().codegenToSeq()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert all(stages.apply(i)._3().maxMethodCodeSize() <= 8000 for i in range(stages.size()))


def test_each_date_form_is_tried_on_its_own_texts(spark):
    from pyspark.sql import functions as F
    from pyspark.sql import types as T
    from flightlens.operators import clean

    texts = {"2024-07-04": dt.date(2024, 7, 4), " 7/4/2024 12:00:00 AM ": dt.date(2024, 7, 4), "7/4/2024": dt.date(2024, 7, 4),
             "07/04/2024": dt.date(2024, 7, 4), "7-4-2024": None, "": None, "abc": None, None: None, "2024-02-30": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    c = clean._parse_date(F.col("t"), T.StringType())
    assert {r["t"]: r["d"] for r in df.select("t", c.alias("d")).collect()} == texts
    assert str(c).count("contains") >= len(clean.DATE_FORMATS)

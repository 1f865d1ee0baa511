"""Time split proof and the exact-size seeded sample against brute force."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fixture_paths import SF0001
from flightlens.operators import split as S
from flightlens.operators.checks import DataQualityError
from flightlens.plans.stages import study_for


def test_split_boundary_and_proof(spark):
    dates = [dt.date(2024, 9, 30), dt.date(2024, 10, 1), dt.date(2024, 10, 2), dt.date(2024, 1, 1)]
    df = spark.createDataFrame([(d,) for d in dates], "flight_date date")
    tr, te = S.time_split(df, "2024-10-01")
    assert tr.count() == 2 and te.count() == 2
    row = S.split_proof(df, "2024-10-01").collect()[0]
    S.check_split(row, "2024-10-01")
    assert row["max_before"] == dt.date(2024, 9, 30) and row["min_after"] == dt.date(2024, 10, 1)


def test_window_proof_detects_gaps(spark):
    df = spark.createDataFrame([(1,), (5,), (9,)], "x int")
    row = S.window_proof(df, {"a": F.col("x") < 5, "b": F.col("x") > 5}).collect()[0]
    assert row["rows_in_none"] == 1
    with pytest.raises(DataQualityError):
        S.check_windows(row, "t")


def _brute(df, n, seed):
    cols = df.columns
    return df.select(*cols, S.rank_key(df, seed).alias("_h")).orderBy("_h", *cols).limit(n).drop("_h")


@pytest.mark.parametrize("n", [1, 37, 1000])
def test_exact_sample_is_the_brute_force_prefix(spark, n):
    tr = study_for(spark, SF0001).train()
    got = S.exact_sample(tr, n, 42)
    assert got.count() == n
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, _brute(tr, n, 42).collect()))


def test_exact_sample_is_repeatable_and_seeded(spark):
    tr = study_for(spark, SF0001).train()
    a = sorted(map(tuple, S.exact_sample(tr, 500, 42).collect()))
    b = sorted(map(tuple, S.exact_sample(tr, 500, 42).collect()))
    c = sorted(map(tuple, S.exact_sample(tr, 500, 7).collect()))
    assert a == b and a != c


def test_exact_sample_whole_table_when_n_is_large(spark):
    tr = study_for(spark, SF0001).train()
    assert S.exact_sample(tr, 10 ** 9, 42).count() == tr.count()


def test_exact_sample_with_duplicate_rows(spark):
    df = spark.createDataFrame([(i % 3, "x") for i in range(300)], "a int, b string")
    got = S.exact_sample(df, 100, 1, buckets=4)
    assert got.count() == 100
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, _brute(df, 100, 1).collect()))


def test_exact_sample_with_a_hot_duplicate_row(spark):
    """A third of the rows are one identical row: they collapse to one record."""
    rows = [(7, "hot")] * 1000 + [(i, "x") for i in range(2000)]
    df = spark.createDataFrame(rows, "a int, b string")
    for n in (10, 900, 1500):
        got = S.exact_sample(df, n, 3)
        assert got.count() == n
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, _brute(df, n, 3).collect()))


def test_exact_sample_splits_hot_copies(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_COPIES", 16)
    df = spark.createDataFrame([(7, "hot", None)] * 1000 + [(i, "x", 0.5) for i in range(200)], "a int, b string, c double")
    for n in (300, 1100):
        assert sorted(map(str, S.exact_sample(df, n, 3).collect())) == sorted(map(str, _brute(df, n, 3).collect()))


def test_exact_sample_does_not_depend_on_partitions(spark):
    tr = study_for(spark, SF0001).train()
    a, b = (sorted(map(tuple, S.exact_sample(tr.repartition(k), 300, 42).collect())) for k in (1, 9))
    assert a == b


def test_known_row_count_gives_the_same_sample_in_one_scan(spark):
    from flightlens.operators.split import exact_sample
    from flightlens.plans.stages import study_for
    st = study_for(spark, SF0001)
    tr = st.train()
    assert st.train_rows() == tr.count()
    a, b = (sorted(map(repr, exact_sample(tr, 500, 42, total=t).collect())) for t in (None, st.train_rows()))
    assert a == b and len(a) == 500
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one-scan", "sample")
    exact_sample(tr, 500, 42, total=st.train_rows()).write.format("noop").mode("overwrite").save()
    known = len(tracker.getJobIdsForGroup("one-scan"))
    spark.sparkContext.setJobGroup("two-scans", "sample")
    exact_sample(tr, 500, 42).write.format("noop").mode("overwrite").save()
    assert known < len(tracker.getJobIdsForGroup("two-scans"))

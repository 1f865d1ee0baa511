"""No caps, no stale stages, no checks that nulls slip through."""

import shutil

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fixture_paths import SF0001
from flightlens.operators import profile as PR
from flightlens.operators.checks import DataQualityError, require
from flightlens.plans.magnitude import Magnitude
from flightlens.plans.stages import input_state, study_for
from flightlens.sources import fixture
from flightlens.sources.raw_csv import read_raw_csv
from flightlens.sources.sinks import export_report_csv


def test_more_files_than_any_limit_in_two_layouts(spark, tmp_dir):
    for i in range(300):
        text = "YEAR,OP_UNIQUE_CARRIER\n2024,A\n" if i % 2 else "OP_UNIQUE_CARRIER,ORIGIN\nB,JFK\n"
        with open(f"{tmp_dir}/m{i:03d}.csv", "w") as f:
            f.write(text)
    raw = read_raw_csv(spark, tmp_dir + "/*.csv")
    assert raw.count() == 300 and raw.columns


def test_a_stage_follows_its_input(spark, tmp_dir):
    for t in fixture.FLIGHT_TABLES:
        shutil.copyfile(f"{SF0001}/{t}.parquet", f"{tmp_dir}/{t}.parquet")
    before = study_for(spark, tmp_dir).flights().count()
    state = input_state(spark, f"{tmp_dir}/*.parquet")
    pq.write_table(pq.read_table(f"{SF0001}/lineitem.parquet").slice(0, 100), f"{tmp_dir}/lineitem.parquet")
    assert input_state(spark, f"{tmp_dir}/*.parquet") != state
    assert study_for(spark, tmp_dir).flights().count() < before


def test_a_null_is_a_violation(spark):
    df = spark.createDataFrame([(5.0, None, 1.6, "a"), (5.0, 3.0, 1.6, "a")],
                               "arr_delay double, distance double, log_delay double, dep_hour_bin string")
    with pytest.raises(DataQualityError, match="distance_not_positive"):
        require(df, Magnitude._rules(), "test")


def test_histogram_of_nothing_has_all_bins(spark):
    h = PR.histogram(spark.createDataFrame([], "x double"), "x", 4).orderBy("bin").collect()
    assert [(r.bin, r.bin_lo, r.bin_hi, r.n) for r in h] == [(i, i / 4, (i + 1) / 4, 0) for i in range(4)]


def test_export_writes_every_row(spark, tmp_dir):
    export_report_csv(spark.range(1000).withColumn("x", F.col("id") * 2).orderBy(F.col("id").desc()), f"{tmp_dir}/out")
    text = [r.value for r in spark.read.text(f"{tmp_dir}/out").collect()]
    assert len([x for x in text if x != "id,x"]) == 1000


def test_ols_reads_all_rows_whatever_the_sample(spark):
    import dataclasses
    from flightlens.params import FIXTURE
    a = Magnitude(study_for(spark, SF0001))
    b = Magnitude(study_for(spark, SF0001, dataclasses.replace(FIXTURE, sample_size=50)))
    assert a.m1.nobs == b.m1.nobs == a.train.count()


def test_flights_are_moved_once_for_order_and_customer(spark, tmp_dir):
    """Without broadcasts no flight row is dealt out by its customer: orders and customers meet first."""
    from flightlens.sources import fixture

    tables = {"lineitem": "1L l_orderkey, 1L l_partkey, 1L l_suppkey, 1 l_linenumber, 100D l_extendedprice, 'O' l_linestatus, timestamp'1998-01-02' l_shipdate",
              "orders": "1L o_orderkey, 1L o_custkey", "customer": "1L c_custkey, 1 c_nationkey", "supplier": "1L s_suppkey, 2 s_nationkey",
              "part": "1L p_partkey, 'B' p_brand", "nation": "1 n_nationkey, 'PERU' n_name"}
    for name, row in tables.items():
        df = spark.sql(f"SELECT {row}")
        df = df.unionByName(spark.sql("SELECT 2 n_nationkey, 'CHINA' n_name")) if name == "nation" else df
        df.write.parquet(f"{tmp_dir}/{name}.parquet")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(old, ("-1", "false")):
            spark.conf.set(k, v)
        raw = fixture.raw_flights(spark, tmp_dir)
        plan = raw._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    depth = lambda line: min(line.find(x) for x in ("+-", ":-") if x in line)
    at = next(i for i, line in enumerate(plan) if "Exchange hashpartitioning(o_custkey" in line)
    below = []
    for line in plan[at + 1:]:
        if depth(line) <= depth(plan[at]):
            break
        below.append(line)
    assert any("o_orderkey" in line for line in below) and not any("l_linenumber" in line for line in below)
    assert [(r["ORIGIN"], r["DEST"], r["OP_UNIQUE_CARRIER"]) for r in raw.collect()] == [("CHINA", "PERU", "B")]

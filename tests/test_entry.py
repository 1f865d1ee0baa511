"""Driver contract and a fast oracle comparison at sf0.001."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from fixture_paths import SF0001
from flightlens import constants as C
from flightlens.plans.magnitude import Magnitude
from flightlens.plans.stages import study_for
from flightlens.sources.fixture import TABLES


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["airline", "total_flights", "delayed_flights", "delay_rate_pct", "avg_dep_delay_min"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def _canon(pdf):
    def norm(v):
        if v is None or v is pd.NA or v is pd.NaT:
            return None
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, bool):
            return v
        if isinstance(v, (int, float)):
            return None if (isinstance(v, float) and math.isnan(v)) else round(float(v), 9)
        if hasattr(v, "isoformat"):
            return str(v)[:10]
        return v
    cols = sorted(pdf.columns)
    rows = [tuple(norm(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(rows, key=repr)


FAST = ["delay_by_airline", "delay_heatmap_dow_month", "model_table", "prep_report", "eda_hist_late_log",
        "eda_airport_coverage", "ols_dow_hc1", "logit_dow", "eval_rate_sensitivity", "risk_baselines",
        # multi-factor fits refitted in SQL (Gauss-Jordan / IRLS / penalised Newton in recursive CTEs)
        "ols_m2_coefficients", "ols_vif", "risk_coefficients", "risk_inference_coefficients",
        "risk_discrimination", "risk_recalibration"]


@pytest.mark.parametrize("name", FAST)
def test_queries_match_oracle_sf0001(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF0001}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    got = _canon(E.queries()[name](spark, SF0001).toPandas())
    exp = _canon(con.execute(E.oracle_sql()[name]).fetchdf())
    assert got == exp


def test_fitted_levels_ignore_test_rows(spark):
    """Top-N sets, reference levels and level lists come from train only."""
    from pyspark.sql import functions as F
    from flightlens.plans.risk import Risk

    st = study_for(spark, SF0001)

    class AlteredTest:
        """Same study, but every test flight moved to one new airport and carrier."""
        spark, params = st.spark, st.params
        train, train_sample = st.train, st.train_sample

        def test(self):
            t = st.test()
            return t.unionByName(t.withColumn("origin", F.lit("ZZZ")).withColumn("airline", F.lit("QQ")))

    a, b = Magnitude(st), Magnitude(AlteredTest())
    assert (a.top_origins, a.top_dests, a.airline_levels) == (b.top_origins, b.top_dests, b.airline_levels)
    ra, rb = Risk(st), Risk(AlteredTest())
    assert ra.levels == rb.levels


def test_model_table_has_no_leakage(spark):
    mt = study_for(spark, SF0001).model_table()
    assert mt.columns == C.MODEL_COLUMNS
    assert not set(mt.columns) & set(C.LEAKAGE_COLUMNS)


def test_airline_seen_only_in_test_stops_the_baseline(spark):
    """J1: the per-airline baseline refuses a test airline without a train mean."""
    import pytest
    from pyspark.sql import functions as F
    from flightlens.operators.checks import DataQualityError

    st = study_for(spark, SF0001)

    class NewCarrierInTest:
        spark, params = st.spark, st.params
        train, train_sample = st.train, st.train_sample

        def test(self):
            t = st.test()
            return t.unionByName(t.limit(1).withColumn("airline", F.lit("QQ")))

    with pytest.raises(DataQualityError, match="airline_without_train_mean"):
        Magnitude(NewCarrierInTest()).comparison()


def test_zero_denominator_rate_is_null(spark):
    from pyspark.sql import functions as F
    from flightlens.functions import columns as X
    r = spark.range(1).select(X.safe_rate_pct(F.lit(3), F.lit(0)).alias("r")).collect()[0]
    assert r["r"] is None


def test_every_oracle_statement_runs():
    """All oracle SQL runs against the smallest shipped tables."""
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF0001}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    for name, sql in E.oracle_sql().items():
        con.execute(sql).fetchall()

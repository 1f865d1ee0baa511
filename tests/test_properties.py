"""Property-based checks (hypothesis) of the bucketing rules against numpy."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flightlens.operators import evaluate as E
from flightlens.operators import profile as PR

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(st.integers(min_value=-90, max_value=400), min_size=2, max_size=300),
       st.sampled_from([3, 48, 100]))
def test_histogram_property(spark, values, bins):
    x = np.array(values, dtype=float)
    df = spark.createDataFrame(pd.DataFrame({"v": x}))
    got = [r["n"] for r in PR.histogram(df, "v", bins).orderBy("bin").collect()]
    assert got == list(np.histogram(x, bins=bins)[0])


@SETTINGS
@given(st.lists(st.tuples(st.integers(min_value=0, max_value=20), st.booleans()), min_size=1, max_size=200))
def test_calibration_property(spark, pairs):
    p = np.array([a / 20 for a, _ in pairs])
    y = np.array([b for _, b in pairs], dtype=float)
    df = spark.createDataFrame(pd.DataFrame({"p": p, "y": y.astype(bool)}))
    got = {r["bin"]: (r["n"], r["prob_true"]) for r in E.calibration_curve(df, F.col("p"), *E.label_counts(F.col("y"))).collect()}
    bins = np.linspace(0.0, 1.0, 11)
    ids = np.searchsorted(bins[1:-1], p)          # the library definition of the bins
    for b in np.unique(ids):
        sel = ids == b
        assert got[int(b)][0] == sel.sum()
        assert abs(got[int(b)][1] - y[sel].mean()) < 1e-12
    assert len(got) == len(np.unique(ids))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(min_value=0, max_value=30), min_size=5, max_size=400),
       st.integers(min_value=1, max_value=400), st.integers(min_value=0, max_value=10_000),
       st.sampled_from([2, 16, 1024]))
def test_exact_sample_property(spark, values, n, seed, buckets):
    """Any size, seed, duplicate pattern and bucket count: the brute-force prefix."""
    from flightlens.operators import split as S
    df = spark.createDataFrame([(v, v % 3) for v in values], "a int, b int")
    want_n = min(n, len(values))
    got = S.exact_sample(df, n, seed, buckets=buckets)
    brute = df.select("a", "b", S.rank_key(df, seed).alias("_h")).orderBy("_h", "a", "b").limit(want_n).drop("_h")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, brute.collect()))


@SETTINGS
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=1, max_size=200),
       st.sampled_from([1, 2, 6]))
def test_half_away_rounding_property(spark, values, digits):
    """ROUND = half away from zero on the value fixed to 10 decimal places."""
    from decimal import ROUND_HALF_UP, Decimal
    from flightlens.functions import columns as X
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(X.half_away_round("x", digits)).collect()]
    for v, g in zip(values, got):
        d10 = Decimal(repr(v)).quantize(Decimal(1).scaleb(-10), rounding=ROUND_HALF_UP)
        want = float(d10.quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP))
        assert g == want, (v, g, want)


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.integers(min_value=-100, max_value=400).map(float)), min_size=1, max_size=200))
def test_delay_bucket_property(spark, values):
    """Right-closed bins (-inf,0], (0,15], (15,60], (60,180], (180,inf), NULL in NULL out, like pd.cut."""
    from flightlens import constants as C
    from flightlens.functions import columns as X
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(X.delay_bucket("x")).collect()]
    want = pd.cut(pd.Series(values, dtype="float64"), bins=[-np.inf] + C.DELAY_BUCKET_EDGES + [np.inf],
                  labels=C.DELAY_BUCKET_LABELS)
    assert got == [None if pd.isna(w) else str(w) for w in want]

"""Ranking, calibration and threshold operators against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flightlens.operators import evaluate as E


def _scored(spark, n=3000, seed=11, distinct=50):
    rng = np.random.default_rng(seed)
    p = np.round(rng.random(n) * (distinct - 1)) / (distinct - 1)   # many ties
    y = rng.random(n) < p * 0.8 + 0.1
    return spark.createDataFrame(pd.DataFrame({"p": p, "y": y})), p, y


def _auc_ap(p, y):
    P, N = y.sum(), (~y).sum()
    auc = 0.0
    for s in np.unique(p):
        at = p == s
        auc += ((~y) & at).sum() * ((y & (p > s)).sum() + 0.5 * (y & at).sum())
    auc /= P * N
    ap = 0.0
    for s in np.unique(p)[::-1]:
        sel = p >= s
        tp, fp = (y & sel).sum(), (~y & sel).sum()
        ap += (y & (p == s)).sum() / P * tp / (tp + fp)
    return auc, ap


@pytest.mark.parametrize("partitions", [1, 4])
def test_ranking_metrics_match_brute_force(spark, partitions):
    df, p, y = _scored(spark)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        r = E.ranking_metrics(df, F.col("p"), *E.label_counts(F.col("y"))).collect()[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    auc, ap = _auc_ap(p, y)
    assert r["roc_auc"] == pytest.approx(auc, abs=1e-12)
    assert r["average_precision"] == pytest.approx(ap, abs=1e-12)


def test_calibration_edges_go_to_the_lower_bin(spark):
    edges = E.uniform_edges(10)
    assert edges[3] == 0.30000000000000004 and edges[10] == 1.0
    df = spark.createDataFrame([(0.0, True), (0.1, False), (edges[3], True), (0.35, False), (1.0, True)],
                               "p double, y boolean")
    got = {r["bin"]: r["n"] for r in E.calibration_curve(df, F.col("p"), *E.label_counts(F.col("y"))).collect()}
    assert got == {0: 2, 2: 1, 3: 1, 9: 1}      # empty bins are absent


def test_threshold_sweep_matches_brute_force(spark):
    df, p, y = _scored(spark, distinct=23)
    sweep = E.threshold_sweep(E.threshold_histogram(df, F.col("p"), *E.label_counts(F.col("y"))))
    rows = {r["k"]: r for r in sweep.collect()}
    for k, t in enumerate(E.thresholds(), start=1):
        flag = p >= t
        r = rows[k]
        assert (r["tp"], r["fp"], r["fn"], r["tn"]) == ((y & flag).sum(), (~y & flag).sum(),
                                                        (y & ~flag).sum(), (~y & ~flag).sum())


def test_argmin_takes_lowest_threshold_on_ties_and_ratio_rule(spark):
    df, p, y = _scored(spark, distinct=5)          # scores 0, .25, .5, .75, 1 -> long cost plateaus
    sweep = E.threshold_sweep(E.threshold_histogram(df, F.col("p"), *E.label_counts(F.col("y"))))
    ch = {r["scenario"]: r for r in E.choose_thresholds(sweep, [(2, 4), (5, 10), (2, 25)]).collect()}
    assert ch[0]["threshold"] == ch[1]["threshold"]     # same cost ratio, same threshold
    ts = E.thresholds()
    costs = [((~y & (p >= t)).sum() * 2.0 + (y & (p < t)).sum() * 25.0) / len(p) * 1000.0 for t in ts]
    assert ch[2]["threshold"] == ts[int(np.argmin(costs))]


def test_zero_predicted_positives_give_zero_precision(spark):
    df = spark.createDataFrame([(True,), (False,)], "y boolean")
    r = E.confusion(df, F.lit(False), *E.label_counts(F.col("y"))).collect()[0]
    assert (r["precision"], r["recall"], r["f1"], r["accuracy"]) == (0.0, 0.0, 0.0, 0.5)


def test_probability_exactly_at_threshold_is_flagged(spark):
    df = spark.createDataFrame([(0.5, True), (0.49, False)], "p double, y boolean")
    sweep = E.threshold_sweep(E.threshold_histogram(df, F.col("p"), *E.label_counts(F.col("y"))))
    r = sweep.filter(F.col("threshold") == 0.5).collect()[0]
    assert (r["tp"], r["fp"]) == (1, 0)


def test_brier(spark):
    df = spark.createDataFrame([(0.2, True), (0.6, False)], "p double, y boolean")
    r = E.brier(df, F.col("p"), *E.label_counts(F.col("y"))).collect()[0]
    assert r["brier"] == pytest.approx((0.8 ** 2 + 0.6 ** 2) / 2)


def test_collapsed_counts_give_row_level_results(spark):
    """Metrics over (score, pos, neg) cells equal the metrics over the rows."""
    df, p, y = _scored(spark, distinct=17)
    pos, neg = E.label_counts(F.col("y"))
    cells = df.groupBy("p").agg(F.sum(pos).alias("pos"), F.sum(neg).alias("neg"))
    a = E.ranking_metrics(df, F.col("p"), pos, neg).collect()[0]
    b = E.ranking_metrics(cells, F.col("p"), F.col("pos"), F.col("neg")).collect()[0]
    assert a["roc_auc"] == pytest.approx(b["roc_auc"], abs=1e-12)
    assert a["average_precision"] == pytest.approx(b["average_precision"], abs=1e-12)
    ba = E.brier(df, F.col("p"), pos, neg).collect()[0]
    bb = E.brier(cells, F.col("p"), F.col("pos"), F.col("neg")).collect()[0]
    assert ba["brier"] == pytest.approx(bb["brier"], abs=1e-12) and ba["n"] == bb["n"]
    ca = sorted(map(tuple, E.calibration_curve(df, F.col("p"), pos, neg).collect()))
    cb = sorted(map(tuple, E.calibration_curve(cells, F.col("p"), F.col("pos"), F.col("neg")).collect()))
    assert [r[0] for r in ca] == [r[0] for r in cb] and [r[3] for r in ca] == [r[3] for r in cb]
    assert np.allclose([r[1] for r in ca], [r[1] for r in cb]) and np.allclose([r[2] for r in ca], [r[2] for r in cb])


def test_ranking_metrics_with_a_hot_score(spark):
    """A third of the rows share one score: it is one grouped record, not one task's worth of rows."""
    rng = np.random.default_rng(3)
    n = 3000
    p = np.where(np.arange(n) < n // 3, 0.42, np.round(rng.random(n), 2))
    y = rng.random(n) < p
    df = spark.createDataFrame(pd.DataFrame({"p": p, "y": y}))
    r = E.ranking_metrics(df, F.col("p"), *E.label_counts(F.col("y"))).collect()[0]
    auc, ap = _auc_ap(p, y)
    assert r["roc_auc"] == pytest.approx(auc, abs=1e-12)
    assert r["average_precision"] == pytest.approx(ap, abs=1e-12)

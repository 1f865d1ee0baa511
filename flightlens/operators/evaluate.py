"""Evaluation of scored rows: all of it aggregations.

Every operator takes counts instead of a label: ``pos`` and ``neg`` are the
number of positive / negative rows a record stands for. Row-level data is
the special case ``label_counts(label)`` (1/0 per row); collapsed data (one
record per distinct design row, see ``plans.risk``) passes its counts, so
the test set is scanned once and every metric below reads the small
collapsed table.

* confusion counts / precision / recall / F1: one conditional-sum pass;
* ROC-AUC and average precision: group by distinct score, then a running
  sum in descending score order computed as a distributed prefix sum
  (range partitions, per-partition totals, offsets) -- no single-task window
  over the scores;
* Brier score, calibration curve (10 right-closed equal-width bins);
* cost threshold sweep: scores are bucketed ONCE against the 91 thresholds,
  giving a <= 92-row histogram; every threshold, cost pair and report
  afterwards is a running sum over that histogram;
* intercept-only recalibration with an offset: Newton steps over the
  distinct offsets (a grouped, checkpointed table), not over the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..session import reliable_checkpoint


def _i(c: Column) -> Column:
    return F.when(c, F.lit(1)).otherwise(F.lit(0))


def label_counts(label: Column) -> tuple[Column, Column]:
    """(pos, neg) of one row from its label; a missing label counts as negative."""
    y = F.coalesce(label, F.lit(False))
    return _i(y), _i(~y)


def confusion(df: DataFrame, pred: Column, pos: Column, neg: Column) -> DataFrame:
    """tp, fp, fn, tn and accuracy / precision / recall / F1 (0 where undefined)."""
    p = F.coalesce(pred, F.lit(False))
    c = df.agg(F.sum(F.when(p, pos).otherwise(F.lit(0))).cast("bigint").alias("tp"),
               F.sum(F.when(p, neg).otherwise(F.lit(0))).cast("bigint").alias("fp"),
               F.sum(F.when(p, F.lit(0)).otherwise(pos)).cast("bigint").alias("fn"),
               F.sum(F.when(p, F.lit(0)).otherwise(neg)).cast("bigint").alias("tn"))
    return with_rates(c)


def _ratio0(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def with_rates(c: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    return c.select("*",
                    _ratio0(tp + tn, tp + fp + fn + tn).alias("accuracy"),
                    _ratio0(tp, tp + fp).alias("precision"),
                    _ratio0(tp, tp + fn).alias("recall"),
                    _ratio0(2 * tp, 2 * tp + fp + fn).alias("f1"))


# --- ranking metrics -------------------------------------------------------------

def score_counts(df: DataFrame, score: Column, pos: Column, neg: Column) -> DataFrame:
    """One row per distinct score: pos, neg."""
    return (df.select(score.alias("score"), pos.alias("_pos"), neg.alias("_neg"))
            .groupBy("score").agg(F.sum("_pos").cast("bigint").alias("pos"),
                                  F.sum("_neg").cast("bigint").alias("neg")))


def descending_prefix_sums(counts: DataFrame, cols: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Add ``cum_<c>`` = sum of c over all rows with a score >= this row's.

    Distributed: range-partition by score (descending), write to the
    checkpoint folder (range bounds are sampled, so the assignment must be
    fixed once), total each partition (one row per partition to the driver),
    then a window inside each partition plus the offsets of all earlier
    partitions (a broadcast of one row per partition).
    """
    spark = counts.sparkSession
    if partitions is None:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (counts.repartitionByRange(partitions, F.col("score").desc())
              .withColumn("_pid", F.spark_partition_id()))
    ranged = reliable_checkpoint(ranged)
    totals = ranged.groupBy("_pid").agg(*[F.sum(c).alias(c) for c in cols]).collect()
    offsets, run = [], {c: 0 for c in cols}
    for r in sorted(totals, key=lambda r: r["_pid"]):
        offsets.append((r["_pid"], *[run[c] for c in cols]))
        for c in cols:
            run[c] += r[c] or 0
    off = spark.createDataFrame(offsets, ["_pid"] + [f"_off_{c}" for c in cols])
    w = (Window.partitionBy("_pid").orderBy(F.col("score").desc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = ranged.join(F.broadcast(off), "_pid")
    for c in cols:
        out = out.withColumn(f"cum_{c}", F.sum(c).over(w) + F.col(f"_off_{c}"))
    return out.drop("_pid", *[f"_off_{c}" for c in cols])


def ranking_metrics(df: DataFrame, score: Column, pos: Column, neg: Column) -> DataFrame:
    """roc_auc (ties count half) and average_precision (step sum over distinct scores)."""
    counts = reliable_checkpoint(score_counts(df, score, pos, neg))    # read three times below
    cum = descending_prefix_sums(counts, ["pos", "neg"])
    tot = counts.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).collect()[0]
    P, N = float(tot["P"] or 0), float(tot["N"] or 0)
    tp_before = F.col("cum_pos") - F.col("pos")
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return cum.agg(
        (F.sum(F.col("neg") * (tp_before + F.col("pos") * F.lit(0.5))) / F.lit(P * N)).alias("roc_auc"),
        F.sum(F.col("pos") / F.lit(P) * prec).alias("average_precision"),
    ).select("roc_auc", "average_precision", F.lit(P / (P + N) if P + N else None).alias("positive_rate"))


# --- probability quality -----------------------------------------------------------

def brier(df: DataFrame, prob: Column, pos: Column, neg: Column) -> DataFrame:
    n = pos + neg
    sq = pos * (F.lit(1.0) - prob) * (F.lit(1.0) - prob) + neg * prob * prob
    return df.agg((F.sum(sq) / F.sum(n)).alias("brier"),
                  (F.sum(n * prob) / F.sum(n)).alias("mean_pred"),
                  (F.sum(pos) / F.sum(n)).alias("positive_rate"),
                  F.sum(n).cast("bigint").alias("n"))


def uniform_edges(n_bins: int) -> list[float]:
    """0, 1/n, 2/n, ..., 1 computed as i * (1/n) with the last edge exactly 1."""
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]


def calibration_bin(prob: Column, n_bins: int = C.CALIBRATION_BINS) -> Column:
    """Right-closed on the inner edges: p equal to an edge goes to the lower bin."""
    inner = uniform_edges(n_bins)[1:-1]
    b = F.when(prob <= F.lit(inner[0]), F.lit(0))
    for i, e in enumerate(inner[1:], start=1):
        b = b.when(prob <= F.lit(e), F.lit(i))
    return b.otherwise(F.lit(n_bins - 1))


def calibration_curve(df: DataFrame, prob: Column, pos: Column, neg: Column,
                      n_bins: int = C.CALIBRATION_BINS) -> DataFrame:
    """Per non-empty bin: prob_true (observed rate), prob_pred (mean p), n."""
    n = pos + neg
    return (df.select(calibration_bin(prob, n_bins).alias("bin"), pos.alias("_pos"), n.alias("_n"),
                      (n * prob).alias("_np"))
            .groupBy("bin").agg((F.sum("_pos") / F.sum("_n")).alias("prob_true"),
                                (F.sum("_np") / F.sum("_n")).alias("prob_pred"),
                                F.sum("_n").cast("bigint").alias("n")))


# --- cost-based thresholds -----------------------------------------------------------

def thresholds(lo_pct: int = C.THRESHOLD_PCT_RANGE[0], hi_pct: int = C.THRESHOLD_PCT_RANGE[1]) -> list[float]:
    """0.05, 0.06, ..., 0.95 as the doubles nearest to k/100."""
    return [k / 100 for k in range(lo_pct, hi_pct + 1)]


def threshold_histogram(df: DataFrame, prob: Column, pos: Column, neg: Column,
                        ts: Sequence[float] | None = None) -> DataFrame:
    """bucket b = number of thresholds <= p (so 'p >= t_k' is 'b >= k'); pos/neg per bucket."""
    ts = list(ts or thresholds())
    scored = df.select(prob.alias("p"), pos.alias("_pos"), neg.alias("_neg"))
    bucketed = Bucketizer(splits=[-math.inf] + ts + [math.inf], inputCol="p", outputCol="b",
                          handleInvalid="keep").transform(scored)
    return (bucketed.groupBy(F.col("b").cast("int").alias("b"))
            .agg(F.sum("_pos").cast("bigint").alias("pos"), F.sum("_neg").cast("bigint").alias("neg")))


def threshold_sweep(hist: DataFrame, ts: Sequence[float] | None = None) -> DataFrame:
    """tp, fp, fn, tn, n at every threshold from the bucket histogram (<= 92 rows)."""
    ts = list(ts or thresholds())
    spark = hist.sparkSession
    grid = spark.createDataFrame([(k, t) for k, t in enumerate(ts, start=1)], "k int, threshold double")
    buckets = spark.range(len(ts) + 1).select(F.col("id").cast("int").alias("b"))
    h = (buckets.join(F.broadcast(hist), "b", "left")
         .select("b", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("neg", F.lit(0)).alias("neg")))
    w_below = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(F.lit(1))
    # the windows run over <= 92 histogram rows, never over the scored rows
    h = (h.withColumn("pos_below", F.coalesce(F.sum("pos").over(w_below), F.lit(0)))
          .withColumn("neg_below", F.coalesce(F.sum("neg").over(w_below), F.lit(0)))
          .withColumn("P", F.sum("pos").over(w_all))
          .withColumn("N", F.sum("neg").over(w_all)))
    sw = grid.join(F.broadcast(h), grid.k == h.b)
    return sw.select(
        "k", "threshold",
        (F.col("P") - F.col("pos_below")).cast("bigint").alias("tp"),
        (F.col("N") - F.col("neg_below")).cast("bigint").alias("fp"),
        F.col("pos_below").cast("bigint").alias("fn"),
        F.col("neg_below").cast("bigint").alias("tn"),
        (F.col("P") + F.col("N")).cast("bigint").alias("n"))


def cost_per_1000(fp: Column, fn: Column, n: Column, c_fp: float, c_fn: float) -> Column:
    return (fp * F.lit(float(c_fp)) + fn * F.lit(float(c_fn))) / n * F.lit(1000.0)


def choose_thresholds(val_sweep: DataFrame, scenarios: Sequence[tuple[float, float]]) -> DataFrame:
    """Per cost scenario (fp cost, fn cost): the cost-minimising threshold,
    lowest threshold on ties. Scenarios ride along as a literal array, so the
    91 x len(scenarios) grid is generated, not joined."""
    sc = F.explode(F.array(*[F.struct(F.lit(i).alias("scenario"), F.lit(float(a)).alias("cost_fp"),
                                      F.lit(float(b)).alias("cost_fn"))
                             for i, (a, b) in enumerate(scenarios)])).alias("sc")
    g = val_sweep.select("*", sc).select("*", "sc.*").drop("sc")
    g = g.withColumn("cost", (F.col("fp") * F.col("cost_fp") + F.col("fn") * F.col("cost_fn"))
                     / F.col("n") * F.lit(1000.0))
    best = g.groupBy("scenario", "cost_fp", "cost_fn").agg(
        F.min(F.struct("cost", "k", "threshold")).alias("m"))
    return best.select("scenario", "cost_fp", "cost_fn",
                       F.col("m.k").alias("k"), F.col("m.threshold").alias("threshold"),
                       F.col("m.cost").alias("val_cost_per_1000"))


def sensitivity(val_sweep: DataFrame, test_sweep: DataFrame,
                scenarios: Sequence[tuple[float, float]] = C.COST_SCENARIOS) -> DataFrame:
    """Threshold picked on validation per cost pair, judged on test."""
    chosen = choose_thresholds(val_sweep, scenarios)
    t = test_sweep.select("k", "tp", "fp", "fn", "tn", "n")
    j = chosen.join(F.broadcast(t), "k")
    tp, fp, fn, tn, n = (F.col(c) for c in ("tp", "fp", "fn", "tn", "n"))
    model_cost = (fp * F.col("cost_fp") + fn * F.col("cost_fn")) / n * F.lit(1000.0)
    flag_all = ((fp + tn) * F.col("cost_fp")) / n * F.lit(1000.0)
    return j.select(
        "scenario", "cost_fp", "cost_fn",
        (F.col("cost_fn") / F.col("cost_fp")).alias("cost_ratio_fn_fp"),
        "threshold",
        _ratio0(tp, tp + fp).alias("precision"),
        _ratio0(tp, tp + fn).alias("recall"),
        ((tp + fp).cast("double") / n.cast("double")).alias("flagged_share"),
        model_cost.alias("model_cost_per_1000"),
        flag_all.alias("flag_all_cost_per_1000"),
        (flag_all - model_cost).alias("savings_vs_flag_all"),
        ((flag_all - model_cost) / flag_all * F.lit(100.0)).alias("savings_pct_of_flag_all"),
    )


FINDINGS = ("first_ratio_flagging_under_half", "lowest_ratio_with_meaningful_saving")


def sensitivity_findings(sens: DataFrame, flagged_limit: float = C.FLAGGED_SHARE_LIMIT,
                         saving_pct: float = C.MEANINGFUL_SAVING_PCT) -> DataFrame:
    """Two findings, a row each: the highest ratio flagging under 50%, and the
    lowest ratio saving at least 10% against flagging everything. A finding
    that no cost pair shows keeps its row, with nulls."""
    under = (sens.filter(F.col("flagged_share") < flagged_limit)
             .orderBy(F.col("cost_ratio_fn_fp").desc(), F.col("scenario")).limit(1)
             .select(F.lit(FINDINGS[0]).alias("finding"), "*"))
    saving = (sens.filter(F.col("savings_pct_of_flag_all") >= saving_pct)
              .orderBy(F.col("cost_ratio_fn_fp").asc(), F.col("scenario")).limit(1)
              .select(F.lit(FINDINGS[1]).alias("finding"), "*"))
    names = sens.sparkSession.createDataFrame([(n,) for n in FINDINGS], "finding string")
    return names.join(under.unionByName(saving), "finding", "left")


def report_at(test_hist_sweep: DataFrame, threshold_k: int, c_fp: float, c_fn: float) -> DataFrame:
    """Precision / recall / F1 / cost at one threshold index, from the sweep."""
    r = with_rates(test_hist_sweep.filter(F.col("k") == threshold_k))
    return r.withColumn("cost_per_1000", cost_per_1000(F.col("fp"), F.col("fn"), F.col("n"), c_fp, c_fn))


# --- recalibration -----------------------------------------------------------------

def refit_intercept(df: DataFrame, offset: Column, pos: Column, neg: Column, start: float = 0.0,
                    max_iter: int = 50, tol: float = 1e-12) -> tuple[float, int]:
    """Maximum-likelihood intercept of a logit with a fixed offset.

    Records collapse to distinct offsets (n, positives), written to the
    checkpoint folder; each Newton step is one small aggregation over them.
    """
    g = reliable_checkpoint(df.select(offset.alias("o"), pos.alias("_pos"), neg.alias("_neg"))
                            .groupBy("o").agg(F.sum(F.col("_pos") + F.col("_neg")).cast("double").alias("n"),
                                              F.sum("_pos").cast("double").alias("pos")))
    b, it = float(start), 0
    for it in range(1, max_iter + 1):
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("o") + F.lit(b))))
        r = g.agg(F.sum(F.col("pos") - F.col("n") * p).alias("grad"),
                  F.sum(F.col("n") * p * (F.lit(1.0) - p)).alias("hess")).collect()[0]
        step = r["grad"] / r["hess"]
        b += step
        if abs(step) < tol:
            break
    return b, it

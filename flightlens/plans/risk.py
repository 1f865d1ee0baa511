"""Will a flight arrive 15+ minutes late? Booking-time logistic risk model.

Features known at booking: departure-hour segment, weekday, carrier, top-N
origin / destination (else OTHER), log distance, holiday window. The
deployable model is an L2 logistic regression fitted on train rows before
the fit cut-off; the month after it is the validation slice for choosing a
cost-based threshold; test is only scored. A separate unpenalised fit on
the seeded train sample gives odds ratios with intervals. The test set is
scored once, as one expression; every metric after that is an aggregation.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import columns as X
from ..operators import evaluate as E
from ..operators import logistic as L
from ..operators import profile as PR
from ..operators import split as S
from ..operators.checks import DataQualityError, require_none
from ..operators.design import Design, Factor, Flag, Numeric
from ..session import reliable_checkpoint
from .stages import Study


def _d(x: str) -> Column:
    return F.lit(x).cast("date")


def _after(iso: str) -> str:
    return (dt.date.fromisoformat(iso) + dt.timedelta(days=1)).isoformat()


def reference_first(levels: list, reference, what: str) -> tuple:
    """A level list led by its reference; a level without rows has nothing to be compared with."""
    if reference not in levels:
        raise DataQualityError(f"{what}: no rows have the reference level {reference!r}")
    return (reference, *(x for x in levels if x != reference))


class Risk:
    def __init__(self, study: Study):
        self.study = study
        self.spark = study.spark
        self.p = study.params

    # -- frames and fitted levels -----------------------------------------------------
    @cached_property
    def _train_profile(self) -> dict:
        """Everything the study needs to know about train from ONE scan.

        GROUPING SETS (origin), (dest), (airline), () give the level counts
        behind the top-N sets and the carrier order, and the grand total
        gives the date bounds, the fit / validation proof and the fit delay
        rate. The counts are written; the driver gets the total, the carriers
        (each is a design column) and the top-N airports, in order.
        """
        tr = self.study.train()
        d = F.col("flight_date")
        fit, val = self.fit_mask(), self.val_mask()
        keys = ["origin", "dest", "airline"]
        g = (tr.select(*keys, "flight_date", "is_delayed")
             .groupingSets([[F.col("origin")], [F.col("dest")], [F.col("airline")], []], *keys)
             .agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"),
                  F.min(d).alias("min_date"), F.max(d).alias("max_date"),
                  F.count_if(fit).alias("rows_fit"), F.count_if(val).alias("rows_validation"),
                  F.count_if(~fit & ~val).alias("rows_in_none"), F.count_if(fit & val).alias("rows_in_several"),
                  F.count_if(d < _d(self.p.train_start)).alias("rows_before_the_study"),
                  F.count_if(fit & F.col("is_delayed")).alias("fit_pos")))
        g = reliable_checkpoint(g)
        # grouping_id bit i (from the left) is 1 when key i is not grouped
        gid = {"origin": 0b011, "dest": 0b101, "airline": 0b110, "total": 0b111}

        def ordered(col, top=None):
            levels = g.filter(F.col("gid") == gid[col]).orderBy(F.col("n").desc(), F.col(col)).select(col, "n")
            return (levels if top is None else levels.limit(top)).collect()

        top = {c: ordered(c, self.p.top_n_airports) for c in ("origin", "dest")}
        return {**{c: [r[c] for r in rows] for c, rows in top.items()}, "airline": [r["airline"] for r in ordered("airline")],
                "counts": {c: {r[c]: r["n"] for r in rows} for c, rows in top.items()},
                "total": g.filter(F.col("gid") == gid["total"]).first()}

    @cached_property
    def top_origins(self) -> list:
        return self._train_profile["origin"][:self.p.top_n_airports]

    @cached_property
    def top_dests(self) -> list:
        return self._train_profile["dest"][:self.p.top_n_airports]

    @cached_property
    def airline_counts(self) -> list:
        return self._train_profile["airline"]

    @cached_property
    def ref_airport(self) -> str | None:
        """Given, or the busiest origin that is also a top destination."""
        return self.p.ref_airport or next((a for a in self.top_origins if a in self.top_dests), None)

    @cached_property
    def ref_airline(self) -> str | None:
        """Given, or the carrier with most train rows."""
        return self.p.ref_airline or next(iter(self.airline_counts), None)

    def features(self, df: DataFrame) -> DataFrame:
        return df.select(
            "*",
            X.dep_hour_bin("dep_hour").alias("dep_hour_bin"),
            X.top_or_other("origin", self.top_origins).alias("origin_top"),
            X.top_or_other("dest", self.top_dests).alias("dest_top"),
            F.log(F.col("distance")).alias("log_distance"),
        )

    @cached_property
    def levels(self) -> dict[str, tuple]:
        require_none({"rows_before_the_study": self._train_profile["total"]["rows_before_the_study"]}, "risk train")
        airports = {c: reference_first(sorted(set(top)), self.ref_airport, f"busiest {c} airports") + (C.OTHER_LEVEL,)
                    for c, top in (("origin", self.top_origins), ("dest", self.top_dests))}
        return {
            "dep_hour_bin": tuple(C.DEP_HOUR_BIN_MODEL_ORDER),
            "dow": tuple(C.DOW_ORDER),
            "airline": reference_first(self.airline_counts, self.ref_airline, "train carriers"),
            "origin_top": airports["origin"],
            "dest_top": airports["dest"],
        }

    @cached_property
    def deploy_design(self) -> Design:
        lv = self.levels
        return Design(tuple(Factor(c, lv[c]) for c in ("dep_hour_bin", "dow", "airline", "origin_top", "dest_top"))
                      + (Numeric("log_distance"), Flag("holiday_flag")))

    @cached_property
    def inference_design(self) -> Design:
        lv = self.levels
        return Design((Factor("dep_hour_bin", lv["dep_hour_bin"]), Factor("dow", lv["dow"]), Flag("holiday_flag"),
                       Factor("airline", lv["airline"]), Factor("origin_top", lv["origin_top"]),
                       Factor("dest_top", lv["dest_top"]), Numeric("log_distance")))

    @cached_property
    def train(self) -> DataFrame:
        return self.features(self.study.train())

    @cached_property
    def test(self) -> DataFrame:
        return self.features(self.study.test())

    def fit_mask(self) -> Column:
        return F.col("flight_date") < _d(self.p.fit_cutoff)

    def val_mask(self) -> Column:
        d = F.col("flight_date")
        return (d >= _d(self.p.fit_cutoff)) & (d <= _d(self.p.validation_end))

    @cached_property
    def fit_val_proof(self) -> DataFrame:
        t = self._train_profile["total"]
        proof = self.spark.createDataFrame(
            [(t["rows_fit"], t["rows_validation"], t["rows_in_none"], t["rows_in_several"])],
            "rows_fit long, rows_validation long, rows_in_none long, rows_in_several long")
        S.check_windows(t, "fit/validation")
        return proof

    def other_shares(self) -> DataFrame:
        """Share of train / test rows folded into OTHER, per airport column (percent).

        Train from the level counts of the one profile scan, test from the
        test rows in one aggregation.
        """
        prof = self._train_profile
        n = prof["total"]["n"]
        rows = []
        for col, top in (("origin", self.top_origins), ("dest", self.top_dests)):
            inside = sum(prof["counts"][col].get(a, 0) for a in top)
            rows.append(("train", f"{col}_top", (n - inside) / n * 100.0 if n else None))
        tc = self.test_rows
        t = tc.agg(*[(F.sum(F.when(F.col(c) == C.OTHER_LEVEL, F.col("n")).otherwise(0)) / F.sum("n")
                      * F.lit(100.0)).alias(c) for c in ("origin_top", "dest_top")]).collect()[0]
        rows += [("test", "origin_top", t["origin_top"]), ("test", "dest_top", t["dest_top"])]
        return self.spark.createDataFrame(rows, "split string, feature string, other_pct double")

    # -- models -----------------------------------------------------------------------
    @cached_property
    def model(self) -> L.LogisticFit:
        return L.fit_penalized(self.fit_rows, self.deploy_design, F.col("is_delayed"))

    @cached_property
    def inference(self) -> L.LogisticFit:
        sample = self.features(self.study.train_sample())
        return L.fit_inference(sample, self.inference_design, F.col("is_delayed"))

    # -- train and test rows as the fit and the metrics read them ---------------------------
    # Only the columns a metric depends on: the design row, the rule baseline's flag
    # (hour >= 16 splits one hour bin, so it is its own boolean) and the label as
    # counts. A projection of the stage table: no shuffle; a slice reads its months only.
    ROW_COLUMNS = ("dep_hour_bin", "dow", "airline", "origin_top", "dest_top", "log_distance", "holiday_flag")

    def _rows(self, df: DataFrame, flags: dict[str, Column]) -> DataFrame:
        pos, neg = E.label_counts(F.col("is_delayed"))
        return df.select(*self.ROW_COLUMNS, *[c.alias(k) for k, c in flags.items()],
                         (F.col("dep_hour") >= C.RULE_BASELINE_HOUR).alias("rule_flag"), "is_delayed",
                         F.lit(1).cast("bigint").alias("n"), pos.cast("bigint").alias("pos"),
                         neg.cast("bigint").alias("neg"), "flight_date")

    @cached_property
    def test_rows(self) -> DataFrame:
        recal, rest = self._recal_masks()
        return self._rows(self.test, {"in_recal": recal, "in_rest": rest})

    @cached_property
    def fit_rows(self) -> DataFrame:
        self.fit_val_proof            # fit and validation cover train exactly once
        return self._rows(self.features(self.study.train(before=self.p.fit_cutoff)), {})

    @cached_property
    def val_rows(self) -> DataFrame:
        self.fit_val_proof
        return self._rows(self.features(self.study.train(start=self.p.fit_cutoff, before=_after(self.p.validation_end))), {})

    @cached_property
    def recal_rows(self) -> DataFrame:
        return self._rows(self.features(self.study.test(before=_after(self.p.recal_end))), {})

    @cached_property
    def remaining_rows(self) -> DataFrame:
        return self._rows(self.features(self.study.test(start=self.p.remainder_start)), {})

    def scored_test(self) -> DataFrame:
        """Test rows with the model's log-odds and probability (one expression)."""
        return self.test_rows.select("*", self.model.logit().alias("logit"), self.model.prob().alias("p"))

    # -- reports ------------------------------------------------------------------------
    def baselines(self) -> DataFrame:
        c, pos, neg = self.test_rows, F.col("pos"), F.col("neg")
        b0 = E.confusion(c, F.lit(False), pos, neg).select(F.lit("B0: always not delayed").alias("baseline"), "*")
        b1 = E.confusion(c, F.col("rule_flag"), pos, neg).select(
            F.lit(f"B1: dep_hour >= {C.RULE_BASELINE_HOUR}").alias("baseline"), "*")
        return b0.unionByName(b1)

    def fit_summary(self) -> DataFrame:
        m = self.model
        t = self._train_profile["total"]
        fit_rate = t["fit_pos"] / t["rows_fit"] if t["rows_fit"] else None
        val = self.val_rows.agg(F.sum("n"), F.sum("pos") / F.sum("n")).collect()[0]
        return self.spark.createDataFrame(
            [(m.solver, m.reason, m.n_iter, m.converged, m.intercept, m.nobs, fit_rate, float(val[0]), val[1],
              self.ref_airline, self.ref_airport, self.deploy_design.width - 1)],
            "solver string, reason string, n_iter int, converged boolean, intercept double, fit_rows double, "
            "fit_delay_rate double, validation_rows double, validation_delay_rate double, "
            "ref_airline string, ref_airport string, n_features int")

    def coefficients(self) -> DataFrame:
        return self.model.table(self.spark).select("term", "family", "coef")

    def discrimination(self) -> DataFrame:
        r = E.ranking_metrics(self.scored_test(), F.col("p"), F.col("pos"), F.col("neg"))
        return r.select(F.col("roc_auc"), F.col("average_precision").alias("pr_auc"),
                        F.col("positive_rate").alias("pr_auc_floor"),
                        (F.col("average_precision") / F.col("positive_rate")).alias("lift"))

    def calibration(self) -> DataFrame:
        return E.calibration_curve(self.scored_test(), F.col("p"), F.col("pos"), F.col("neg"))

    def brier_full(self) -> DataFrame:
        b = E.brier(self.scored_test(), F.col("p"), F.col("pos"), F.col("neg"))
        return b.withColumn("gap", F.col("mean_pred") - F.col("positive_rate"))

    def _recal_masks(self):
        d = F.col("flight_date")
        recal = (d >= _d(self.p.split_date)) & (d <= _d(self.p.recal_end))
        rest = d >= _d(self.p.remainder_start)
        return recal, rest

    def recal_proof(self) -> DataFrame:
        """Rows per slice, rows in neither and in both (exhaustive and disjoint)."""
        c = self.test_rows
        r, s = F.coalesce(F.col("in_recal"), F.lit(False)), F.coalesce(F.col("in_rest"), F.lit(False))
        return c.agg(F.sum(F.when(r, F.col("n")).otherwise(0)).cast("bigint").alias("rows_recal"),
                     F.sum(F.when(s, F.col("n")).otherwise(0)).cast("bigint").alias("rows_remaining"),
                     F.sum(F.when(~r & ~s, F.col("n")).otherwise(0)).cast("bigint").alias("rows_in_none"),
                     F.sum(F.when(r & s, F.col("n")).otherwise(0)).cast("bigint").alias("rows_in_several"))

    @cached_property
    def recalibrated_intercept(self) -> tuple[float, int]:
        S.check_windows(self.recal_proof().collect()[0], "recalibration slices")
        return E.refit_intercept(self.recal_rows, self.model.offset(), F.col("pos"), F.col("neg"))

    def _remaining_scored(self) -> DataFrame:
        new_b, _ = self.recalibrated_intercept
        off = self.model.offset()
        return self.remaining_rows.select(
            "pos", "neg",
            X.sigmoid(off + F.lit(self.model.intercept)).alias("p_before"),
            X.sigmoid(off + F.lit(new_b)).alias("p_after"))

    def recalibration(self) -> DataFrame:
        new_b, iters = self.recalibrated_intercept
        rem = self._remaining_scored()
        before = E.brier(rem, F.col("p_before"), F.col("pos"), F.col("neg")).collect()[0]
        after = E.brier(rem, F.col("p_after"), F.col("pos"), F.col("neg")).collect()[0]
        return self.spark.createDataFrame(
            [(self.model.intercept, new_b, iters, before["brier"], after["brier"],
              after["brier"] < before["brier"], int(before["n"]))],
            "original_intercept double, recalibrated_intercept double, newton_steps int, "
            "brier_before double, brier_after double, improved boolean, remaining_rows long")

    def recalibration_curves(self) -> DataFrame:
        rem = self._remaining_scored()
        pos, neg = F.col("pos"), F.col("neg")
        before = E.calibration_curve(rem, F.col("p_before"), pos, neg).select(F.lit("before").alias("which"), "*")
        after = E.calibration_curve(rem, F.col("p_after"), pos, neg).select(F.lit("after").alias("which"), "*")
        return before.unionByName(after)

    @cached_property
    def val_sweep(self) -> DataFrame:
        h = E.threshold_histogram(self.val_rows, self.model.prob(), F.col("pos"), F.col("neg"))
        return reliable_checkpoint(E.threshold_sweep(h))     # 91 rows

    @cached_property
    def test_sweep(self) -> DataFrame:
        h = E.threshold_histogram(self.test_rows, self.model.prob(), F.col("pos"), F.col("neg"))
        return reliable_checkpoint(E.threshold_sweep(h))     # 91 rows

    def threshold_costs(self) -> DataFrame:
        return self.val_sweep.select("k", "threshold", "fp", "fn", "n",
                                     E.cost_per_1000(F.col("fp"), F.col("fn"), F.col("n"),
                                                     self.p.false_alarm_cost, self.p.missed_delay_cost)
                                     .alias("cost_per_1000"))

    def chosen_threshold(self) -> DataFrame:
        """Cost-minimising threshold on the validation slice (lowest on ties) and its cost."""
        return E.choose_thresholds(self.val_sweep, [(self.p.false_alarm_cost, self.p.missed_delay_cost)])

    def threshold_report(self) -> DataFrame:
        """Chosen threshold vs 0.5 on test; saving = cost at 0.5 minus cost at this row."""
        chosen = self.chosen_threshold().collect()[0]
        k_default = E.thresholds().index(C.DEFAULT_THRESHOLD) + 1
        a = E.report_at(self.test_sweep, chosen["k"], self.p.false_alarm_cost, self.p.missed_delay_cost)
        b = E.report_at(self.test_sweep, k_default, self.p.false_alarm_cost, self.p.missed_delay_cost)
        both = (a.select(F.lit("cost-optimal").alias("label"), "*")
                .unionByName(b.select(F.lit("default 0.5").alias("label"), "*")))
        default_cost = float(b.select("cost_per_1000").collect()[0][0])   # one scalar
        return both.withColumn("saving_vs_default_per_1000", F.lit(default_cost) - F.col("cost_per_1000"))

    def sensitivity(self, scenarios=None) -> DataFrame:
        return E.sensitivity(self.val_sweep, self.test_sweep, scenarios or self.p.cost_scenarios)

    def findings(self, scenarios=None) -> DataFrame:
        return E.sensitivity_findings(self.sensitivity(scenarios))

    def odds_ratios(self) -> DataFrame:
        return L.odds_ratio_table(self.inference, self.spark)

    def inference_summary(self) -> DataFrame:
        f = self.inference
        return self.spark.createDataFrame(
            [(f.nobs, f.n_iter, f.converged, f.pseudo_r2)],
            "nobs double, iterations int, converged boolean, pseudo_r2 double")

    def picks(self) -> DataFrame:
        return L.family_picks(self.odds_ratios())


__all__ = ["Risk", "DataQualityError"]

"""How late does a late flight run? Log-linear OLS with HC1 errors.

Fit population: all train rows with arr_delay > 0; test
rows with arr_delay > 0 are only scored. Every fitted object (top-N airport
sets, reference airline, level lists, per-airline means) comes from the
train frame and is passed on as a value, so the test frame never shapes a
modelling choice.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import columns as X
from ..functions import dist
from ..operators import ols as O
from ..operators import profile as PR
from ..operators.checks import DataQualityError, require
from ..operators.design import Design, Factor, Flag, Numeric, moments
from ..operators.split import exact_sample
from ..session import reliable_checkpoint
from .stages import Study


def late_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("arr_delay") > 0).withColumn("log_delay", F.log(F.col("arr_delay")))


class Magnitude:
    def __init__(self, study: Study):
        self.study = study
        self.spark = study.spark
        self.params = study.params

    # -- frames ------------------------------------------------------------------
    @cached_property
    def _train_late_raw(self) -> DataFrame:
        return late_only(self.study.train())

    @cached_property
    def top_origins(self) -> list:
        return PR.top_levels(self._train_late_raw, "origin", self.params.top_n_airports)

    @cached_property
    def top_dests(self) -> list:
        return PR.top_levels(self._train_late_raw, "dest", self.params.top_n_airports)

    def features(self, df: DataFrame) -> DataFrame:
        return df.select(
            "*",
            X.dep_hour_bin("dep_hour").alias("dep_hour_bin"),
            X.top_or_other("origin", self.top_origins).alias("origin_top"),
            X.top_or_other("dest", self.top_dests).alias("dest_top"),
            F.log(F.col("distance")).alias("log_distance"),
        )

    @cached_property
    def train(self) -> DataFrame:
        tr = self.features(self._train_late_raw)
        self._check(tr, "train")
        return tr

    @cached_property
    def test(self) -> DataFrame:
        """Late test rows with features; checked inside the one scoring pass (``comparison``)."""
        return self.features(late_only(self.study.test()))

    @staticmethod
    def _rules() -> dict:
        return {
            "arr_delay_not_positive": ~F.coalesce(F.col("arr_delay") > 0, F.lit(False)),
            "log_delay_not_finite": F.col("log_delay").isNull() | F.isnan("log_delay"),
            "dep_hour_bin_missing": F.col("dep_hour_bin").isNull(),
            "distance_not_positive": ~F.coalesce(F.col("distance") > 0, F.lit(False)),
        }

    def _check(self, df: DataFrame, label: str) -> None:
        require(df, self._rules(), f"magnitude {label}")

    # -- levels and designs ----------------------------------------------------------
    @cached_property
    def airline_levels(self) -> tuple:
        counts = PR.all_levels_by_count(self.train, "airline")
        return tuple(counts)   # most frequent first = reference

    def _top_levels(self, col: str) -> tuple:
        vals = [r[0] for r in self.train.select(col).distinct().collect()]  # <= top_n + 1 values
        return tuple(sorted(vals))   # alphabetical first level is the reference

    @cached_property
    def m1_design(self) -> Design:
        return Design((Factor("dep_hour_bin", tuple(C.DEP_HOUR_BIN_MODEL_ORDER)),
                       Factor("dow", tuple(C.DOW_ORDER)),
                       Flag("holiday_flag")))

    @cached_property
    def m2_design(self) -> Design:
        return Design(self.m1_design.terms + (
            Factor("airline", self.airline_levels),
            Factor("origin_top", self._top_levels("origin_top")),
            Factor("dest_top", self._top_levels("dest_top")),
            Numeric("log_distance")))

    @cached_property
    def vif_design(self) -> Design:
        return Design(self.m1_design.terms + (Factor("airline", self.airline_levels), Numeric("log_distance")))

    # -- fits ----------------------------------------------------------------------
    @cached_property
    def m1(self) -> O.OLSFit:
        return O.fit_ols(None, self.m1_design, None, cell_df=self.cells, prefix="s")

    @cached_property
    def cells(self) -> DataFrame:
        """One scan for every fit: the factors of M2 with power sums of log distance, of log minutes
        (to the fourth, for Breusch-Pagan) and of raw minutes."""
        return reliable_checkpoint(moments(self.train, self.m2_design,
                                           {"s": (F.col("log_delay"), 4), "r": (F.col("arr_delay"), 2)}))

    @cached_property
    def m2(self) -> O.OLSFit:
        return O.fit_ols(None, self.m2_design, None, breusch_pagan=True, cell_df=self.cells, prefix="s")

    @cached_property
    def m2_raw(self) -> O.OLSFit:
        """Same right-hand side on raw minutes; only its residuals are used."""
        return O.fit_ols(None, self.m2_design, None, cov_type="nonrobust", cell_df=self.cells, prefix="r")

    # -- baselines and comparison --------------------------------------------------------
    @cached_property
    def b0_value(self) -> float:
        return float(self.train.agg(F.avg("log_delay")).collect()[0][0])

    @cached_property
    def b1_means(self) -> DataFrame:
        return self.train.groupBy("airline").agg(F.avg("log_delay").alias("b1_pred"))

    def comparison(self) -> DataFrame:
        """B0, B1, M1, M2 on test: RMSE / MAE on the log scale and in minutes (exp, no smearing).

        ONE pass over the late test rows computes the 16 metrics together with
        the data checks, the count of factor levels unseen in train (formula
        scoring refuses them) and of airlines without a train mean; any
        violation raises before a result is returned.
        """
        te = self.test.join(self.b1_means, "airline", "left")
        preds = {
            "B0: train mean": F.lit(self.b0_value),
            "B1: per-airline mean": F.col("b1_pred"),
            "M1: schedule only": self.m1.predict(),
            "M2: + airline/airport/distance": self.m2.predict(),
        }
        y, mins = F.col("log_delay"), F.col("arr_delay")
        aggs = []
        for i, p in enumerate(preds.values()):
            r = y - p
            rm = mins - F.exp(p)
            aggs += [F.sqrt(F.avg(r * r)).alias(f"rmse_log_{i}"), F.avg(F.abs(r)).alias(f"mae_log_{i}"),
                     F.sqrt(F.avg(rm * rm)).alias(f"rmse_minutes_{i}"), F.avg(F.abs(rm)).alias(f"mae_minutes_{i}")]
        checks = dict(self._rules())
        checks["airline_without_train_mean"] = F.col("b1_pred").isNull()
        for t in self.m2_design.terms:
            if isinstance(t, Factor):
                checks[f"unseen_{t.column}"] = ~F.coalesce(F.col(t.column).isin(list(t.levels)), F.lit(False))
        aggs += [F.count_if(c).alias(f"chk_{k}") for k, c in checks.items()]
        row = te.agg(*aggs).collect()[0]
        bad = {k: row[f"chk_{k}"] for k in checks if row[f"chk_{k}"]}
        if bad:
            raise DataQualityError(f"magnitude test: failed checks {bad}")
        out = [(name, row[f"rmse_log_{i}"], row[f"mae_log_{i}"], row[f"rmse_minutes_{i}"], row[f"mae_minutes_{i}"])
               for i, name in enumerate(preds)]
        return self.spark.createDataFrame(
            out, "model string, rmse_log double, mae_log double, rmse_minutes double, mae_minutes double")

    def baseline_metrics(self) -> DataFrame:
        """B0 and B1 only (exact, no fit involved)."""
        return self.comparison().filter(F.col("model").startswith("B"))

    def other_shares(self) -> DataFrame:
        """Share of late train / test rows folded into OTHER (percent), per airport column."""
        parts = []
        for split, df in (("train", self.train), ("test", self.test)):
            parts.append(df.agg(*[(F.avg((F.col(c) == C.OTHER_LEVEL).cast("double")) * F.lit(100.0)).alias(c)
                                  for c in ("origin_top", "dest_top")]).select(F.lit(split).alias("split"), "*"))
        wide = parts[0].unionByName(parts[1])
        return wide.select("split", F.expr("stack(2, 'origin_top', origin_top, 'dest_top', dest_top)")
                           .alias("feature", "other_pct"))

    # -- tables ----------------------------------------------------------------------
    def coefficients(self, which: str = "m2") -> DataFrame:
        fit = getattr(self, which)
        return fit.table(self.spark).withColumnRenamed("se", "robust_se")

    def top_coefficients(self, k: int = C.TOP_COEFFICIENTS) -> DataFrame:
        """Largest |coef| of M2, intercept included."""
        return self.coefficients("m2").orderBy(F.abs("coef").desc(), F.col("term")).limit(k)

    def model_stats(self) -> DataFrame:
        rows = []
        for name in ("m1", "m2"):
            f = getattr(self, name)
            rows.append((name.upper(), float(f.nobs), f.design.width, float(f.df_resid), float(f.rsquared)))
        return self.spark.createDataFrame(rows, "model string, nobs double, n_params int, df_resid double, rsquared double")

    def breusch_pagan(self) -> DataFrame:
        bp = self.m2.bp
        return self.spark.createDataFrame(
            [(bp["lm"], bp["lm_pvalue"], bp["fvalue"], bp["f_pvalue"], int(bp["df_model"]))],
            "lm double, lm_pvalue double, fvalue double, f_pvalue double, df_model int")

    def design_term(self, column: str, level) -> str:
        """Name of the M2 design column made from ``column`` (and, for a factor, ``level``)."""
        design = self.m2_design
        by_source = dict(zip(zip(design.term_column(), design.term_level()), design.names))
        if (column, level) not in by_source:
            raise DataQualityError(f"M2 has no column for {column} = {level!r}")
        return by_source[column, level]

    def headline(self) -> DataFrame:
        terms = [self.design_term(f, lv) for f, lv in self.params.headline_terms]
        order = F.array_position(F.array(*[F.lit(t) for t in terms]), F.col("term"))
        t = self.coefficients("m2").filter(F.col("term").isin(terms))
        return (t.select("term", "coef", "robust_se", "ci_low", "ci_high", "p_value",
                         ((F.exp("coef") - F.lit(1.0)) * F.lit(100.0)).alias("approx_pct_change"))
                .orderBy(order))

    def vif_table(self) -> DataFrame:
        rows = O.vif(None, self.vif_design, cell_df=self.cells)
        df = self.spark.createDataFrame(rows, "term string, vif double")
        return df.withColumn("high", (F.col("vif") > 10.0) & (F.col("term") != "Intercept"))

    # -- diagnostics ------------------------------------------------------------------
    @cached_property
    def diag_sample(self) -> DataFrame:
        """Seeded exact-size sample of the late train rows, then both residuals of each.

        Ranked by source columns only, so a coefficient's last bit changes no
        choice, and only the sample is scored. Written once: three reports read it.
        """
        rows = exact_sample(self._train_late_raw.drop("log_delay"), self.params.diag_sample_size, self.params.diag_seed)
        fitted = self.m2.predict()
        return reliable_checkpoint(self.features(late_only(rows)).select(
            fitted.alias("fitted"), (F.col("log_delay") - fitted).alias("resid"),
            (F.col("arr_delay") - self.m2_raw.predict()).alias("resid_raw")))

    def residuals_vs_fitted(self) -> DataFrame:
        return self.diag_sample.select("fitted", "resid")

    def qq(self) -> tuple[DataFrame, DataFrame]:
        """Normal QQ points (Filliben medians) for log and raw residuals, and the fitted lines.

        The points of one residual set are ranked by a window over the
        diagnostic sample only (its size is the parameter, not the data).
        """
        parts = []
        for which, col in (("log", "resid"), ("raw", "resid_raw")):
            s = self.diag_sample.select(F.lit(which).alias("model"), F.col(col).alias("sample"))
            parts.append(s)
        pts = parts[0].unionByName(parts[1])
        w = Window.partitionBy("model").orderBy("sample")
        pts = (pts.withColumn("i", F.row_number().over(w))
                  .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("model"))))
        i, n = F.col("i").cast("double"), F.col("n").cast("double")
        last = F.pow(F.lit(0.5), F.lit(1.0) / n)
        m = (F.when(F.col("i") == F.col("n"), last)
              .when(F.col("i") == 1, F.lit(1.0) - last)
              .otherwise((i - F.lit(0.3175)) / (n + F.lit(0.365))))
        pts = pts.withColumn("u", m).withColumn("theoretical", F.expr(dist.norm_ppf_sql("u")))
        pts = pts.select("model", "i", "theoretical", "sample")
        lines = pts.groupBy("model").agg(
            F.regr_slope("sample", "theoretical").alias("slope"),
            F.regr_intercept("sample", "theoretical").alias("intercept"),
            F.corr("sample", "theoretical").alias("r"))
        return pts, lines

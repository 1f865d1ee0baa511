"""Logistic models on Spark ML, fitted on rows.

* ``fit_penalized`` -- L2 logistic regression, 1/2 ||b||^2 + C * sum(log-loss)
  with a free intercept. First solver: IRLS (``GeneralizedLinearRegression``),
  which comes to the optimum in a few passes. If it does not settle, the second
  solver: L-BFGS (``LogisticRegression``); the fit says which one it is from and
  why.
* ``fit_inference`` -- unpenalised binomial GLM (IRLS) with standard errors,
  p-values, confidence intervals and McFadden's pseudo R^2.

No row is shuffled by a step: each is a scan with sums per task. With a numeric
column nearly every design row is its own, so rows are fitted as they are; a
design of factors and flags alone has as many distinct rows as the product of
its levels, and is fitted on these cells, weighted by their rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions import columns as X
from ..functions import dist
from ..session import reliable_checkpoint
from .design import Design, Factor, Flag, Numeric


def _place(t: Factor) -> Column:
    """Place of a row's level in the factor's list, from 1; 0 outside the list, NULL without a level."""
    return F.array_position(F.array(*[F.lit(lv) for lv in t.levels]), F.col(t.column))


def labelled_rows(df: DataFrame, design: Design, label: Column, keep: tuple[str, ...] = (),
                  only: list[int] | None = None) -> DataFrame:
    """(features vector, label, *keep) per row; ``only``: these design columns (the intercept not counted).

    A factor is looked up in its level list once per row; its columns compare the place found, not the level.
    """
    at, ind = {}, []
    for t in design.terms:
        if isinstance(t, Factor):
            place = f"_at{len(at)}"
            at[place] = _place(t)
            ind.extend(F.when(F.col(place) == k, F.lit(1.0)).otherwise(F.lit(0.0)) for k in range(2, len(t.levels) + 1))
        else:
            ind.extend(Design((t,), False).indicator_columns())
    ind = ind if only is None else [ind[i] for i in only]
    names = [f"x{i}" for i in range(len(ind))]
    placed = df.select("*", *[c.alias(n) for n, c in at.items()])
    rows = placed.select(label.cast("double").alias("label"), *keep, *[c.alias(n) for c, n in zip(ind, names)])
    return VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("features", "label", *keep)


@dataclass
class LogisticFit:
    design: Design
    intercept: float
    coef: np.ndarray
    n_iter: int
    converged: bool
    solver: str
    nobs: float
    se: np.ndarray | None = None          # intercept first, then coef (inference fits)
    deviance: float | None = None
    null_deviance: float | None = None
    reason: str | None = None             # why the second solver was used

    @property
    def params(self) -> np.ndarray:
        return np.concatenate([[self.intercept], self.coef])

    def logit(self) -> Column:
        return self.design.linear_predictor(self.coef, intercept=self.intercept)

    def offset(self) -> Column:
        """Feature contribution only (intercept removed)."""
        return self.design.linear_predictor(self.coef, intercept=0.0)

    def prob(self) -> Column:
        return X.sigmoid(self.logit())

    @property
    def pseudo_r2(self) -> float | None:
        if self.deviance is None or not self.null_deviance:
            return None
        return 1.0 - self.deviance / self.null_deviance

    def coef_rows(self) -> list[tuple]:
        out = []
        se = self.se if self.se is not None else np.full(len(self.params), np.nan)
        for name, fam, b, s in zip(self.design.names, self.design.term_family(), self.params, se):
            if s == s and s > 0:       # NaN-safe
                z = b / s
                p = dist.norm_two_sided_p(z)
                lo, hi = b - C.Z_975 * s, b + C.Z_975 * s
            else:
                z = p = lo = hi = float("nan")
            out.append((name, fam, float(b), float(s), float(z), float(p), float(lo), float(hi)))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        schema = T.StructType([
            T.StructField("term", T.StringType()), T.StructField("family", T.StringType()),
            T.StructField("coef", T.DoubleType()), T.StructField("se", T.DoubleType()),
            T.StructField("z", T.DoubleType()), T.StructField("p_value", T.DoubleType()),
            T.StructField("ci_low", T.DoubleType()), T.StructField("ci_high", T.DoubleType()),
        ])
        return spark.createDataFrame(self.coef_rows(), schema)


IRLS_COLUMNS = 4096          # Spark ML's limit for its normal equations


def _irls(rows: DataFrame, n: int, C_reg: float, max_iter: int, tol: float, rounds: int) -> tuple[np.ndarray, int, str | None]:
    """(intercept and coefficients, passes, why it did not settle).

    Spark's IRLS penalises the mean over working weights, whose sum
    S = sum p (1 - p) belongs to the solution: the penalty sought needs
    regParam = 1 / (C S). A few fits with S from the one before reach it, each
    with about twice the correct digits.
    """
    rate = rows.agg(F.avg("label")).first()[0]
    if rate is None:
        raise ValueError("no rows to fit")
    total, passes = n * rate * (1.0 - rate), 0
    if not total:
        return np.zeros(0), passes, "labels of one class"
    for _ in range(rounds):
        m = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="features", labelCol="label",
                                        regParam=1.0 / (C_reg * total), maxIter=max_iter, tol=tol).fit(rows)
        steps = int(m.summary.numIterations)
        passes += steps
        if steps >= max_iter:
            return np.zeros(0), passes, f"irls had not settled after {steps} steps"
        p = F.col("prediction")
        new = m.transform(rows).agg(F.sum(p * (1.0 - p))).first()[0]
        if abs(new - total) <= 1e-9 * total:
            return np.concatenate([[m.intercept], m.coefficients.toArray()]), passes, None
        total = new
    return np.zeros(0), passes, f"irls penalty had not settled after {rounds} rounds"


def varying_columns(df: DataFrame, design: Design) -> tuple[int, list[int]]:
    """(rows, the design columns, the intercept not counted, with more than one value).

    One aggregation: per factor the places seen, a bit each, per flag the rows
    that have it, per number its range.
    """
    aggs, places = [F.count(F.lit(1)).alias("n")], {}
    for i, t in enumerate(design.terms):
        c = F.col(t.column)
        if isinstance(t, Factor):
            places[f"_at{i}"] = F.coalesce(_place(t), F.lit(0)).cast("int")
            at = F.col(f"_at{i}")
            aggs += [F.bit_or(F.when(F.floor(at / 62) == k, F.call_function("shiftleft", F.lit(1).cast("bigint"), at % 62)))
                     .alias(f"seen{i}_{k}") for k in range(len(t.levels) // 62 + 1)]
        elif isinstance(t, Flag):
            aggs.append(F.count_if(c).alias(f"set{i}"))
        else:
            aggs.append((F.min(c.cast("double")) != F.max(c.cast("double"))).alias(f"differs{i}"))
    row = df.select(*design.source_columns, *[c.alias(n) for n, c in places.items()]).agg(*aggs).first()
    vary = []
    for i, t in enumerate(design.terms):
        if isinstance(t, Factor):
            seen = {k * 62 + j for k in range(len(t.levels) // 62 + 1) for j in range(62) if (row[f"seen{i}_{k}"] or 0) >> j & 1}
            vary += [len(seen) > 1 and at in seen for at in range(2, len(t.levels) + 1)]
        elif isinstance(t, Flag):
            vary.append(0 < row[f"set{i}"] < row["n"])
        else:
            vary.append(bool(row[f"differs{i}"]))
    return row["n"], [i for i, v in enumerate(vary) if v]


def fit_penalized(df: DataFrame, design: Design, label: Column, C_reg: float = 1.0,
                  max_iter: int = C.LOGIT_MAX_ITER, tol: float = 1e-12, rounds: int = 10,
                  lbfgs_max_iter: int = C.LOGREG_MAX_ITER, lbfgs_tol: float = 1e-12) -> LogisticFit:
    """L2 logistic regression, C * sum(log-loss) + 1/2 ||b||^2, free intercept.

    ``converged`` is that of the solver whose estimate it is; ``reason`` says
    why the second solver was needed, if it was. A column with one value on all
    rows (a level without rows) can only add a penalty, so its estimate is 0 and
    the solvers do not see it.
    """
    n, vary = varying_columns(df, design)
    rows = reliable_checkpoint(labelled_rows(df, design, label.cast("double"), only=vary))

    def spread(found) -> np.ndarray:
        coef = np.zeros(design.width - design.intercept)
        coef[vary] = found
        return coef

    if len(vary) > IRLS_COLUMNS:
        beta, passes, reason = np.zeros(0), 0, f"more than {IRLS_COLUMNS} design columns"
    else:
        beta, passes, reason = _irls(rows, n, C_reg, max_iter, tol, rounds)
    if reason is None:
        return LogisticFit(design, float(beta[0]), spread(beta[1:]), passes, True, "irls", float(n))
    # mean log-loss + (regParam / 2) ||b||^2: the same objective divided by C n
    m = LogisticRegression(featuresCol="features", labelCol="label", regParam=1.0 / (C_reg * n), elasticNetParam=0.0,
                           standardization=False, fitIntercept=True, maxIter=lbfgs_max_iter, tol=lbfgs_tol).fit(rows)
    steps = int(m.summary.totalIterations)
    return LogisticFit(design, float(m.intercept), spread(m.coefficients.toArray()), steps, steps < lbfgs_max_iter, "lbfgs", float(n),
                       reason=reason)


def supported_design(df: DataFrame, design: Design) -> Design:
    """The design without columns that are zero on every row (levels or flags
    never seen in the fit frame); their estimates are undefined, and an
    unpenalised fit would otherwise face a singular information matrix.
    One aggregation, one number per design column."""
    cols = design.indicator_columns()
    seen = df.agg(*[F.max(c != 0.0).alias(f"s{i}") for i, c in enumerate(cols)]).collect()[0] if cols else []
    terms, k = [], 0
    for t in design.terms:
        mine = seen[k:k + len(t.names())]
        k += len(mine)
        if isinstance(t, Numeric):
            terms.append(t)
        elif isinstance(t, Factor):
            terms.append(Factor(t.column, t.levels[:1] + tuple(lv for lv, s in zip(t.levels[1:], mine) if s), t.label))
        elif mine[0]:
            terms.append(t)
    return Design(tuple(terms), design.intercept)


def fit_inference(df: DataFrame, design: Design, label: Column,
                  max_iter: int = C.LOGIT_MAX_ITER, tol: float = 1e-10) -> LogisticFit:
    df = df.select(*design.source_columns, label.cast("double").alias("_label"))
    glr = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="features",
                                      labelCol="label", maxIter=max_iter, tol=tol, regParam=0.0, fitIntercept=True)
    if any(isinstance(t, Numeric) for t in design.terms):
        used, nobs = supported_design(df, design), None
        # IRLS reads its input anew each step: the vectors are written once (no shuffle)
        m = glr.fit(reliable_checkpoint(labelled_rows(df, used, F.col("_label"))))
    else:
        # one row per cell and label, at most the product of the levels: partial counts are all that is shuffled
        cells = reliable_checkpoint(df.groupBy(*dict.fromkeys(design.source_columns), "_label")
                                    .agg(F.count(F.lit(1)).cast("double").alias("_rows")))
        used, nobs = supported_design(cells, design), cells.agg(F.sum("_rows")).first()[0]
        m = glr.setWeightCol("_rows").fit(labelled_rows(cells.coalesce(1), used, F.col("_label"), ("_rows",)))
    s = m.summary
    se_all = np.array(s.coefficientStandardErrors)   # coefficients first, intercept last
    fitted = dict(zip(used.names, np.concatenate([[m.intercept], m.coefficients.toArray()])))
    fitted_se = dict(zip(used.names, np.concatenate([[se_all[-1]], se_all[:-1]])))
    # terms dropped for lack of data come back as NaN, in the full design's order
    coef = np.array([fitted.get(nm, np.nan) for nm in design.names])
    se = np.array([fitted_se.get(nm, np.nan) for nm in design.names])
    iters = int(s.numIterations)
    return LogisticFit(design, float(coef[0]), coef[1:], iters, iters < max_iter, "irls", float(nobs or s.numInstances),
                       se=se,
                       deviance=float(s.deviance), null_deviance=float(s.nullDeviance))


def odds_ratio_table(fit: LogisticFit, spark: SparkSession, top: int = C.TOP_COEFFICIENTS) -> DataFrame:
    """Top terms by |coef| (intercept excluded): coef, odds ratio and its CI, p."""
    # terms without data (NaN estimate) have no odds ratio to rank
    t = fit.table(spark).filter((F.col("term") != "Intercept") & ~F.isnan("coef"))
    return (t.orderBy(F.abs("coef").desc(), F.col("term")).limit(top)
            .select("term", "family", "coef", F.exp("coef").alias("odds_ratio"),
                    F.exp("ci_low").alias("or_ci_low"), F.exp("ci_high").alias("or_ci_high"),
                    "p_value"))


def family_picks(odds: DataFrame, k: int = 3) -> DataFrame:
    """First term of each family in |coef| order, k families; falls back to the first k terms."""
    # the windows see the (at most 15) odds-table rows only
    ranked = odds.withColumn("_r", F.row_number().over(Window.orderBy(F.abs("coef").desc(), F.col("term"))))
    first = ranked.withColumn("_f", F.row_number().over(Window.partitionBy("family").orderBy("_r")))
    picks = first.filter(F.col("_f") == 1).orderBy("_r").limit(k)
    if picks.count() < k:
        picks = ranked.orderBy("_r").limit(k)
    return picks.drop("_r", "_f")

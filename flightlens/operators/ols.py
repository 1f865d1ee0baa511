"""Least squares with heteroscedasticity-robust (HC1) errors on Spark.

One scan groups the rows into cells of equal factor values with power sums of
the numeric column and of y (``design.moments``). Pass 1 over the cells gives
X'X and X'y, hence b; pass 2 uses b to expand each cell's sums of squared
(and fourth-power) residuals, weighted by powers of the numeric column, from
its power sums: the HC1 "meat" X' diag(e^2) X, the residual sum of squares
and the Breusch-Pagan regression of e^2 on X -- all without touching the rows
again. The cells are checkpointed to the shared folder between passes.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import factorial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from .. import constants as C
from ..functions import dist
from ..session import reliable_checkpoint
from .design import Design, Numeric, moment_products, moments, power_name


@dataclass
class OLSFit:
    design: Design
    coef: np.ndarray
    cov: np.ndarray
    cov_type: str
    nobs: float
    rank: int
    ssr: float
    centered_tss: float
    bp: dict = field(default_factory=dict)

    @property
    def df_resid(self) -> float:
        return self.nobs - self.rank

    @property
    def rsquared(self) -> float:
        return 1.0 - self.ssr / self.centered_tss if self.centered_tss > 0 else float("nan")

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.cov), 0.0, None))

    def predict(self) -> Column:
        return self.design.linear_predictor(self.coef)

    def rows(self) -> list[tuple]:
        out = []
        for name, fam, b, s in zip(self.design.names, self.design.term_family(), self.coef, self.se):
            z = b / s if s > 0 else float("nan")
            p = dist.norm_two_sided_p(z) if s > 0 else float("nan")
            out.append((name, fam, float(b), float(s), float(z), float(p),
                        float(b - C.Z_975 * s), float(b + C.Z_975 * s)))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        schema = T.StructType([
            T.StructField("term", T.StringType()), T.StructField("family", T.StringType()),
            T.StructField("coef", T.DoubleType()), T.StructField("se", T.DoubleType()),
            T.StructField("z", T.DoubleType()), T.StructField("p_value", T.DoubleType()),
            T.StructField("ci_low", T.DoubleType()), T.StructField("ci_high", T.DoubleType()),
        ])
        return spark.createDataFrame(self.rows(), schema)


def fit_ols(df: DataFrame | None, design: Design, y: Column | None, cov_type: str = "HC1",
            breusch_pagan: bool = False, cell_df: DataFrame | None = None, prefix: str = "s") -> OLSFit:
    """OLS of y on the design over all rows of ``df``.

    cov_type: "HC1" (robust, n/(n-k) * B M B) or "nonrobust" (s^2 (X'X)^-1).
    Rank-deficient designs use the pseudo-inverse, as a formula front end
    would. ``cell_df``: cells already aggregated (``design.moments``, of this
    design or one with more terms) with the power sums of y under ``prefix``
    (degree 4 for Breusch-Pagan); several fits can share one scan this way.
    """
    degree = 4 if breusch_pagan else 2
    if cell_df is None:
        cell_df = reliable_checkpoint(moments(df, design, {prefix: (y, degree)}))
    at_x = [i for i, (t, c) in enumerate(zip(design.names, design.term_column()))
            if any(isinstance(n, Numeric) and n.column == c for n in design.terms)]
    powers = range(3 if at_x else 1)

    def sums(pdf):
        return lambda a, b: pdf[power_name(prefix, a, b)].to_numpy()

    def prep1(pdf, X):
        m = sums(pdf)
        return ([m(a, 0) for a in powers], [[m(a, 1) for a in powers[:2]]],
                [m(0, 0).sum(), m(0, 1).sum(), m(0, 2).sum()])

    G, B, S = moment_products(cell_df, design, prep1, 1, 3)
    Ginv = np.linalg.pinv(G)
    beta = Ginv @ B[:, 0]
    nobs, sy, syy = S
    rank = int(np.linalg.matrix_rank(G))
    centered_tss = syy - sy * sy / nobs

    slope = float(beta[at_x[0]]) if at_x else 0.0
    fixed = np.delete(beta, at_x)

    def prep2(pdf, X):
        m, f = sums(pdf), X @ fixed          # residual = y - f - slope * x

        def squares(a):                      # sum of e^2 x^a
            out = m(a, 2) + f * f * m(a, 0) - 2.0 * f * m(a, 1)
            if at_x:
                out = out + slope * (slope * m(a + 2, 0) - 2.0 * m(a + 1, 1) + 2.0 * f * m(a + 1, 0))
            return out

        e2, e4 = [squares(a) for a in powers], 0.0
        if degree == 4:                      # multinomial expansion of (y - slope x - f)^4
            for a in range(5 if at_x else 1):
                for b in range(5 - a):
                    k = 4 - a - b
                    ways = 24 // (factorial(a) * factorial(b) * factorial(k))
                    e4 = e4 + (ways * (-slope) ** a * (-f) ** k * m(a, b)).sum()
        return e2, [e2[:2]], [e2[0].sum(), e4]

    M, Be2, S2 = moment_products(cell_df, design, prep2, 1, 2)
    ssr, sum_e4 = float(S2[0]), float(S2[1])
    if cov_type == "HC1":
        cov = (Ginv @ M @ Ginv) * (nobs / (nobs - rank))
    else:
        cov = Ginv * (ssr / (nobs - rank))
    fit = OLSFit(design, beta, cov, cov_type, float(nobs), rank, float(ssr), float(centered_tss))
    if breusch_pagan:
        gamma = Ginv @ Be2[:, 0]
        ssr_aux = sum_e4 - gamma @ Be2[:, 0]
        tss_aux = sum_e4 - ssr * ssr / nobs
        r2 = 1.0 - ssr_aux / tss_aux
        df_model = rank - 1
        df_res = nobs - rank
        lm = nobs * r2
        fval = (r2 / df_model) / ((1.0 - r2) / df_res)
        fit.bp = {"lm": float(lm), "lm_pvalue": float(dist.chi2_sf(lm, df_model)), "fvalue": float(fval),
                  "f_pvalue": float(dist.f_sf(fval, df_model, df_res)), "df_model": int(df_model)}
    return fit


def vif(df: DataFrame | None, design: Design, cell_df: DataFrame | None = None) -> list[tuple[str, float]]:
    """Variance inflation factor of every design column from one X'X pass.

    Column i regressed on the others: SSR_i = 1 / (X'X)^-1_ii. Centred total
    sum of squares when the others hold the intercept; for the intercept
    itself the others have no constant, so the uncentred one (n).
    ``cell_df``: cells of this design or of one with more terms.
    """
    if cell_df is None:
        cell_df = moments(df, design)
    numeric = any(isinstance(t, Numeric) for t in design.terms)

    def prep(pdf, X):
        W = [pdf[power_name("", a, 0)].to_numpy() for a in range(3 if numeric else 1)]
        return W, [], [W[0].sum()]

    G, _, S = moment_products(cell_df, design, prep, 0, 1)
    nobs = float(S[0])
    Ginv = np.linalg.pinv(G)
    out = []
    for i, name in enumerate(design.names):
        if design.intercept and i == 0:
            tss = nobs
        elif design.intercept:
            tss = G[i, i] - G[0, i] ** 2 / nobs
        else:
            tss = G[i, i]
        out.append((name, float(tss * Ginv[i, i])))
    return out

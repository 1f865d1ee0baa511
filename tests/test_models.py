"""OLS/HC1/Breusch-Pagan/VIF and the logistic fits against numpy on the rows."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from flightlens.functions import dist
from flightlens.operators import evaluate as E
from flightlens.operators import logistic as L
from flightlens.operators import ols as O
from flightlens.operators.design import Design, Factor, Flag, Numeric


def _frame(spark, n=3000, seed=3):
    rng = np.random.default_rng(seed)
    a = rng.choice(["p", "q", "r", "s"], n, p=[0.5, 0.2, 0.2, 0.1])
    b = rng.random(n) < 0.3
    x = np.round(rng.normal(size=n), 1)
    y = 1.0 + (a == "q") * 0.5 - (a == "s") * 0.3 + 0.8 * b + 0.4 * x + rng.normal(size=n) * (1 + np.abs(x))
    pdf = pd.DataFrame({"a": a, "b": b, "x": x, "y": y})
    return spark.createDataFrame(pdf), pdf


DESIGN = Design((Factor("a", ("p", "q", "r", "s")), Flag("b"), Numeric("x")))


def _numpy_ols(pdf):
    X = DESIGN.matrix(pdf)
    y = pdf["y"].to_numpy()
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    e = y - X @ beta
    n, k = X.shape
    bread = np.linalg.inv(X.T @ X)
    cov = bread @ (X.T * e * e) @ X @ bread * n / (n - k)
    return X, y, beta, e, cov


def test_ols_hc1_matches_numpy(spark):
    df, pdf = _frame(spark)
    fit = O.fit_ols(df, DESIGN, F.col("y"), breusch_pagan=True)
    X, y, beta, e, cov = _numpy_ols(pdf)
    assert np.allclose(fit.coef, beta, atol=1e-9)
    assert np.allclose(fit.se, np.sqrt(np.diag(cov)), rtol=1e-7)
    r2 = 1 - (e @ e) / ((y - y.mean()) @ (y - y.mean()))
    assert math.isclose(fit.rsquared, r2, rel_tol=1e-9)
    # Breusch-Pagan (studentised): n * R^2 of e^2 on X
    e2 = e * e
    g, *_ = np.linalg.lstsq(X, e2, rcond=None)
    u = e2 - X @ g
    r2a = 1 - (u @ u) / ((e2 - e2.mean()) @ (e2 - e2.mean()))
    assert math.isclose(fit.bp["lm"], len(y) * r2a, rel_tol=1e-6)
    assert 0.0 <= fit.bp["lm_pvalue"] <= 1.0


def test_vif_matches_auxiliary_regressions(spark):
    df, pdf = _frame(spark)
    got = dict(O.vif(df, DESIGN))
    X = DESIGN.matrix(pdf)
    for i, name in enumerate(DESIGN.names):
        xi, rest = X[:, i], np.delete(X, i, axis=1)
        c, *_ = np.linalg.lstsq(rest, xi, rcond=None)
        ssr = ((xi - rest @ c) ** 2).sum()
        tss = (xi ** 2).sum() if i == 0 else ((xi - xi.mean()) ** 2).sum()
        assert math.isclose(got[name], tss / ssr, rel_tol=1e-6), name


def test_prediction_expression_matches_matrix(spark):
    df, pdf = _frame(spark, n=200)
    coef = np.arange(DESIGN.width, dtype=float) / 10
    got = np.array([r[0] for r in df.select(DESIGN.linear_predictor(coef)).collect()])
    assert np.allclose(got, DESIGN.matrix(pdf) @ coef)


def _logit_frame(spark, n=4000, seed=5):
    rng = np.random.default_rng(seed)
    a = rng.choice(["p", "q", "r", "s"], n)
    b = rng.random(n) < 0.4
    x = np.round(rng.normal(size=n), 1)
    z = -0.5 + (a == "q") * 0.7 + 0.5 * b - 0.6 * x
    yy = rng.random(n) < 1 / (1 + np.exp(-z))
    pdf = pd.DataFrame({"a": a, "b": b, "x": x, "y": yy})
    return spark.createDataFrame(pdf), pdf


def _newton(X, y, lam, penalize_from=1, iters=50):
    w = np.zeros(X.shape[1])
    pen = np.ones(X.shape[1]) * lam
    pen[:penalize_from] = 0.0
    for _ in range(iters):
        p = 1 / (1 + np.exp(-X @ w))
        g = X.T @ (y - p) - pen * w
        H = (X.T * (p * (1 - p))) @ X + np.diag(pen)
        w = w + np.linalg.solve(H, g)
    return w, H


def test_penalized_logistic_matches_c1_objective(spark):
    df, pdf = _logit_frame(spark)
    fit = L.fit_penalized(df, DESIGN, F.col("y"))
    X = DESIGN.matrix(pdf)
    w, _ = _newton(X, pdf["y"].to_numpy(float), lam=1.0)
    assert np.allclose(fit.params, w, atol=1e-9)
    assert fit.converged and (fit.solver, fit.reason) == ("irls", None)


def test_second_solver_when_the_first_does_not_settle(spark):
    df, pdf = _logit_frame(spark)
    w, _ = _newton(DESIGN.matrix(pdf), pdf["y"].to_numpy(float), lam=1.0)
    fit = L.fit_penalized(df, DESIGN, F.col("y"), max_iter=1)
    assert (fit.solver, fit.converged) == ("lbfgs", True) and fit.reason == "irls had not settled after 1 steps"
    assert np.allclose(fit.params, w, atol=1e-5)
    fit = L.fit_penalized(df, DESIGN, F.col("y"), rounds=1)
    assert fit.solver == "lbfgs" and "penalty" in fit.reason
    fit = L.fit_penalized(df, DESIGN, F.col("y"), C_reg=0.01)
    strong, _ = _newton(DESIGN.matrix(pdf), pdf["y"].to_numpy(float), lam=100.0)
    assert fit.solver == "irls" and np.allclose(fit.params, strong, atol=1e-9)


def test_columns_of_one_value_are_zero_under_the_penalty(spark):
    df, pdf = _logit_frame(spark)
    wide = Design((Factor("a", ("p", "never", "q", "r", "s")), Flag("b"), Flag("always"), Numeric("x")))
    fit = L.fit_penalized(df.withColumn("always", F.lit(True)), wide, F.col("y"))
    w, _ = _newton(DESIGN.matrix(pdf), pdf["y"].to_numpy(float), lam=1.0)
    got = dict(zip(wide.names, fit.params))
    assert got.pop("C(a)[T.never]") == got.pop("always[T.True]") == 0.0
    assert np.allclose(list(got.values()), w, atol=1e-9)


def test_neither_solver_settled(spark):
    df, _ = _logit_frame(spark)
    fit = L.fit_penalized(df, DESIGN, F.col("y"), max_iter=1, lbfgs_max_iter=1)
    assert not fit.converged and fit.solver == "lbfgs" and fit.reason


def test_factor_designs_are_fitted_on_cells(spark):
    """The same estimates from weighted cells as from rows, whatever the number of rows; empty levels too."""
    df, pdf = _logit_frame(spark)
    factors = Design((Factor("a", ("p", "q", "r", "s", "never")), Flag("b")))
    fit = L.fit_inference(df, factors, F.col("y"))
    seen = Design((Factor("a", ("p", "q", "r", "s")), Flag("b")))
    X, y = seen.matrix(pdf), pdf["y"].to_numpy(float)
    w, H = _newton(X, y, lam=0.0)
    keep = [i for i, nm in enumerate(factors.names) if nm != "C(a)[T.never]"]
    assert np.allclose(fit.params[keep], w, atol=1e-8) and fit.nobs == len(pdf)
    assert np.allclose(fit.se[keep], np.sqrt(np.diag(np.linalg.inv(H))), rtol=1e-6)
    eta = X @ w
    assert math.isclose(fit.deviance, -2 * float(np.sum(y * eta - np.log1p(np.exp(eta)))), rel_tol=1e-9)
    r = y.mean()
    assert math.isclose(fit.null_deviance, -2 * len(y) * (r * math.log(r) + (1 - r) * math.log(1 - r)), rel_tol=1e-9)


def test_unpenalized_logit_and_standard_errors(spark):
    df, pdf = _logit_frame(spark)
    fit = L.fit_inference(df, DESIGN, F.col("y"))
    X = DESIGN.matrix(pdf)
    w, H = _newton(X, pdf["y"].to_numpy(float), lam=0.0)
    assert np.allclose(fit.params, w, atol=1e-6)
    assert np.allclose(fit.se, np.sqrt(np.diag(np.linalg.inv(H))), rtol=1e-5)
    assert fit.pseudo_r2 is not None and 0 < fit.pseudo_r2 < 1


def test_intercept_refit_with_offset(spark):
    rng = np.random.default_rng(9)
    off = np.round(rng.normal(size=2000), 2)
    y = rng.random(2000) < 1 / (1 + np.exp(-(off - 0.7)))
    df = spark.createDataFrame(pd.DataFrame({"o": off, "y": y}))
    b, _ = E.refit_intercept(df, F.col("o"), *E.label_counts(F.col("y")))
    w = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(off + w)))
        w += (y - p).sum() / (p * (1 - p)).sum()
    assert math.isclose(b, w, abs_tol=1e-10)


def test_distribution_tails():
    assert math.isclose(dist.norm_two_sided_p(1.959963984540054), 0.05, rel_tol=1e-12)
    # chi-square with even df has a closed form
    x, k = 7.3, 6
    closed = math.exp(-x / 2) * (1 + x / 2 + (x / 2) ** 2 / 2)
    assert math.isclose(dist.chi2_sf(x, k), closed, rel_tol=1e-12)
    # F(d1=2, d2) tail closed form: (1 + 2f/d2)^(-d2/2)
    f, d2 = 1.7, 30
    assert math.isclose(dist.f_sf(f, 2, d2), (1 + 2 * f / d2) ** (-d2 / 2), rel_tol=1e-10)
    assert math.isclose(dist.norm_ppf(0.975), 1.959963984540054, rel_tol=1e-12)


def test_inference_fit_with_a_level_that_has_no_rows(spark):
    """A listed level never seen in the fit frame gets a NaN estimate; the rest is the fit without it."""
    df, pdf = _logit_frame(spark)
    with_empty = Design((Factor("a", ("p", "q", "r", "s", "never")), Flag("b"), Numeric("x")))
    a = L.fit_inference(df, with_empty, F.col("y"))
    b = L.fit_inference(df, DESIGN, F.col("y"))
    names = with_empty.names
    assert math.isnan(a.params[names.index("C(a)[T.never]")]) and math.isnan(a.se[names.index("C(a)[T.never]")])
    keep = [i for i, nm in enumerate(names) if nm != "C(a)[T.never]"]
    assert np.allclose(a.params[keep], b.params, atol=1e-9)
    odds = L.odds_ratio_table(a, spark).collect()
    assert all(r["term"] != "C(a)[T.never]" for r in odds)


def test_norm_ppf_sql_equals_the_library(spark):
    us = [1e-300, 1e-20, 1e-9, 0.01, 0.074, 0.075, 0.3, 0.5, 0.7, 0.925, 0.9999, 1 - 1e-9]
    df = spark.createDataFrame([(u,) for u in us], "u double").selectExpr("u", f"{dist.norm_ppf_sql('u')} AS z")
    for r in df.collect():
        assert math.isclose(r.z, dist.norm_ppf(r.u), rel_tol=1e-12, abs_tol=1e-14)


def test_f_tail_of_very_many_degrees_is_the_chi_square_limit():
    assert math.isclose(dist.f_sf(1.1, 127, 1e12), dist.chi2_sf(1.1 * 127, 127), rel_tol=1e-9)


def test_ols_cells_do_not_follow_the_numeric_column(spark):
    """Grouped by factors only: every row may have its own x, the cells stay as many as the levels."""
    from flightlens.operators.design import moments
    rng = np.random.default_rng(4)
    n = 2000
    pdf = pd.DataFrame({"a": rng.choice(["p", "q", "r", "s"], n), "b": rng.random(n) < 0.5, "x": rng.normal(size=n) + 5.0})
    pdf["y"] = 2.0 + 0.3 * pdf["x"] + rng.normal(size=n)
    df = spark.createDataFrame(pdf)
    assert moments(df, DESIGN, {"s": (F.col("y"), 4)}).count() == 8
    fit = O.fit_ols(df, DESIGN, F.col("y"), breusch_pagan=True)
    _, _, beta, e, cov = _numpy_ols(pdf)
    assert np.allclose(fit.coef, beta, atol=1e-9) and np.allclose(fit.se, np.sqrt(np.diag(cov)), rtol=1e-8)


def test_one_cells_pass_serves_smaller_designs(spark):
    from flightlens.operators.design import moments
    df, _ = _frame(spark)
    cells = moments(df, DESIGN, {"s": (F.col("y"), 2)})
    small = Design((Factor("a", ("p", "q", "r", "s")),))
    a, b = O.fit_ols(None, small, None, cell_df=cells), O.fit_ols(df, small, F.col("y"))
    assert np.allclose(a.coef, b.coef) and np.allclose(a.se, b.se) and math.isclose(a.rsquared, b.rsquared)


def test_findings_name_what_they_show_and_what_they_do_not(spark):
    cols = "scenario int, cost_ratio_fn_fp double, flagged_share double, savings_pct_of_flag_all double"
    got = {r.finding: r.scenario for r in E.sensitivity_findings(spark.createDataFrame(
        [(0, 4.0, 0.9, 1.0), (1, 2.0, 0.4, 5.0), (2, 1.0, 0.1, 8.0)], cols)).collect()}
    assert got == {"first_ratio_flagging_under_half": 1, "lowest_ratio_with_meaningful_saving": None}


def test_diagnostic_sample_is_the_studys_and_its_choice_equals_sql(spark, monkeypatch):
    import duckdb
    from fixture_paths import SF0001
    from flightlens import constants as C
    from flightlens.params import FIXTURE
    from flightlens.plans.magnitude import Magnitude
    from flightlens.plans.stages import Study
    from flightlens_oracle import models_sql
    assert FIXTURE.diag_sample_size == C.DIAG_SAMPLE_SIZE == 50_000
    small = FIXTURE.with_(diag_sample_size=300)
    m = Magnitude(Study(spark, small, sf_dir=SF0001))
    assert m._train_late_raw.count() > 300
    monkeypatch.setattr(models_sql, "P", small)
    con = duckdb.connect()
    for name in ("lineitem", "orders", "customer", "supplier", "part", "nation", "region"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF0001}/{name}.parquet')")
    want = con.execute(models_sql._diagnostics("SELECT fitted, resid FROM dg")).fetchall()
    got = m.residuals_vs_fitted().collect()
    assert len(got) == 300 and np.allclose(sorted(map(tuple, got)), sorted(want), atol=1e-6)


def test_inference_sql_draws_the_sample_of_the_study(spark, monkeypatch):
    """A sample smaller than train: the query's fit and its SQL take the same rows."""
    import duckdb
    from fixture_paths import SF0001
    from flightlens.params import FIXTURE
    from flightlens.plans.models_registry import _round
    from flightlens.plans.risk import Risk
    from flightlens.plans.stages import Study
    from flightlens.sources.fixture import FLIGHT_TABLES
    from flightlens_oracle import models_sql
    small = FIXTURE.with_(sample_size=2500)
    monkeypatch.setattr(models_sql, "P", small)
    con = duckdb.connect()
    for t in FLIGHT_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    study = Study(spark, small, sf_dir=SF0001)
    assert study.train_sample().count() == 2500 < study.train().count()
    fit = Risk(study).inference
    want = {r[0]: r[1:3] for r in con.execute(f"SELECT term, coef, se FROM ({models_sql._risk_inference()})").fetchall()}
    got = {r.term: (r.coef, r.se) for r in _round(fit.table(spark)).collect()}
    assert set(got) == set(want)
    for term, (b, se) in want.items():
        assert b is None or (math.isclose(got[term][0], b, abs_tol=2e-6) and math.isclose(got[term][1], se, abs_tol=2e-6)), term


def test_columns_that_vary_are_found_without_a_pass_per_level(spark):
    """Levels beyond one word of bits, rows outside the list, nulls, flags and numbers of one value."""
    many = tuple(range(200))
    df = spark.createDataFrame([(k, "a" if k % 2 else None, True, None if k else True, 1.0, float(k)) for k in range(0, 150)],
                               "k int, one string, always boolean, once boolean, same double, num double")
    design = Design((Factor("k", many), Factor("one", ("z", "a", "b")), Flag("always"), Flag("once"), Numeric("same"), Numeric("num")))
    n, vary = L.varying_columns(df, design)
    names = [design.names[1:][i] for i in vary]
    cols = design.indicator_columns()
    by_column = df.agg(*[(F.min(c) != F.max(c)).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    assert n == 150 and vary == [i for i in range(len(cols)) if by_column[i]]
    assert names == [*[f"C(k)[T.{k}]" for k in range(1, 150)], "C(one)[T.a]", "once[T.True]", "num"]
    vectors = L.labelled_rows(df, design, F.lit(1), keep=("k",)).select("k", "features").collect()
    wanted = {r["k"]: list(r)[1:] for r in df.select("k", *[c.alias(f"x{i}") for i, c in enumerate(cols)]).collect()}
    assert {r["k"]: r["features"].toArray().tolist() for r in vectors} == wanted

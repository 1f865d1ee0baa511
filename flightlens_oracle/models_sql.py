"""Oracle SQL for the model and evaluation queries.

* closed forms: one-factor OLS (group-mean differences, HC1 variance
  n/(n-k) * (SSE_k / n_k^2 + SSE_ref / n_ref^2)), simple regression
  (regr_* plus influence weights), one-factor Breusch-Pagan, one-factor logit;
* full refits in plain SQL (``flightlens_oracle.ols_sql``): the multi-factor OLS with HC1
  errors, Breusch-Pagan and VIF; the unpenalised and the penalised logit;
  the models' predictions, coefficient tables with p-values, and every risk
  metric recomputed from the SQL fit's own scores;
* evaluation operators on the per-hour rate scorer: brute-force SQL.

The inference logit is fitted on the seeded train sample, which its SQL draws by
the same rule (at the shipped scales it is all of train). The diagnostic and the 10,000-row sample are smaller than
their tables, and SQL repeats the choice.
"""

from __future__ import annotations

from flightlens import constants as C
from flightlens.functions.dist import norm_ppf_sql
from flightlens.params import FIXTURE

from .ctes import d, r6, split_ctes, with_

P = FIXTURE
Z = repr(C.Z_975)
# index (1-based) of the 0.5 threshold in the 0.05 .. 0.95 grid
E_K_DEFAULT = [k for k in range(C.THRESHOLD_PCT_RANGE[0], C.THRESHOLD_PCT_RANGE[1] + 1)].index(
    round(C.DEFAULT_THRESHOLD * 100)) + 1


def _dbl(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def _late() -> str:
    return ",\nlate AS (SELECT *, ln(arr_delay) AS y, ln(distance) AS x FROM train WHERE arr_delay > 0)"


def _ols_dow() -> str:
    levels = ", ".join(f"('{d_}', {i})" for i, d_ in enumerate(C.DOW_ORDER))
    return with_(split_ctes(P), _late() + f""",
lv(dow, ord) AS (VALUES {levels}),
g AS (SELECT dow, COUNT(*) AS n, AVG(y) AS m FROM late GROUP BY dow),
e AS (SELECT late.dow, SUM((y - g.m) * (y - g.m)) AS sse FROM late JOIN g USING (dow) GROUP BY late.dow),
gg AS (SELECT g.dow, g.n, g.m, e.sse, lv.ord FROM g JOIN e USING (dow) JOIN lv USING (dow)),
tot AS (SELECT SUM(n) AS nn, COUNT(*) AS k FROM gg),
ref AS (SELECT * FROM gg WHERE ord = 0),
rows_ AS (
  SELECT 'Intercept' AS term, ref.m AS coef,
         sqrt(CAST(tot.nn AS DOUBLE) / (tot.nn - tot.k) * ref.sse / (CAST(ref.n AS DOUBLE) * ref.n)) AS se
  FROM ref, tot
  UNION ALL
  SELECT 'C(dow)[T.' || gg.dow || ']', gg.m - ref.m,
         sqrt(CAST(tot.nn AS DOUBLE) / (tot.nn - tot.k) * (gg.sse / (CAST(gg.n AS DOUBLE) * gg.n) + ref.sse / (CAST(ref.n AS DOUBLE) * ref.n)))
  FROM gg, ref, tot WHERE gg.ord > 0)
SELECT term, {r6('coef')} AS coef, {r6('se')} AS robust_se, {r6('coef / se')} AS z,
  {r6(f'coef - {Z} * se')} AS ci_low, {r6(f'coef + {Z} * se')} AS ci_high
FROM rows_""")


def _ols_distance() -> str:
    return with_(split_ctes(P), _late() + f""",
s AS (SELECT COUNT(*) AS n, AVG(x) AS mx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a,
             regr_sxx(y, x) AS sxx, regr_r2(y, x) AS r2 FROM late),
w AS (SELECT (x - s.mx) / s.sxx AS wb, 1.0 / s.n - s.mx * (x - s.mx) / s.sxx AS wa,
             y - (s.a + s.b * x) AS e FROM late, s),
v AS (SELECT SUM(wb * wb * e * e) AS vb, SUM(wa * wa * e * e) AS va FROM w)
SELECT 'Intercept' AS term, {r6('s.a')} AS coef, {r6('sqrt(CAST(s.n AS DOUBLE) / (s.n - 2) * v.va)')} AS robust_se,
  {r6('s.r2')} AS rsquared FROM s, v
UNION ALL
SELECT 'log_distance', {r6('s.b')}, {r6('sqrt(CAST(s.n AS DOUBLE) / (s.n - 2) * v.vb)')}, {r6('s.r2')} FROM s, v""")


def _bp_dow() -> str:
    return with_(split_ctes(P), _late() + f""",
g AS (SELECT dow, AVG(y) AS m FROM late GROUP BY dow),
r AS (SELECT late.dow, (y - g.m) * (y - g.m) AS e2 FROM late JOIN g USING (dow)),
ge AS (SELECT dow, AVG(e2) AS me2 FROM r GROUP BY dow),
a AS (SELECT SUM((r.e2 - ge.me2) * (r.e2 - ge.me2)) AS ssr_aux FROM r JOIN ge USING (dow)),
t AS (SELECT COUNT(*) AS n, SUM((e2 - (SELECT AVG(e2) FROM r)) * (e2 - (SELECT AVG(e2) FROM r))) AS tss_aux,
             (SELECT COUNT(*) FROM g) AS k FROM r),
st AS (SELECT n, k, 1 - ssr_aux / tss_aux AS r2 FROM a, t)
SELECT {r6('n * r2')} AS lm,
  {r6('exp(-n * r2 / 2) * (1 + (n * r2 / 2) + (n * r2 / 2) * (n * r2 / 2) / 2)')} AS lm_pvalue,
  {r6('(r2 / (k - 1)) / ((1 - r2) / (n - k))')} AS fvalue,
  CAST(k - 1 AS INTEGER) AS df_model
FROM st""")


def _logit_dow() -> str:
    levels = ", ".join(f"('{d_}', {i})" for i, d_ in enumerate(C.DOW_ORDER))
    return with_(split_ctes(P), f""",
lv(dow, ord) AS (VALUES {levels}),
g AS (SELECT dow, COUNT(*) AS n, AVG(CASE WHEN is_delayed THEN 1.0 ELSE 0.0 END) AS p FROM train GROUP BY dow),
gg AS (SELECT g.*, lv.ord, ln(p / (1 - p)) AS lo, 1.0 / (n * p * (1 - p)) AS v FROM g JOIN lv USING (dow)),
ref AS (SELECT * FROM gg WHERE ord = 0)
SELECT 'Intercept' AS term, {r6('ref.lo')} AS coef, {r6('sqrt(ref.v)')} AS se FROM ref
UNION ALL
SELECT 'C(dow)[T.' || gg.dow || ']', {r6('gg.lo - ref.lo')}, {r6('sqrt(gg.v + ref.v)')} FROM gg, ref WHERE gg.ord > 0""")


def _ols_baselines() -> str:
    return with_(split_ctes(P), f""",
ltr AS (SELECT airline, ln(arr_delay) AS y FROM train WHERE arr_delay > 0),
lte AS (SELECT airline, arr_delay, ln(arr_delay) AS y FROM test WHERE arr_delay > 0),
b0 AS (SELECT AVG(y) AS m FROM ltr),
b1 AS (SELECT airline, AVG(y) AS m FROM ltr GROUP BY airline),
pr AS (SELECT lte.*, b0.m AS p0, b1.m AS p1 FROM lte CROSS JOIN b0 LEFT JOIN b1 USING (airline))
SELECT 'B0: train mean' AS model, {r6('sqrt(AVG((y - p0) * (y - p0)))')} AS rmse_log, {r6('AVG(abs(y - p0))')} AS mae_log,
  {r6('sqrt(AVG((arr_delay - exp(p0)) * (arr_delay - exp(p0))))')} AS rmse_minutes,
  {r6('AVG(abs(arr_delay - exp(p0)))')} AS mae_minutes FROM pr
UNION ALL
SELECT 'B1: per-airline mean', {r6('sqrt(AVG((y - p1) * (y - p1)))')}, {r6('AVG(abs(y - p1))')},
  {r6('sqrt(AVG((arr_delay - exp(p1)) * (arr_delay - exp(p1))))')}, {r6('AVG(abs(arr_delay - exp(p1)))')} FROM pr""")


def _confusion_select(label: str, pred: str, name: str) -> str:
    tp = f"SUM(CASE WHEN {label} AND {pred} THEN 1 ELSE 0 END)"
    fp = f"SUM(CASE WHEN NOT {label} AND {pred} THEN 1 ELSE 0 END)"
    fn = f"SUM(CASE WHEN {label} AND NOT {pred} THEN 1 ELSE 0 END)"
    tn = f"SUM(CASE WHEN NOT {label} AND NOT {pred} THEN 1 ELSE 0 END)"

    def ratio(num, den):
        return r6(f"CASE WHEN ({den}) = 0 THEN 0.0 ELSE CAST({num} AS DOUBLE) / ({den}) END")
    return (f"SELECT '{name}' AS baseline, CAST({tp} AS BIGINT) AS tp, CAST({fp} AS BIGINT) AS fp, "
            f"CAST({fn} AS BIGINT) AS fn, CAST({tn} AS BIGINT) AS tn, "
            f"{ratio(f'{tp} + {tn}', f'{tp} + {fp} + {fn} + {tn}')} AS accuracy, "
            f"{ratio(tp, f'{tp} + {fp}')} AS precision, {ratio(tp, f'{tp} + {fn}')} AS recall, "
            f"{ratio(f'2 * {tp}', f'2 * {tp} + {fp} + {fn}')} AS f1 FROM test")


def _risk_baselines() -> str:
    return with_(split_ctes(P), "\n" + _confusion_select("is_delayed", "FALSE", "B0: always not delayed")
                 + "\nUNION ALL\n"
                 + _confusion_select("is_delayed", f"dep_hour >= {C.RULE_BASELINE_HOUR}",
                                     f"B1: dep_hour >= {C.RULE_BASELINE_HOUR}"))


def _rate_ctes() -> str:
    return f""",
fit AS (SELECT * FROM train WHERE flight_date < {d(P.fit_cutoff)}),
val AS (SELECT * FROM train WHERE flight_date >= {d(P.fit_cutoff)} AND flight_date <= {d(P.validation_end)}),
rates AS (SELECT dep_hour, AVG(CASE WHEN is_delayed THEN 1.0 ELSE 0.0 END) AS rate FROM fit GROUP BY dep_hour),
overall AS (SELECT AVG(CASE WHEN is_delayed THEN 1.0 ELSE 0.0 END) AS o FROM fit),
sv AS (SELECT v.is_delayed AS y, COALESCE(r.rate, overall.o) AS p FROM val v CROSS JOIN overall LEFT JOIN rates r USING (dep_hour)),
st AS (SELECT t.is_delayed AS y, t.flight_date, COALESCE(r.rate, overall.o) AS p FROM test t CROSS JOIN overall LEFT JOIN rates r USING (dep_hour))""" + _sweep_ctes()


def _sweep_ctes() -> str:
    """Brute-force threshold sweeps over scored validation rows sv(y, p) and test rows st(y, p)."""
    return f""",
th AS (SELECT k, CAST(k + {C.THRESHOLD_PCT_RANGE[0] - 1} AS DOUBLE) / 100.0 AS threshold
       FROM (SELECT CAST(range AS INTEGER) AS k FROM range(1, {C.THRESHOLD_PCT_RANGE[1] - C.THRESHOLD_PCT_RANGE[0] + 2}))),
sweep_v AS (SELECT th.k, th.threshold,
    CAST(SUM(CASE WHEN sv.p >= th.threshold AND sv.y THEN 1 ELSE 0 END) AS BIGINT) AS tp,
    CAST(SUM(CASE WHEN sv.p >= th.threshold AND NOT sv.y THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(SUM(CASE WHEN sv.p < th.threshold AND sv.y THEN 1 ELSE 0 END) AS BIGINT) AS fn,
    CAST(SUM(CASE WHEN sv.p < th.threshold AND NOT sv.y THEN 1 ELSE 0 END) AS BIGINT) AS tn,
    CAST(COUNT(*) AS BIGINT) AS n
  FROM th CROSS JOIN sv GROUP BY th.k, th.threshold),
sweep_t AS (SELECT th.k, th.threshold,
    CAST(SUM(CASE WHEN st.p >= th.threshold AND st.y THEN 1 ELSE 0 END) AS BIGINT) AS tp,
    CAST(SUM(CASE WHEN st.p >= th.threshold AND NOT st.y THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(SUM(CASE WHEN st.p < th.threshold AND st.y THEN 1 ELSE 0 END) AS BIGINT) AS fn,
    CAST(SUM(CASE WHEN st.p < th.threshold AND NOT st.y THEN 1 ELSE 0 END) AS BIGINT) AS tn,
    CAST(COUNT(*) AS BIGINT) AS n
  FROM th CROSS JOIN st GROUP BY th.k, th.threshold)"""


def _sensitivity_body(scenarios=P.cost_scenarios) -> str:
    sc = ", ".join(f"({i}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for i, (a, b) in enumerate(scenarios))
    return f""",
scen(scenario, cost_fp, cost_fn) AS (VALUES {sc}),
costs AS (SELECT scen.*, sweep_v.k, sweep_v.threshold,
                 (CAST(sweep_v.fp AS DOUBLE) * cost_fp + CAST(sweep_v.fn AS DOUBLE) * cost_fn) / CAST(sweep_v.n AS DOUBLE) * 1000.0 AS cost
          FROM scen CROSS JOIN sweep_v),
best AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY scenario ORDER BY cost, k) AS rn FROM costs) WHERE rn = 1),
sens AS (SELECT best.scenario, best.cost_fp, best.cost_fn, best.cost_fn / best.cost_fp AS cost_ratio_fn_fp, best.threshold,
    CASE WHEN t.tp + t.fp = 0 THEN 0.0 ELSE CAST(t.tp AS DOUBLE) / (t.tp + t.fp) END AS precision,
    CASE WHEN t.tp + t.fn = 0 THEN 0.0 ELSE CAST(t.tp AS DOUBLE) / (t.tp + t.fn) END AS recall,
    CAST(t.tp + t.fp AS DOUBLE) / CAST(t.n AS DOUBLE) AS flagged_share,
    (CAST(t.fp AS DOUBLE) * best.cost_fp + CAST(t.fn AS DOUBLE) * best.cost_fn) / CAST(t.n AS DOUBLE) * 1000.0 AS model_cost_per_1000,
    (CAST(t.fp + t.tn AS DOUBLE) * best.cost_fp) / CAST(t.n AS DOUBLE) * 1000.0 AS flag_all_cost_per_1000
  FROM best JOIN sweep_t t USING (k))"""


FINDING_SCENARIOS = ((1.0, 8.0), (1.0, 4.0), (1.0, 2.0), (1.0, 1.0), (2.0, 1.0), (4.0, 1.0))


def _findings_body() -> str:
    """Both findings, a row each; nulls where no cost pair shows one."""
    return f""",
f1 AS (SELECT 'first_ratio_flagging_under_half' AS finding, * FROM sens WHERE flagged_share < {C.FLAGGED_SHARE_LIMIT}
       ORDER BY cost_ratio_fn_fp DESC, scenario LIMIT 1),
f2 AS (SELECT 'lowest_ratio_with_meaningful_saving' AS finding, * FROM sens
       WHERE (flag_all_cost_per_1000 - model_cost_per_1000) / flag_all_cost_per_1000 * 100.0 >= {C.MEANINGFUL_SAVING_PCT}
       ORDER BY cost_ratio_fn_fp ASC, scenario LIMIT 1),
f AS (SELECT * FROM f1 UNION ALL SELECT * FROM f2),
fn(finding) AS (VALUES ('first_ratio_flagging_under_half'), ('lowest_ratio_with_meaningful_saving'))
SELECT finding, {_sens_cols('f.')} FROM fn LEFT JOIN f USING (finding)"""


def _sens_cols(prefix: str = "") -> str:
    p = prefix
    return (f"{p}scenario, {r6(f'{p}cost_fp')} AS cost_fp, {r6(f'{p}cost_fn')} AS cost_fn, "
            f"{r6(f'{p}cost_ratio_fn_fp')} AS cost_ratio_fn_fp, {r6(f'{p}threshold')} AS threshold, "
            f"{r6(f'{p}precision')} AS precision, {r6(f'{p}recall')} AS recall, {r6(f'{p}flagged_share')} AS flagged_share, "
            f"{r6(f'{p}model_cost_per_1000')} AS model_cost_per_1000, {r6(f'{p}flag_all_cost_per_1000')} AS flag_all_cost_per_1000, "
            f"{r6(f'{p}flag_all_cost_per_1000 - {p}model_cost_per_1000')} AS savings_vs_flag_all, "
            f"{r6(f'({p}flag_all_cost_per_1000 - {p}model_cost_per_1000) / {p}flag_all_cost_per_1000 * 100.0')} AS savings_pct_of_flag_all")


def _calibration_case(col: str) -> str:
    step = 1.0 / C.CALIBRATION_BINS
    inner = [i * step for i in range(C.CALIBRATION_BINS)][1:]
    parts = " ".join(f"WHEN {col} <= {_dbl(e)} THEN {i}" for i, e in enumerate(inner))
    return f"CASE {parts} ELSE {C.CALIBRATION_BINS - 1} END"


def _other_shares() -> str:
    n = P.top_n_airports
    return with_(split_ctes(P), f""",
to_ AS (SELECT origin FROM train GROUP BY origin ORDER BY COUNT(*) DESC, origin LIMIT {n}),
td AS (SELECT dest FROM train GROUP BY dest ORDER BY COUNT(*) DESC, dest LIMIT {n}),
both_ AS (SELECT 'train' AS split, origin, dest FROM train UNION ALL SELECT 'test', origin, dest FROM test)
SELECT split, 'origin_top' AS feature,
  {r6("AVG(CASE WHEN origin IN (SELECT origin FROM to_) THEN 0.0 ELSE 1.0 END) * 100")} AS other_pct
FROM both_ GROUP BY split
UNION ALL
SELECT split, 'dest_top', {r6("AVG(CASE WHEN dest IN (SELECT dest FROM td) THEN 0.0 ELSE 1.0 END) * 100")}
FROM both_ GROUP BY split""")


def _ols_other_shares() -> str:
    n = P.top_n_airports
    return with_(split_ctes(P), f""",
lt AS (SELECT origin, dest FROM train WHERE arr_delay > 0),
ls AS (SELECT origin, dest FROM test WHERE arr_delay > 0),
to_ AS (SELECT origin FROM lt GROUP BY origin ORDER BY COUNT(*) DESC, origin LIMIT {n}),
td AS (SELECT dest FROM lt GROUP BY dest ORDER BY COUNT(*) DESC, dest LIMIT {n}),
both_ AS (SELECT 'train' AS split, origin, dest FROM lt UNION ALL SELECT 'test', origin, dest FROM ls)
SELECT split, 'origin_top' AS feature,
  {r6("AVG(CASE WHEN origin IN (SELECT origin FROM to_) THEN 0.0 ELSE 1.0 END) * 100")} AS other_pct
FROM both_ GROUP BY split
UNION ALL
SELECT split, 'dest_top', {r6("AVG(CASE WHEN dest IN (SELECT dest FROM td) THEN 0.0 ELSE 1.0 END) * 100")}
FROM both_ GROUP BY split""")


def _late_features() -> str:
    """Late train rows with the magnitude features (top-N from the late rows themselves)."""
    n = P.top_n_airports
    hb = ("CASE WHEN dep_hour <= 4 THEN 'red_eye' WHEN dep_hour <= 7 THEN 'early_morning' "
          "WHEN dep_hour <= 11 THEN 'morning' WHEN dep_hour <= 15 THEN 'midday' "
          "WHEN dep_hour <= 19 THEN 'evening' WHEN dep_hour <= 23 THEN 'night' END")
    return f""",
late0 AS (SELECT * FROM train WHERE arr_delay > 0),
tor AS (SELECT origin FROM late0 GROUP BY origin ORDER BY COUNT(*) DESC, origin LIMIT {n}),
tde AS (SELECT dest FROM late0 GROUP BY dest ORDER BY COUNT(*) DESC, dest LIMIT {n}),
lf AS (SELECT ln(arr_delay) AS y, {hb} AS dep_hour_bin, dow, holiday_flag, airline,
              CASE WHEN origin IN (SELECT origin FROM tor) THEN origin ELSE 'OTHER' END AS origin_top,
              CASE WHEN dest IN (SELECT dest FROM tde) THEN dest ELSE 'OTHER' END AS dest_top,
              ln(distance) AS log_distance
       FROM late0)"""


_MODEL_KINDS = {"distance": "double", "arr_delay": "double"}


def _sampled(src: str, n: int, seed: int) -> str:
    """The n rows of a model-table relation with the smallest md5 of seed and row text."""
    text = ", ".join("COALESCE(" + (f"CAST(TRY_CAST({c} * CAST(1e6 AS DOUBLE) AS DECIMAL(38,0)) AS VARCHAR)"
                                    if c in _MODEL_KINDS else f"CAST({c} AS VARCHAR)") + ", '\\N')" for c in C.MODEL_COLUMNS)
    return (f"SELECT {', '.join(C.MODEL_COLUMNS)} FROM {src} "
            f"ORDER BY md5('{seed}|' || concat_ws('|', {text})), {', '.join(C.MODEL_COLUMNS)} LIMIT {n}")


def _diagnostics(tail: str) -> str:
    """``dg(resid, resid_raw, fitted)``: sampled late train rows under M2 and its raw-minutes twin."""
    from .ols_sql import entry_selects, ols_hc1_sql
    terms = _m_terms(True)
    keys = ", ".join(t["col"] for t in terms)
    hb = ("CASE WHEN dep_hour <= 4 THEN 'red_eye' WHEN dep_hour <= 7 THEN 'early_morning' "
          "WHEN dep_hour <= 11 THEN 'morning' WHEN dep_hour <= 15 THEN 'midday' "
          "WHEN dep_hour <= 19 THEN 'evening' WHEN dep_hour <= 23 THEN 'night' END")
    es, _ = entry_selects(terms, "ds", "rid")
    body = _late_features() + ",\n" + ols_hc1_sql("lf", "y", terms, output="chain") + f""",
minutes AS (SELECT {keys}, SUM(exp(y)) AS m FROM lf GROUP BY {keys}),
xm AS (SELECT e.j AS i, SUM(minutes.m * e.v) AS v FROM e JOIN c USING (cid) JOIN minutes USING ({keys}) GROUP BY 1),
beta_raw AS (SELECT ginv.i, SUM(ginv.v * xm.v) AS b FROM ginv JOIN xm ON xm.i = ginv.j GROUP BY ginv.i),
smp AS ({_sampled('late0', P.diag_sample_size, P.diag_seed)}),
ds AS (SELECT ROW_NUMBER() OVER () AS rid, arr_delay, ln(arr_delay) AS y, {hb} AS dep_hour_bin, dow, holiday_flag, airline,
              CASE WHEN origin IN (SELECT origin FROM tor) THEN origin ELSE 'OTHER' END AS origin_top,
              CASE WHEN dest IN (SELECT dest FROM tde) THEN dest ELSE 'OTHER' END AS dest_top,
              ln(distance) AS log_distance FROM smp),
de(rid, j, v) AS ({" UNION ALL ".join(es)}),
df AS (SELECT rid, SUM(de.v * beta.b) AS f, SUM(de.v * beta_raw.b) AS fr
       FROM de JOIN beta ON beta.i = de.j JOIN beta_raw ON beta_raw.i = de.j GROUP BY rid),
dg AS (SELECT df.f AS fitted, ds.y - df.f AS resid, ds.arr_delay - df.fr AS resid_raw FROM ds JOIN df USING (rid)),
pts AS (SELECT model, sample, CAST(ROW_NUMBER() OVER (PARTITION BY model ORDER BY sample) AS INTEGER) AS i,
               COUNT(*) OVER (PARTITION BY model) AS n
        FROM (SELECT 'log' AS model, resid AS sample FROM dg UNION ALL SELECT 'raw', resid_raw FROM dg)),
med AS (SELECT *, CASE WHEN i = n THEN pow(CAST(0.5 AS DOUBLE), CAST(1.0 AS DOUBLE) / n)
                       WHEN i = 1 THEN 1 - pow(CAST(0.5 AS DOUBLE), CAST(1.0 AS DOUBLE) / n)
                       ELSE (i - CAST(0.3175 AS DOUBLE)) / (n + CAST(0.365 AS DOUBLE)) END AS u FROM pts),
qq AS (SELECT model, i, sample, {norm_ppf_sql('u')} AS theoretical FROM med)
{tail}"""
    return with_(split_ctes(P), body).replace("WITH ", "WITH RECURSIVE ", 1)


def _risk_summaries() -> dict[str, str]:
    from .ols_sql import logit_irls_sql
    fit = with_(split_ctes(P), _risk_features(fit_only=True) + ",\n"
                + logit_irls_sql("rfit", "is_delayed", _deploy_terms(), penalty=1.0, output="chain") + f""",
rvs AS (SELECT * FROM rf WHERE flight_date >= {d(P.fit_cutoff)} AND flight_date <= {d(P.validation_end)})
SELECT TRUE AS converged, {r6('(SELECT b FROM coefs WHERE i = 0)')} AS intercept,
  (SELECT CAST(COUNT(*) AS DOUBLE) FROM rfit) AS fit_rows,
  {r6('(SELECT AVG(CASE WHEN is_delayed THEN 1.0 ELSE 0.0 END) FROM rfit)')} AS fit_delay_rate,
  (SELECT CAST(COUNT(*) AS DOUBLE) FROM rvs) AS validation_rows,
  {r6('(SELECT AVG(CASE WHEN is_delayed THEN 1.0 ELSE 0.0 END) FROM rvs)')} AS validation_delay_rate,
  (SELECT airline FROM rf GROUP BY airline ORDER BY COUNT(*) DESC, airline LIMIT 1) AS ref_airline,
  (SELECT ref FROM refap) AS ref_airport, dims.p - 1 AS n_features FROM dims""")
    inference = with_(split_ctes(P), _risk_features(sampled=True) + ",\n"
                      + logit_irls_sql("rs", "is_delayed", _risk_terms(), output="stats"))
    return {"risk_fit_summary": fit.replace("WITH ", "WITH RECURSIVE ", 1),
            "risk_inference_summary": inference.replace("WITH ", "WITH RECURSIVE ", 1)}


def _m_terms(full: bool) -> list[dict]:
    from .ols_sql import _levels_values
    terms = [
        {"kind": "factor", "col": "dep_hour_bin", "label": "C(dep_hour_bin)",
         "levels_sql": _levels_values(C.DEP_HOUR_BIN_MODEL_ORDER)},
        {"kind": "factor", "col": "dow", "label": "C(dow)", "levels_sql": _levels_values(C.DOW_ORDER)},
        {"kind": "flag", "col": "holiday_flag"},
    ]
    if full:
        terms += [
            {"kind": "factor", "col": "airline", "label": "C(airline)",
             "levels_sql": "SELECT airline AS val, CAST(ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, airline) - 1 "
                           "AS INTEGER) AS ord FROM lf GROUP BY airline"},
            {"kind": "factor", "col": "origin_top", "label": "C(origin_top)",
             "levels_sql": "SELECT val, CAST(ROW_NUMBER() OVER (ORDER BY val) - 1 AS INTEGER) AS ord "
                           "FROM (SELECT DISTINCT origin_top AS val FROM lf)"},
            {"kind": "factor", "col": "dest_top", "label": "C(dest_top)",
             "levels_sql": "SELECT val, CAST(ROW_NUMBER() OVER (ORDER BY val) - 1 AS INTEGER) AS ord "
                           "FROM (SELECT DISTINCT dest_top AS val FROM lf)"},
            {"kind": "numeric", "col": "log_distance"},
        ]
    return terms


def _ols_hc1(full: bool, output: str = "coef", vif: bool = False, with_pvalues: bool = False) -> str:
    from .ols_sql import ols_hc1_sql
    terms = _m_terms(full)
    if vif:   # dep_hour_bin, dow, holiday, airline, log_distance
        terms = _m_terms(True)
        terms = terms[:4] + terms[6:]
    sql = with_(split_ctes(P), _late_features() + ",\n" + ols_hc1_sql("lf", "y", terms, output, with_pvalues))
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _ols_table(full: bool, tail: str) -> str:
    from .ols_sql import ols_hc1_sql
    body = _late_features() + ",\n" + ols_hc1_sql("lf", "y", _m_terms(full), output="table") + "\n" + tail
    return with_(split_ctes(P), body).replace("WITH ", "WITH RECURSIVE ", 1)


_COEF_COLS = "term, family, coef, se AS robust_se, z, p_value, ci_low, ci_high"
_ODDS_COLS = "term, family, coef, odds_ratio, or_ci_low, or_ci_high, p_value"


def _headline_filter() -> str:
    conds = []
    for f, lv in P.headline_terms:
        needles = [f] + ([str(lv)] if lv is not None else [])
        conds.append("(" + " AND ".join(f"contains(term, '{x}')" for x in needles) + ")")
    return " OR ".join(conds)


def _odds_tables() -> dict[str, str]:
    from .ols_sql import logit_irls_sql
    head = with_(split_ctes(P), _risk_features(sampled=True) + ",\n" + logit_irls_sql("rs", "is_delayed", _risk_terms(),
                                                                                      output="table"))
    top = f""",
top AS (SELECT *, ROW_NUMBER() OVER (ORDER BY abs(b_raw) DESC, term) AS rk FROM ctab
        WHERE term <> 'Intercept' ORDER BY rk LIMIT {C.TOP_COEFFICIENTS})"""
    odds = head + top + f"\nSELECT {_ODDS_COLS} FROM top"
    picks = head + top + f""",
fp AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY family ORDER BY rk) AS fr FROM top),
pk AS (SELECT * FROM fp WHERE fr = 1 ORDER BY rk LIMIT 3)
SELECT {_ODDS_COLS} FROM pk WHERE (SELECT COUNT(*) FROM pk) >= 3
UNION ALL SELECT {_ODDS_COLS} FROM top WHERE (SELECT COUNT(*) FROM pk) < 3 AND rk <= 3"""
    return {"risk_odds_ratios": odds.replace("WITH ", "WITH RECURSIVE ", 1),
            "risk_odds_picks": picks.replace("WITH ", "WITH RECURSIVE ", 1)}


def _model_comparison() -> str:
    """B0, B1, M1, M2 on the late test rows; M1 / M2 refitted in SQL and scored through their own levels."""
    from .ols_sql import entry_selects, namespaced, ols_hc1_sql
    t1, t2 = _m_terms(False), _m_terms(True)
    m1 = namespaced(ols_hc1_sql("lf", "y", t1, output="chain"), "m1_")
    m2 = namespaced(ols_hc1_sql("lf", "y", t2, output="chain"), "m2_")
    hb = ("CASE WHEN dep_hour <= 4 THEN 'red_eye' WHEN dep_hour <= 7 THEN 'early_morning' "
          "WHEN dep_hour <= 11 THEN 'morning' WHEN dep_hour <= 15 THEN 'midday' "
          "WHEN dep_hour <= 19 THEN 'evening' WHEN dep_hour <= 23 THEN 'night' END")
    e1, _ = entry_selects(t1, "tl", "rid", lv="m1_lv")
    e2, _ = entry_selects(t2, "tl", "rid", lv="m2_lv")

    def metrics(col):
        return (f"{r6(f'sqrt(AVG((y - {col}) * (y - {col})))')} AS rmse_log, {r6(f'AVG(abs(y - {col}))')} AS mae_log, "
                f"{r6(f'sqrt(AVG((arr_delay - exp({col})) * (arr_delay - exp({col}))))')} AS rmse_minutes, "
                f"{r6(f'AVG(abs(arr_delay - exp({col})))')} AS mae_minutes")
    body = _late_features() + ",\n" + m1 + ",\n" + m2 + f""",
tl AS (SELECT ROW_NUMBER() OVER () AS rid, arr_delay, ln(arr_delay) AS y, {hb} AS dep_hour_bin, dow, holiday_flag,
              airline,
              CASE WHEN origin IN (SELECT origin FROM tor) THEN origin ELSE 'OTHER' END AS origin_top,
              CASE WHEN dest IN (SELECT dest FROM tde) THEN dest ELSE 'OTHER' END AS dest_top,
              ln(distance) AS log_distance
       FROM test WHERE arr_delay > 0),
e1(rid, j, v) AS ({" UNION ALL ".join(e1)}),
e2(rid, j, v) AS ({" UNION ALL ".join(e2)}),
f1 AS (SELECT rid, SUM(e1.v * m1_beta.b) AS f FROM e1 JOIN m1_beta ON m1_beta.i = e1.j GROUP BY rid),
f2 AS (SELECT rid, SUM(e2.v * m2_beta.b) AS f FROM e2 JOIN m2_beta ON m2_beta.i = e2.j GROUP BY rid),
bm0 AS (SELECT AVG(y) AS m FROM lf),
bm1 AS (SELECT airline, AVG(y) AS m FROM lf GROUP BY airline),
pr AS (SELECT tl.y, tl.arr_delay, bm0.m AS p0, bm1.m AS p1, f1.f AS pm1, f2.f AS pm2
       FROM tl CROSS JOIN bm0 LEFT JOIN bm1 USING (airline) JOIN f1 USING (rid) JOIN f2 USING (rid))
SELECT 'B0: train mean' AS model, {metrics('p0')} FROM pr
UNION ALL SELECT 'B1: per-airline mean', {metrics('p1')} FROM pr
UNION ALL SELECT 'M1: schedule only', {metrics('pm1')} FROM pr
UNION ALL SELECT 'M2: + airline/airport/distance', {metrics('pm2')} FROM pr"""
    return with_(split_ctes(P), body).replace("WITH ", "WITH RECURSIVE ", 1)


def _model_stats() -> str:
    m1 = _ols_hc1(full=False, output="stats")
    m2 = _ols_hc1(full=True, output="stats")
    return (f"SELECT 'M1' AS model, * FROM ({m1})\nUNION ALL\nSELECT 'M2', * FROM ({m2})")


def _risk_features(fit_only: bool = False, sampled: bool = False) -> str:
    """Train rows with the risk features; top-N sets and references from train.
    With ``fit_only`` also ``rfit``: the rows before the fit cut-off; with ``sampled`` also ``rs``: the seeded sample."""
    n = P.top_n_airports
    hb = ("CASE WHEN dep_hour <= 4 THEN 'red_eye' WHEN dep_hour <= 7 THEN 'early_morning' "
          "WHEN dep_hour <= 11 THEN 'morning' WHEN dep_hour <= 15 THEN 'midday' "
          "WHEN dep_hour <= 19 THEN 'evening' WHEN dep_hour <= 23 THEN 'night' END")
    return f""",
tor AS (SELECT origin, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, origin) AS rk FROM train GROUP BY origin
        ORDER BY rk LIMIT {n}),
tde AS (SELECT dest FROM train GROUP BY dest ORDER BY COUNT(*) DESC, dest LIMIT {n}),
refap AS (SELECT origin AS ref FROM tor WHERE origin IN (SELECT dest FROM tde) ORDER BY rk LIMIT 1),
rf AS ({(rows := f"""SELECT is_delayed, {hb} AS dep_hour_bin, dow, holiday_flag, airline,
              CASE WHEN origin IN (SELECT origin FROM tor) THEN origin ELSE 'OTHER' END AS origin_top,
              CASE WHEN dest IN (SELECT dest FROM tde) THEN dest ELSE 'OTHER' END AS dest_top,
              ln(distance) AS log_distance, flight_date
       FROM """)}train)""" + (f""",
rfit AS (SELECT * FROM rf WHERE flight_date < {d(P.fit_cutoff)})""" if fit_only else "") + (f""",
drawn AS ({_sampled('train', P.sample_size, P.sample_seed)}),
rs AS ({rows}drawn)""" if sampled else "")


def _risk_terms() -> list[dict]:
    from .ols_sql import _levels_values
    ap = ("SELECT val, CAST(ROW_NUMBER() OVER (ORDER BY CASE WHEN val = (SELECT ref FROM refap) THEN 0 "
          "WHEN val = 'OTHER' THEN 2 ELSE 1 END, val) - 1 AS INTEGER) AS ord FROM (SELECT DISTINCT {c} AS val FROM rf)")
    return [
        {"kind": "factor", "col": "dep_hour_bin", "label": "C(dep_hour_bin)",
         "levels_sql": _levels_values(C.DEP_HOUR_BIN_MODEL_ORDER)},
        {"kind": "factor", "col": "dow", "label": "C(dow)", "levels_sql": _levels_values(C.DOW_ORDER)},
        {"kind": "flag", "col": "holiday_flag"},
        {"kind": "factor", "col": "airline", "label": "C(airline)",
         "levels_sql": "SELECT airline AS val, CAST(ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, airline) - 1 "
                       "AS INTEGER) AS ord FROM rf GROUP BY airline"},
        {"kind": "factor", "col": "origin_top", "label": "C(origin_top)", "levels_sql": ap.format(c="origin_top")},
        {"kind": "factor", "col": "dest_top", "label": "C(dest_top)", "levels_sql": ap.format(c="dest_top")},
        {"kind": "numeric", "col": "log_distance"},
    ]


def _deploy_terms() -> list[dict]:
    """The deployed model's columns: every listed level, OTHER included."""
    ap = ("SELECT val, CAST(ROW_NUMBER() OVER (ORDER BY CASE WHEN val = (SELECT ref FROM refap) THEN 0 "
          "WHEN val = 'OTHER' THEN 2 ELSE 1 END, val) - 1 AS INTEGER) AS ord FROM "
          "(SELECT {c} AS val FROM {t} UNION SELECT 'OTHER')")
    t = _risk_terms()
    fac = {x["col"]: x for x in t}
    fac["origin_top"] = dict(fac["origin_top"], levels_sql=ap.format(c="origin", t="tor"))
    fac["dest_top"] = dict(fac["dest_top"], levels_sql=ap.format(c="dest", t="tde"))
    return [fac["dep_hour_bin"], fac["dow"], fac["airline"], fac["origin_top"], fac["dest_top"],
            fac["log_distance"], fac["holiday_flag"]]


def _risk_deploy() -> str:
    from .ols_sql import logit_irls_sql
    body = logit_irls_sql("rfit", "is_delayed", _deploy_terms(), penalty=1.0, output="coef")
    sql = with_(split_ctes(P), _risk_features(fit_only=True) + ",\n" + body)
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _risk_scored() -> str:
    """The deployed model fitted in SQL, then validation rows sv(y, p) and test
    rows st(y, flight_date, p, o) scored from its own estimates (o = offset,
    the log-odds without the intercept)."""
    from .ols_sql import entry_selects, logit_irls_sql
    terms = _deploy_terms()
    chain = logit_irls_sql("rfit", "is_delayed", terms, penalty=1.0, output="chain")
    hb = ("CASE WHEN dep_hour <= 4 THEN 'red_eye' WHEN dep_hour <= 7 THEN 'early_morning' "
          "WHEN dep_hour <= 11 THEN 'morning' WHEN dep_hour <= 15 THEN 'midday' "
          "WHEN dep_hour <= 19 THEN 'evening' WHEN dep_hour <= 23 THEN 'night' END")
    ve, _ = entry_selects(terms, "rv", "rid")
    te, _ = entry_selects(terms, "rt", "rid")
    return _risk_features(fit_only=True) + ",\n" + chain + f""",
rv AS (SELECT ROW_NUMBER() OVER () AS rid, * FROM rf
       WHERE flight_date >= {d(P.fit_cutoff)} AND flight_date <= {d(P.validation_end)}),
rt AS (SELECT ROW_NUMBER() OVER () AS rid, is_delayed, flight_date, {hb} AS dep_hour_bin, dow, holiday_flag, airline,
              CASE WHEN origin IN (SELECT origin FROM tor) THEN origin ELSE 'OTHER' END AS origin_top,
              CASE WHEN dest IN (SELECT dest FROM tde) THEN dest ELSE 'OTHER' END AS dest_top,
              ln(distance) AS log_distance
       FROM test),
ven(rid, j, v) AS ({" UNION ALL ".join(ve)}),
ten(rid, j, v) AS ({" UNION ALL ".join(te)}),
b_int AS (SELECT b FROM coefs WHERE i = 0),
sv AS (SELECT rv.is_delayed AS y, 1 / (1 + exp(-q.eta)) AS p FROM rv JOIN
       (SELECT rid, SUM(ven.v * coefs.b) AS eta FROM ven JOIN coefs ON coefs.i = ven.j GROUP BY rid) q USING (rid)),
st AS (SELECT rt.is_delayed AS y, rt.flight_date, 1 / (1 + exp(-q.eta)) AS p, q.eta - (SELECT b FROM b_int) AS o
       FROM rt JOIN (SELECT rid, SUM(ten.v * coefs.b) AS eta FROM ten JOIN coefs ON coefs.i = ten.j GROUP BY rid) q
       USING (rid))""" + _sweep_ctes()


def _risk_metric_sql() -> dict[str, str]:
    base = _risk_scored()
    yv = "CASE WHEN y THEN 1.0 ELSE 0.0 END"

    def q(body: str) -> str:
        return with_(split_ctes(P), base + body).replace("WITH ", "WITH RECURSIVE ", 1)

    ranking = f""",
g AS (SELECT p AS score, SUM(CASE WHEN y THEN 1 ELSE 0 END) AS pos, SUM(CASE WHEN y THEN 0 ELSE 1 END) AS neg FROM st GROUP BY p),
cc AS (SELECT score, CAST(pos AS DOUBLE) AS pos, CAST(neg AS DOUBLE) AS neg,
        CAST(SUM(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS cum_pos,
        CAST(SUM(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS cum_neg FROM g),
tot AS (SELECT CAST(SUM(pos) AS DOUBLE) AS P, CAST(SUM(neg) AS DOUBLE) AS N FROM g),
rk AS (SELECT SUM(neg * ((cum_pos - pos) + pos * 0.5)) / (MAX(P) * MAX(N)) AS roc_auc,
              SUM(pos / P * cum_pos / (cum_pos + cum_neg)) AS ap, MAX(P) / (MAX(P) + MAX(N)) AS rate FROM cc, tot)
SELECT {r6('roc_auc')} AS roc_auc, {r6('ap')} AS pr_auc, {r6('rate')} AS pr_auc_floor, {r6('ap / rate')} AS lift FROM rk"""
    calib = lambda rel, p: f"""SELECT CAST({_calibration_case(p)} AS INTEGER) AS bin,
  {r6(f'AVG({yv})')} AS prob_true, {r6(f'AVG({p})')} AS prob_pred, COUNT(*) AS n FROM {rel} GROUP BY 1"""  # noqa: E731
    brier = f"""
SELECT {r6(f'AVG((p - {yv}) * (p - {yv}))')} AS brier, {r6('AVG(p)')} AS mean_pred, {r6(f'AVG({yv})')} AS positive_rate,
  COUNT(*) AS n, {r6(f'AVG(p) - AVG({yv})')} AS gap FROM st"""
    costs = f"""
SELECT k, {r6('threshold')} AS threshold, fp, fn, n,
  {r6(f'(CAST(fp AS DOUBLE) * {_dbl(P.false_alarm_cost)} + CAST(fn AS DOUBLE) * {_dbl(P.missed_delay_cost)}) / CAST(n AS DOUBLE) * 1000.0')} AS cost_per_1000
FROM sweep_v"""
    chosen_cte = f""",
ch AS (SELECT k, threshold, (CAST(fp AS DOUBLE) * {_dbl(P.false_alarm_cost)} + CAST(fn AS DOUBLE) * {_dbl(P.missed_delay_cost)})
                         / CAST(n AS DOUBLE) * 1000.0 AS cost FROM sweep_v ORDER BY cost, k LIMIT 1)"""
    chosen = chosen_cte + f"""
SELECT 0 AS scenario, {r6(_dbl(P.false_alarm_cost))} AS cost_fp, {r6(_dbl(P.missed_delay_cost))} AS cost_fn, k,
  {r6('threshold')} AS threshold, {r6('cost')} AS val_cost_per_1000 FROM ch"""
    k_default = E_K_DEFAULT

    def rep(label: str, kexpr: str) -> str:
        return (f"SELECT '{label}' AS label, k, threshold, tp, fp, fn, tn, n, "
                f"CASE WHEN n = 0 THEN 0.0 ELSE CAST(tp + tn AS DOUBLE) / n END AS accuracy, "
                f"CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision, "
                f"CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall, "
                f"CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END AS f1, "
                f"(CAST(fp AS DOUBLE) * {_dbl(P.false_alarm_cost)} + CAST(fn AS DOUBLE) * {_dbl(P.missed_delay_cost)}) "
                f"/ CAST(n AS DOUBLE) * 1000.0 AS cost FROM sweep_t WHERE k = {kexpr}")
    report = chosen_cte + f""",
rr AS ({rep('cost-optimal', '(SELECT k FROM ch)')} UNION ALL {rep('default 0.5', str(k_default))})
SELECT label, k, {r6('threshold')} AS threshold, tp, fp, fn, tn, n, {r6('accuracy')} AS accuracy,
  {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1, {r6('cost')} AS cost_per_1000,
  {r6("(SELECT cost FROM rr WHERE label = 'default 0.5') - cost")} AS saving_vs_default_per_1000 FROM rr"""
    recal_ctes = f""",
gof AS (SELECT o, CAST(COUNT(*) AS DOUBLE) AS n, SUM({yv}) AS pos FROM st
        WHERE flight_date >= {d(P.split_date)} AND flight_date <= {d(P.recal_end)} GROUP BY o),
it(k, b) AS (
  SELECT 0, CAST(0 AS DOUBLE)
  UNION ALL
  SELECT k + 1, b + (SELECT SUM(pos - n / (1 + exp(-(o + it.b))))
                            / SUM(n / (1 + exp(-(o + it.b))) * (1 - 1 / (1 + exp(-(o + it.b))))) FROM gof)
  FROM it WHERE k < 60),
nb AS (SELECT b FROM it WHERE k = 60),
rem AS (SELECT y, 1 / (1 + exp(-(o + (SELECT b FROM b_int)))) AS p_before, 1 / (1 + exp(-(o + (SELECT b FROM nb)))) AS p_after
        FROM st WHERE flight_date >= {d(P.remainder_start)})"""
    recal = recal_ctes + f"""
SELECT {r6('(SELECT b FROM b_int)')} AS original_intercept, {r6('(SELECT b FROM nb)')} AS recalibrated_intercept,
  {r6(f'AVG((p_before - {yv}) * (p_before - {yv}))')} AS brier_before,
  {r6(f'AVG((p_after - {yv}) * (p_after - {yv}))')} AS brier_after,
  AVG((p_after - {yv}) * (p_after - {yv})) < AVG((p_before - {yv}) * (p_before - {yv})) AS improved,
  COUNT(*) AS remaining_rows FROM rem"""
    curves = recal_ctes + f"""
SELECT 'before' AS which, * FROM ({calib('rem', 'p_before')})
UNION ALL SELECT 'after', * FROM ({calib('rem', 'p_after')})"""
    sens = _sensitivity_body()
    return {
        "risk_discrimination": q(ranking),
        "risk_calibration": q("\n" + calib("st", "p")),
        "risk_brier": q(brier),
        "risk_threshold_costs": q(costs),
        "risk_chosen_threshold": q(chosen),
        "risk_threshold_report": q(report),
        "risk_cost_sensitivity": q(sens + f"\nSELECT {_sens_cols()} FROM sens"),
        "risk_sensitivity_findings": q(sens + _findings_body()),
        "risk_findings_by_ratio": q(_sensitivity_body(FINDING_SCENARIOS) + _findings_body()),
        "risk_recalibration": q(recal),
        "risk_recalibration_curves": q(curves),
    }


def _risk_inference() -> str:
    """A level of the design without rows (only OTHER can be one) has no estimate: nulls."""
    from .ols_sql import logit_irls_sql
    unseen = " UNION ALL ".join(
        f"SELECT 'C({c})[T.OTHER]' AS term WHERE NOT EXISTS (SELECT 1 FROM rs WHERE {c} = 'OTHER')"
        for c in ("origin_top", "dest_top"))
    body = logit_irls_sql("rs", "is_delayed", _risk_terms()) + f"""
UNION ALL SELECT term, NULL, NULL, NULL, NULL, NULL, {r6('1 - ll.llf / ll0.llnull')} FROM ({unseen}), ll, ll0"""
    sql = with_(split_ctes(P), _risk_features(sampled=True) + ",\n" + body)
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _proof(table: str, a: str, a_pred: str, b: str, b_pred: str) -> str:
    hits = f"(CASE WHEN {a_pred} THEN 1 ELSE 0 END + CASE WHEN {b_pred} THEN 1 ELSE 0 END)"
    return with_(split_ctes(P), f"""
SELECT COUNT(*) FILTER (WHERE {a_pred}) AS rows_{a}, COUNT(*) FILTER (WHERE {b_pred}) AS rows_{b},
  COUNT(*) FILTER (WHERE {hits} = 0) AS rows_in_none, COUNT(*) FILTER (WHERE {hits} > 1) AS rows_in_several
FROM {table}""")


def _recal_intercept() -> str:
    """Newton steps for the offset logit as a recursive CTE over the distinct offsets."""
    body = with_(split_ctes(P), _rate_ctes() + f""",
g AS (SELECT ln(p / (1 - p)) AS o, CAST(COUNT(*) AS DOUBLE) AS n,
             SUM(CASE WHEN y THEN 1.0 ELSE 0.0 END) AS pos
      FROM st WHERE flight_date <= {d(P.recal_end)} GROUP BY 1),
it(k, b) AS (
  SELECT 0, CAST(0 AS DOUBLE)
  UNION ALL
  SELECT k + 1, b + (SELECT SUM(pos - n / (1 + exp(-(o + it.b))))
                            / SUM(n / (1 + exp(-(o + it.b))) * (1 - 1 / (1 + exp(-(o + it.b))))) FROM g)
  FROM it WHERE k < 60)
SELECT {r6('b')} AS intercept FROM it WHERE k = 60""")
    return body.replace("WITH ", "WITH RECURSIVE ", 1)


def models_sql() -> dict[str, str]:
    sc = split_ctes(P)
    rc = _rate_ctes()
    return {
        "ols_dow_hc1": _ols_dow(),
        "ols_distance_hc1": _ols_distance(),
        "bp_dow": _bp_dow(),
        "logit_dow": _logit_dow(),
        "ols_baselines": _ols_baselines(),
        "ols_m1_hc1": _ols_hc1(full=False),
        "ols_m2_hc1": _ols_hc1(full=True),
        "ols_m2_bp_stats": _ols_hc1(full=True, output="bp"),
        "ols_breusch_pagan": _ols_hc1(full=True, output="bp", with_pvalues=True),
        "ols_model_stats": _model_stats(),
        "ols_model_comparison": _model_comparison(),
        "ols_m1_coefficients": _ols_table(False, f"SELECT {_COEF_COLS} FROM ctab"),
        "ols_m2_coefficients": _ols_table(True, f"SELECT {_COEF_COLS} FROM ctab"),
        "ols_m2_top15": _ols_table(True, f"SELECT {_COEF_COLS} FROM ctab ORDER BY abs(b_raw) DESC, term "
                                         f"LIMIT {C.TOP_COEFFICIENTS}"),
        "ols_headline": _ols_table(True, "SELECT term, coef, se AS robust_se, ci_low, ci_high, p_value, "
                                         f"approx_pct_change FROM ctab WHERE {_headline_filter()}"),
        "ols_residuals_sample": _diagnostics(f"SELECT {r6('fitted')} AS fitted, {r6('resid')} AS resid FROM dg"),
        "ols_qq_points": _diagnostics(f"SELECT model, i, {r6('theoretical')} AS theoretical, {r6('sample')} AS sample FROM qq"),
        "ols_qq_lines": _diagnostics(f"SELECT model, {r6('regr_slope(sample, theoretical)')} AS slope, "
                                     f"{r6('regr_intercept(sample, theoretical)')} AS intercept, "
                                     f"{r6('corr(sample, theoretical)')} AS r FROM qq GROUP BY model"),
        "train_sample_seeded": with_(split_ctes(P), "\n" + _sampled("train", 10_000, P.sample_seed)),
        **_risk_summaries(),
        **_odds_tables(),
        "risk_inference_coefficients": _risk_inference(),
        "risk_coefficients": _risk_deploy(),
        **_risk_metric_sql(),
        "ols_vif": _ols_hc1(full=True, output="vif", vif=True),
        "ols_other_shares": _ols_other_shares(),
        "ols_b1_means": with_(split_ctes(P), f"""
SELECT airline, {r6("AVG(ln(arr_delay))")} AS b1_pred FROM train WHERE arr_delay > 0 GROUP BY airline"""),
        "risk_baselines": _risk_baselines(),
        "eval_rate_recal_intercept": _recal_intercept(),
        "risk_other_shares": _other_shares(),
        "risk_fit_validation_proof": _proof(
            "train", "fit", f"flight_date < {d(P.fit_cutoff)}", "validation",
            f"flight_date >= {d(P.fit_cutoff)} AND flight_date <= {d(P.validation_end)}"),
        "risk_recal_proof": _proof(
            "test", "recal", f"flight_date >= {d(P.split_date)} AND flight_date <= {d(P.recal_end)}",
            "remaining", f"flight_date >= {d(P.remainder_start)}"),
        "eval_rate_ranking": with_(sc, rc + f""",
g AS (SELECT p AS score, SUM(CASE WHEN y THEN 1 ELSE 0 END) AS pos, SUM(CASE WHEN y THEN 0 ELSE 1 END) AS neg FROM st GROUP BY p),
c AS (SELECT score, CAST(pos AS DOUBLE) AS pos, CAST(neg AS DOUBLE) AS neg,
        CAST(SUM(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS cum_pos,
        CAST(SUM(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS cum_neg FROM g),
tot AS (SELECT CAST(SUM(pos) AS DOUBLE) AS P, CAST(SUM(neg) AS DOUBLE) AS N FROM g)
SELECT {r6('SUM(neg * ((cum_pos - pos) + pos * 0.5)) / (MAX(P) * MAX(N))')} AS roc_auc,
  {r6('SUM(pos / P * cum_pos / (cum_pos + cum_neg))')} AS average_precision,
  {r6('MAX(P) / (MAX(P) + MAX(N))')} AS positive_rate
FROM c, tot"""),
        "eval_rate_calibration": with_(sc, rc + f"""
SELECT CAST({_calibration_case('p')} AS INTEGER) AS bin,
  {r6('AVG(CASE WHEN y THEN 1.0 ELSE 0.0 END)')} AS prob_true, {r6('AVG(p)')} AS prob_pred, COUNT(*) AS n
FROM st GROUP BY 1"""),
        "eval_rate_brier": with_(sc, rc + f"""
SELECT {r6('AVG((p - CASE WHEN y THEN 1.0 ELSE 0.0 END) * (p - CASE WHEN y THEN 1.0 ELSE 0.0 END))')} AS brier,
  {r6('AVG(p)')} AS mean_pred, {r6('AVG(CASE WHEN y THEN 1.0 ELSE 0.0 END)')} AS positive_rate, COUNT(*) AS n
FROM st"""),
        "eval_rate_threshold_costs": with_(sc, rc + f"""
SELECT k, {r6('threshold')} AS threshold, tp, fp, fn, tn, n,
  {r6(f'(CAST(fp AS DOUBLE) * {_dbl(P.false_alarm_cost)} + CAST(fn AS DOUBLE) * {_dbl(P.missed_delay_cost)}) / CAST(n AS DOUBLE) * 1000.0')} AS cost_per_1000
FROM sweep_v"""),
        "eval_rate_sensitivity": with_(sc, rc + _sensitivity_body() + f"""
SELECT {_sens_cols()} FROM sens"""),
        "eval_rate_findings": with_(sc, rc + _sensitivity_body() + _findings_body()),
        "eval_rate_findings_by_ratio": with_(sc, rc + _sensitivity_body(FINDING_SCENARIOS) + _findings_body()),
    }

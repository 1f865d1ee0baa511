"""Multi-factor OLS with HC1 errors as plain SQL (the oracle for the Spark fit).

Independent of the Spark implementation: cells of identical design rows,
sparse design entries per cell, Gram matrix and X'y by joins, Gauss-Jordan
elimination of [G | X'y | I] in a recursive CTE (the pivot row picked by a
window), residual sums per cell from the power sums of y, and the HC1
sandwich n/(n-p) * G^-1 M G^-1 by matrix products written as joins.
"""

from __future__ import annotations


def _levels_values(levels: list[str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{v}', {i})" for i, v in enumerate(levels)) + ") t(val, ord)"


def ols_hc1_sql(src: str, y: str, terms: list[dict], output: str = "coef", with_pvalues: bool = False) -> str:
    """CTE text (to follow other CTEs) ending in a SELECT of
    term, coef, robust_se, z, ci_low, ci_high, rsquared (rounded to 6 places).

    src: name of a relation with the term columns and y; terms, in design
    order: {"kind": "factor", "col", "label", "levels_sql"} (levels_sql gives
    (val, ord), ord 0 = reference), {"kind": "flag", "col"}, {"kind": "numeric", "col"}.
    """
    from .ctes import r6
    cols = [t["col"] for t in terms]
    parts = [f"c AS (SELECT ROW_NUMBER() OVER () AS cid, {', '.join(cols)}, CAST(COUNT(*) AS DOUBLE) AS n, "
             f"SUM({y}) AS s1, SUM(({y}) * ({y})) AS s2, SUM(({y}) * ({y}) * ({y})) AS s3, "
             f"SUM(({y}) * ({y}) * ({y}) * ({y})) AS s4 FROM {src} GROUP BY {', '.join(cols)})"]
    sizes, offsets, entries, names = [], [], ["SELECT cid, 0 AS j, CAST(1.0 AS DOUBLE) AS v FROM c"], \
        ["SELECT 0 AS j, 'Intercept' AS term"]
    off = "1"
    for k, t in enumerate(terms):
        offsets.append(off)
        if t["kind"] == "factor":
            parts.append(f"lv{k} AS ({t['levels_sql']})")
            size = f"((SELECT COUNT(*) FROM lv{k}) - 1)"
            entries.append(f"SELECT c.cid, {off} + lv.ord - 1, CAST(1.0 AS DOUBLE) FROM c JOIN lv{k} lv "
                           f"ON c.{t['col']} = lv.val WHERE lv.ord > 0")
            names.append(f"SELECT {off} + ord - 1, '{t['label']}[T.' || val || ']' FROM lv{k} WHERE ord > 0")
        elif t["kind"] == "flag":
            size = "1"
            entries.append(f"SELECT cid, {off}, CAST(1.0 AS DOUBLE) FROM c WHERE {t['col']}")
            names.append(f"SELECT {off}, '{t['col']}[T.True]'")
        else:
            size = "1"
            entries.append(f"SELECT cid, {off}, CAST({t['col']} AS DOUBLE) FROM c")
            names.append(f"SELECT {off}, '{t['col']}'")
        sizes.append(size)
        off = f"({off} + {size})"
    p = off
    parts += [
        f"dims AS (SELECT CAST({p} AS INTEGER) AS p, (SELECT SUM(n) FROM c) AS nn)",
        "e AS (" + " UNION ALL ".join(entries) + ")",
        "nm AS (" + " UNION ALL ".join(names) + ")",
        "g AS (SELECT a.j AS i, b.j AS j, SUM(c.n * a.v * b.v) AS v FROM e a JOIN e b USING (cid) "
        "JOIN c USING (cid) GROUP BY 1, 2)",
        "xy AS (SELECT e.j AS i, SUM(c.s1 * e.v) AS v FROM e JOIN c USING (cid) GROUP BY 1)",
        "grid AS (SELECT a.range AS i, b.range AS j FROM dims, range(dims.p) a, range(dims.p) b)",
        "aug AS (SELECT grid.i, list(COALESCE(g.v, 0.0) ORDER BY grid.j) AS row FROM grid "
        "LEFT JOIN g ON g.i = grid.i AND g.j = grid.j GROUP BY grid.i)",
        "aug2 AS (SELECT aug.i, list_concat(list_concat(aug.row, [COALESCE(xy.v, 0.0)]), "
        "list_transform(range((SELECT p FROM dims)), lambda q: CASE WHEN q = aug.i THEN 1.0 ELSE 0.0 END)) AS r "
        "FROM aug LEFT JOIN xy ON xy.i = aug.i)",
        "gj(k, i, r) AS (SELECT 0, i, r FROM aug2 UNION ALL "
        "SELECT k + 1, i, CASE WHEN i = k THEN list_transform(r, lambda x: x / r[k + 1]) "
        "ELSE list_transform(list_zip(r, piv), lambda z: z[1] - r[k + 1] * z[2] / piv[k + 1]) END "
        "FROM (SELECT k, i, r, max(CASE WHEN i = k THEN r END) OVER () AS piv FROM gj) "
        "WHERE k < (SELECT p FROM dims))",
        "sol AS (SELECT i, r FROM gj WHERE k = (SELECT p FROM dims))",
        "beta AS (SELECT i, r[(SELECT p FROM dims) + 1] AS b FROM sol)",
        "ginv AS (SELECT sol.i, q.range AS j, sol.r[(SELECT p FROM dims) + 2 + q.range] AS v "
        "FROM sol, range((SELECT p FROM dims)) q)",
        "fit AS (SELECT e.cid, SUM(e.v * beta.b) AS f FROM e JOIN beta ON beta.i = e.j GROUP BY e.cid)",
        "res AS (SELECT c.cid, c.s2 - 2 * fit.f * c.s1 + c.n * fit.f * fit.f AS e2, "
        "c.s4 - 4 * fit.f * c.s3 + 6 * fit.f * fit.f * c.s2 - 4 * fit.f * fit.f * fit.f * c.s1 "
        "+ c.n * fit.f * fit.f * fit.f * fit.f AS e4 FROM c JOIN fit USING (cid))",
        "meat AS (SELECT a.j AS i, b.j AS j, SUM(res.e2 * a.v * b.v) AS v FROM e a JOIN e b USING (cid) "
        "JOIN res USING (cid) GROUP BY 1, 2)",
        "gm AS (SELECT ginv.i, meat.j, SUM(ginv.v * meat.v) AS v FROM ginv JOIN meat ON meat.i = ginv.j GROUP BY 1, 2)",
        "cov AS (SELECT gm.i, SUM(gm.v * ginv.v) * (SELECT nn / (nn - p) FROM dims) AS v "
        "FROM gm JOIN ginv ON ginv.i = gm.j AND ginv.j = gm.i GROUP BY gm.i)",
        "fitstat AS (SELECT 1 - (SELECT SUM(e2) FROM res) / (SUM(s2) - SUM(s1) * SUM(s1) / SUM(n)) AS r2 FROM c)",
    ]
    if output == "bp":
        # Breusch-Pagan: e^2 regressed on X; LM = n R^2, F = (R^2/(p-1)) / ((1-R^2)/(n-p))
        parts += [
            "xe2 AS (SELECT e.j AS i, SUM(res.e2 * e.v) AS v FROM e JOIN res USING (cid) GROUP BY 1)",
            "gam AS (SELECT ginv.i, SUM(ginv.v * xe2.v) AS v FROM ginv JOIN xe2 ON xe2.i = ginv.j GROUP BY 1)",
            "aux AS (SELECT 1 - ((SELECT SUM(e4) FROM res) - (SELECT SUM(gam.v * xe2.v) FROM gam JOIN xe2 USING (i))) "
            "/ ((SELECT SUM(e4) FROM res) - (SELECT SUM(e2) FROM res) * (SELECT SUM(e2) FROM res) / (SELECT nn FROM dims)) "
            "AS r2)",
        ]
        body = (f"SELECT {r6('dims.nn * aux.r2')} AS lm, "
                f"{r6('(aux.r2 / (dims.p - 1)) / ((1 - aux.r2) / (dims.nn - dims.p))')} AS fvalue, "
                "CAST(dims.p - 1 AS INTEGER) AS df_model FROM dims, aux")
        if with_pvalues:
            parts += [
                "bpv AS (SELECT dims.nn * aux.r2 AS lm, (aux.r2 / (dims.p - 1)) / ((1 - aux.r2) / (dims.nn - dims.p)) "
                "AS fv, CAST(dims.p - 1 AS DOUBLE) AS k, dims.nn - dims.p AS d2 FROM dims, aux)",
                "chi_in AS (SELECT lm AS x, k FROM bpv)",
                chi2_sf_ctes("chi_in"),
                "bet_in AS (SELECT d2 / 2 AS a, k / 2 AS b, d2 / (d2 + k * fv) AS x FROM bpv)",
                betai_ctes("bet_in"),
            ]
            body = (f"SELECT {r6('bpv.lm')} AS lm, {r6('chi.v')} AS lm_pvalue, {r6('bpv.fv')} AS fvalue, "
                    f"{r6('bet.v')} AS f_pvalue, CAST(bpv.k AS INTEGER) AS df_model FROM bpv, chi, bet")
        return ",\n".join(parts) + "\n" + body
    if output == "stats":
        body = (f"SELECT dims.nn AS nobs, dims.p AS n_params, CAST(dims.nn - dims.p AS DOUBLE) AS df_resid, "
                f"{r6('fitstat.r2')} AS rsquared FROM dims, fitstat")
        return ",\n".join(parts) + "\n" + body
    if output == "chain":
        return ",\n".join(parts)
    if output == "table":
        parts.append("otab AS (SELECT nm.j AS id, nm.term, beta.b AS b, sqrt(cov.v) AS se "
                     "FROM nm JOIN beta ON beta.i = nm.j JOIN cov ON cov.i = nm.j)")
        return ",\n".join(parts) + coef_table_sql("otab")
    if output == "vif":
        # column i on the others: centred TSS * (G^-1)_ii; the intercept uses the uncentred one (n)
        body = (f"SELECT nm.term, {r6('tss.t * ginv.v')} AS vif, "
                "(tss.t * ginv.v > 10 AND nm.term <> 'Intercept') AS high "
                "FROM nm JOIN ginv ON ginv.i = nm.j AND ginv.j = nm.j JOIN "
                "(SELECT g.i, CASE WHEN g.i = 0 THEN (SELECT nn FROM dims) "
                " ELSE g.v - g0.v * g0.v / (SELECT nn FROM dims) END AS t "
                " FROM g JOIN g g0 ON g0.i = 0 AND g0.j = g.i WHERE g.j = g.i) tss ON tss.i = nm.j")
        return ",\n".join(parts) + "\n" + body
    body = (f"SELECT nm.term, {r6('beta.b')} AS coef, {r6('sqrt(cov.v)')} AS robust_se, "
            f"{r6('beta.b / sqrt(cov.v)')} AS z, {r6('beta.b - 1.959963984540054 * sqrt(cov.v)')} AS ci_low, "
            f"{r6('beta.b + 1.959963984540054 * sqrt(cov.v)')} AS ci_high, {r6('fitstat.r2')} AS rsquared "
            "FROM nm JOIN beta ON beta.i = nm.j JOIN cov ON cov.i = nm.j, fitstat")
    return ",\n".join(parts) + "\n" + body


__all__ = ["ols_hc1_sql", "_levels_values"]


def entry_selects(terms: list[dict], rel: str, id_col: str, lv: str = "lv") -> tuple[list[str], str]:
    """SELECTs of (id, j, v) design entries of relation ``rel`` (intercept
    included) against the level tables lv<k>; unknown levels give no entry
    (an all-zero indicator block). Returns (selects, width expression)."""
    sel = [f"SELECT {id_col}, 0, CAST(1.0 AS DOUBLE) FROM {rel}"]
    off = "1"
    for k, t in enumerate(terms):
        if t["kind"] == "factor":
            size = f"((SELECT COUNT(*) FROM {lv}{k}) - 1)"
            sel.append(f"SELECT x.{id_col}, {off} + lv.ord - 1, CAST(1.0 AS DOUBLE) FROM {rel} x JOIN {lv}{k} lv "
                       f"ON x.{t['col']} = lv.val WHERE lv.ord > 0")
        elif t["kind"] == "flag":
            size = "1"
            sel.append(f"SELECT {id_col}, {off}, CAST(1.0 AS DOUBLE) FROM {rel} WHERE {t['col']}")
        else:
            size = "1"
            sel.append(f"SELECT {id_col}, {off}, CAST({t['col']} AS DOUBLE) FROM {rel}")
        off = f"({off} + {size})"
    return sel, off


def logit_irls_sql(src: str, label: str, terms: list[dict], iterations: int = 14,
                   penalty: float = 0.0, output: str = "inference") -> str:
    """Unpenalised binomial logit by IRLS, unrolled: iteration t builds X'WX and
    X'(W eta + y - p) at the previous estimate and solves it by Gauss-Jordan in
    its own recursive CTE. Ends in a SELECT of term, coef, se, odds_ratio,
    or_ci_low, or_ci_high (6 places) plus the McFadden pseudo R^2 row-wise.
    Levels must all be observed (no empty design column)."""
    from .ctes import r6
    cols = [t["col"] for t in terms]
    parts = [f"c AS (SELECT ROW_NUMBER() OVER () AS cid, {', '.join(cols)}, CAST(COUNT(*) AS DOUBLE) AS n, "
             f"SUM(CASE WHEN {label} THEN 1.0 ELSE 0.0 END) AS pos FROM {src} GROUP BY {', '.join(cols)})"]
    entries, names = ["SELECT cid, 0 AS j, CAST(1.0 AS DOUBLE) AS v FROM c"], ["SELECT 0 AS j, 'Intercept' AS term"]
    off = "1"
    for k, t in enumerate(terms):
        if t["kind"] == "factor":
            parts.append(f"lv{k} AS ({t['levels_sql']})")
            size = f"((SELECT COUNT(*) FROM lv{k}) - 1)"
            entries.append(f"SELECT c.cid, {off} + lv.ord - 1, CAST(1.0 AS DOUBLE) FROM c JOIN lv{k} lv "
                           f"ON c.{t['col']} = lv.val WHERE lv.ord > 0")
            names.append(f"SELECT {off} + ord - 1, '{t['label']}[T.' || val || ']' FROM lv{k} WHERE ord > 0")
        elif t["kind"] == "flag":
            size = "1"
            entries.append(f"SELECT cid, {off}, CAST(1.0 AS DOUBLE) FROM c WHERE {t['col']}")
            names.append(f"SELECT {off}, '{t['col']}[T.True]'")
        else:
            size = "1"
            entries.append(f"SELECT cid, {off}, CAST({t['col']} AS DOUBLE) FROM c")
            names.append(f"SELECT {off}, '{t['col']}'")
        off = f"({off} + {size})"
    P = "(SELECT p FROM dims)"
    parts += [
        f"dims AS (SELECT CAST({off} AS INTEGER) AS p, (SELECT SUM(n) FROM c) AS nn)",
        "e AS (" + " UNION ALL ".join(entries) + ")",
        "nm AS (" + " UNION ALL ".join(names) + ")",
        "grid AS (SELECT a.range AS i, b.range AS j FROM dims, range(dims.p) a, range(dims.p) b)",
        f"b0 AS (SELECT range AS i, CAST(0.0 AS DOUBLE) AS b FROM range({P}))",
    ]
    for t in range(1, iterations + 2):
        parts += [
            f"eta{t} AS (SELECT e.cid, SUM(e.v * b.b) AS eta FROM e JOIN b{t - 1} b ON b.i = e.j GROUP BY e.cid)",
            f"w{t} AS (SELECT c.cid, c.n * q.p * (1 - q.p) AS w, "
            f"c.n * q.p * (1 - q.p) * q.eta + c.pos - c.n * q.p AS u FROM c JOIN "
            f"(SELECT cid, eta, 1 / (1 + exp(-eta)) AS p FROM eta{t}) q USING (cid))",
            f"g{t} AS (SELECT a.j AS i, b.j AS j, SUM(w.w * a.v * b.v) AS v FROM e a JOIN e b USING (cid) "
            f"JOIN w{t} w USING (cid) GROUP BY 1, 2)",
            f"r{t} AS (SELECT e.j AS i, SUM(w.u * e.v) AS v FROM e JOIN w{t} w USING (cid) GROUP BY 1)",
            f"aug{t} AS (SELECT a.i, list_concat(list_concat(a.row, [COALESCE(r.v, 0.0)]), "
            f"list_transform(range({P}), lambda q: CASE WHEN q = a.i THEN 1.0 ELSE 0.0 END)) AS r FROM "
            f"(SELECT grid.i, list(COALESCE(g.v, 0.0) + CASE WHEN grid.i = grid.j AND grid.i > 0 "
            f"THEN {float(penalty)} ELSE 0.0 END ORDER BY grid.j) AS row FROM grid LEFT JOIN g{t} g "
            f"ON g.i = grid.i AND g.j = grid.j GROUP BY grid.i) a LEFT JOIN r{t} r ON r.i = a.i)",
            f"gj{t}(k, i, r) AS (SELECT 0, i, r FROM aug{t} UNION ALL "
            f"SELECT k + 1, i, CASE WHEN i = k THEN list_transform(r, lambda x: x / r[k + 1]) "
            f"ELSE list_transform(list_zip(r, piv), lambda z: z[1] - r[k + 1] * z[2] / piv[k + 1]) END "
            f"FROM (SELECT k, i, r, max(CASE WHEN i = k THEN r END) OVER () AS piv FROM gj{t}) WHERE k < {P})",
            f"b{t} AS (SELECT i, r[{P} + 1] AS b FROM gj{t} WHERE k = {P})",
        ]
    T = iterations + 1
    parts += [
        f"se AS (SELECT i, sqrt(r[{P} + 2 + i]) AS s FROM gj{T} WHERE k = {P})",
        f"ll AS (SELECT SUM(c.pos * ln(q.p) + (c.n - c.pos) * ln(1 - q.p)) AS llf, "
        f"SUM(c.pos) / SUM(c.n) AS pbar FROM c JOIN (SELECT cid, 1 / (1 + exp(-eta)) AS p FROM eta{T}) q USING (cid))",
        "ll0 AS (SELECT SUM(c.pos * ln(ll.pbar) + (c.n - c.pos) * ln(1 - ll.pbar)) AS llnull FROM c, ll)",
    ]
    if output == "table":
        parts.append(f"ltab AS (SELECT nm.j AS id, nm.term, b.b AS b, se.s AS se FROM nm "
                     f"JOIN b{T - 1} b ON b.i = nm.j JOIN se ON se.i = nm.j)")
        return ",\n".join(parts) + coef_table_sql("ltab")
    if output == "chain":
        # CTEs only; the final estimates are b{T-1}, exposed as "coefs(i, b)"
        return ",\n".join(parts + [f"coefs AS (SELECT i, b FROM b{T - 1})"])
    if output == "coef":
        return ",\n".join(parts) + "\n" + (
            f"SELECT nm.term, split_part(nm.term, '[', 1) AS family, {r6('b.b')} AS coef "
            f"FROM nm JOIN b{T - 1} b ON b.i = nm.j")
    if output == "stats":
        return ",\n".join(parts) + "\n" + (
            f"SELECT dims.nn AS nobs, TRUE AS converged, {r6('1 - ll.llf / ll0.llnull')} AS pseudo_r2 FROM dims, ll, ll0")
    body = (f"SELECT nm.term, {r6('b.b')} AS coef, {r6('se.s')} AS se, {r6('exp(b.b)')} AS odds_ratio, "
            f"{r6('exp(b.b - 1.959963984540054 * se.s)')} AS or_ci_low, "
            f"{r6('exp(b.b + 1.959963984540054 * se.s)')} AS or_ci_high, "
            f"{r6('1 - ll.llf / ll0.llnull')} AS pseudo_r2 "
            f"FROM nm JOIN b{T - 1} b ON b.i = nm.j JOIN se ON se.i = nm.j, ll, ll0")
    return ",\n".join(parts) + "\n" + body


_CHAIN_NAMES = ["c", "dims", "e", "nm", "g", "xy", "grid", "aug", "aug2", "gj", "sol", "beta", "ginv", "fit",
                "res", "meat", "gm", "cov", "fitstat"]


def namespaced(sql: str, ns: str, n_levels: int = 10) -> str:
    """Prefix the CTE names of an ``ols_hc1_sql`` chain so two chains fit in one WITH."""
    import re
    names = _CHAIN_NAMES + [f"lv{k}" for k in range(n_levels)]
    return re.sub(r"\b(" + "|".join(sorted(names, key=len, reverse=True)) + r")\b", lambda m: ns + m.group(1), sql)


def erfc_ctes(src: str, ns: str = "") -> str:
    """CTEs computing erfc(x) for rows (id, x >= 0) of ``src`` into ``{ns}ec(id, v)``:
    Taylor series of erf below 1.5, the continued fraction of erfc above it
    (evaluated bottom-up to a fixed depth); ~1e-16 relative error."""
    return f"""{ns}ser(id, x, n, c, s) AS (
  SELECT id, x, 0, x, x FROM {src} WHERE x < 1.5
  UNION ALL
  SELECT id, x, n + 1, c * (-x * x) / (n + 1), s + c * (-x * x) / (n + 1) / (2 * (n + 1) + 1)
  FROM {ns}ser WHERE n < 60),
{ns}cf(id, x, k, t) AS (
  SELECT id, x, 300, x FROM {src} WHERE x >= 1.5
  UNION ALL
  SELECT id, x, k - 1, x + (CAST(k AS DOUBLE) / 2.0) / t FROM {ns}cf WHERE k > 0),
{ns}ec AS (SELECT id, 1 - 2 / sqrt(pi()) * s AS v FROM {ns}ser WHERE n = 60
           UNION ALL SELECT id, exp(-x * x) / sqrt(pi()) / t FROM {ns}cf WHERE k = 0)"""


def coef_table_sql(tab: str) -> str:
    """From ``tab(id, term, b, se)``: the coefficient table with two-sided
    normal p-values, as CTE ``ctab`` (raw b kept for ordering)."""
    from .ctes import r6
    return f""",
zv AS (SELECT id, abs(b / se) / sqrt(2) AS x FROM {tab}),
{erfc_ctes("zv")},
ctab AS (SELECT t.term, split_part(t.term, '[', 1) AS family, t.b AS b_raw,
           {r6('t.b')} AS coef, {r6('t.se')} AS se, {r6('t.b / t.se')} AS z, {r6('ec.v')} AS p_value,
           {r6('t.b - 1.959963984540054 * t.se')} AS ci_low, {r6('t.b + 1.959963984540054 * t.se')} AS ci_high,
           {r6('exp(t.b)')} AS odds_ratio, {r6('exp(t.b - 1.959963984540054 * t.se)')} AS or_ci_low,
           {r6('exp(t.b + 1.959963984540054 * t.se)')} AS or_ci_high,
           {r6('(exp(t.b) - 1) * 100')} AS approx_pct_change
         FROM {tab} t JOIN ec USING (id))"""


def chi2_sf_ctes(src: str, ns: str = "chi") -> str:
    """Q(k/2, x/2) for the one row (x, k) of ``src`` into ``{ns}(v)``: the
    regularised upper incomplete gamma by its series (x < a+1) or Lentz
    continued fraction, 500 fixed steps each."""
    return f"""{ns}_p AS (SELECT CAST(k AS DOUBLE) / 2 AS a, CAST(x AS DOUBLE) / 2 AS x FROM {src}),
{ns}_s(i, ap, del, s) AS (SELECT 0, a, 1 / a, 1 / a FROM {ns}_p WHERE x < a + 1
  UNION ALL SELECT i + 1, ap + 1, del * (SELECT x FROM {ns}_p) / (ap + 1), s + del * (SELECT x FROM {ns}_p) / (ap + 1)
  FROM {ns}_s WHERE i < 500),
{ns}_c(i, b, c, d, h) AS (SELECT 0, x + 1 - a, CAST(1e300 AS DOUBLE), 1 / (x + 1 - a), 1 / (x + 1 - a)
  FROM {ns}_p WHERE x >= a + 1
  UNION ALL SELECT i + 1, b + 2,
    (b + 2) + (-(i + 1) * ((i + 1) - (SELECT a FROM {ns}_p))) / c,
    1 / ((-(i + 1) * ((i + 1) - (SELECT a FROM {ns}_p))) * d + (b + 2)),
    h * (1 / ((-(i + 1) * ((i + 1) - (SELECT a FROM {ns}_p))) * d + (b + 2)))
      * ((b + 2) + (-(i + 1) * ((i + 1) - (SELECT a FROM {ns}_p))) / c)
  FROM {ns}_c WHERE i < 500),
{ns} AS (SELECT CASE WHEN x < a + 1 THEN 1 - (SELECT s FROM {ns}_s WHERE i = 500) * exp(-x + a * ln(x) - lgamma(a))
                     ELSE (SELECT h FROM {ns}_c WHERE i = 500) * exp(-x + a * ln(x) - lgamma(a)) END AS v
         FROM {ns}_p)"""


def betai_ctes(src: str, ns: str = "bet") -> str:
    """I_x(a, b) for the one row (a, b, x) of ``src`` into ``{ns}(v)``: Lentz
    continued fraction with the symmetry switch, 400 fixed steps."""
    return f"""{ns}_w AS (SELECT x < (a + 1) / (a + b + 2) AS direct,
              CASE WHEN x < (a + 1) / (a + b + 2) THEN a ELSE b END AS aa,
              CASE WHEN x < (a + 1) / (a + b + 2) THEN b ELSE a END AS bb,
              CASE WHEN x < (a + 1) / (a + b + 2) THEN x ELSE 1 - x END AS xx,
              exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(x) + b * ln(1 - x)) AS bt FROM {src}),
{ns}_f(m, c, d, h) AS (
  SELECT 0, CAST(1.0 AS DOUBLE), CAST(1 / (1 - (aa + bb) * xx / (aa + 1)) AS DOUBLE),
         CAST(1 / (1 - (aa + bb) * xx / (aa + 1)) AS DOUBLE) FROM {ns}_w
  UNION ALL
  SELECT m + 1, c2, d2, h * d1 * c1 * d2 * c2 FROM (
    SELECT m, h, d1, c1, 1 / (1 + e2 * d1) AS d2, 1 + e2 / c1 AS c2 FROM (
      SELECT m, h, 1 / (1 + e1 * d) AS d1, 1 + e1 / c AS c1, e2 FROM (
        SELECT m, c, d, h,
          (m + 1) * (w.bb - (m + 1)) * w.xx / ((w.aa - 1 + 2 * (m + 1)) * (w.aa + 2 * (m + 1))) AS e1,
          -(w.aa + (m + 1)) * (w.aa + w.bb + (m + 1)) * w.xx / ((w.aa + 2 * (m + 1)) * (w.aa + 1 + 2 * (m + 1))) AS e2
        FROM {ns}_f, {ns}_w w WHERE m < 400)))),
{ns} AS (SELECT CASE WHEN direct THEN bt * h / aa ELSE 1 - bt * h / aa END AS v FROM {ns}_w, {ns}_f WHERE m = 400)"""

"""Oracle SQL for the train-only profile queries."""

from __future__ import annotations

from flightlens import constants as C
from flightlens.params import FIXTURE

from .ctes import r6, split_ctes, with_

P = FIXTURE


def _summary(col: str, where: str = "") -> str:
    return with_(split_ctes(P), f"""
SELECT {col}, COUNT(*) AS n,
  {r6("AVG(CASE WHEN is_delayed THEN 1.0 ELSE 0.0 END)")} AS delay_rate,
  {r6("AVG(CASE WHEN arr_delay > 0 THEN arr_delay END)")} AS mean_arr_delay_if_late
FROM train {where} GROUP BY {col}""")


def _hist(value_sql: str, where: str, bins: int) -> str:
    """numpy histogram rules, written as SQL over the data's own range."""
    return with_(split_ctes(P), f""",
v AS (SELECT {value_sql} AS v FROM train WHERE {where}),
mm AS (SELECT MIN(v) AS lo0, MAX(v) AS hi0 FROM v WHERE v IS NOT NULL),
rg AS (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
              CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM mm),
st AS (SELECT lo, hi, (hi - lo) / {bins} AS step FROM rg),
b0 AS (SELECT v, lo, hi, step, CAST(floor((v - lo) / (hi - lo) * {float(bins)}) AS INTEGER) AS i0
       FROM v, st WHERE v IS NOT NULL),
b1 AS (SELECT *, CASE WHEN i0 = {bins} THEN {bins - 1} ELSE i0 END AS i1 FROM b0),
b2 AS (SELECT *, CASE WHEN v < (CASE WHEN i1 = {bins} THEN hi ELSE i1 * step + lo END) THEN i1 - 1 ELSE i1 END AS i2 FROM b1),
b3 AS (SELECT CASE WHEN v >= (CASE WHEN i2 + 1 = {bins} THEN hi ELSE (i2 + 1) * step + lo END) AND i2 <> {bins - 1}
                   THEN i2 + 1 ELSE i2 END AS bin FROM b2),
cnt AS (SELECT bin, COUNT(*) AS n FROM b3 GROUP BY bin),
allb AS (SELECT CAST(range AS INTEGER) AS bin FROM range({bins}))
SELECT allb.bin,
  {r6(f"CASE WHEN allb.bin = {bins} THEN hi ELSE allb.bin * step + lo END")} AS bin_lo,
  {r6(f"CASE WHEN allb.bin + 1 = {bins} THEN hi ELSE (allb.bin + 1) * step + lo END")} AS bin_hi,
  CAST(COALESCE(cnt.n, 0) AS BIGINT) AS n
FROM allb CROSS JOIN st LEFT JOIN cnt ON allb.bin = cnt.bin""")


def profile_sql() -> dict[str, str]:
    q = ", ".join(f"{r6(f'quantile_cont(arr_delay, {p / 100.0})')} AS p{f'{p:g}'.replace('.', '_')}"
                  for p in sorted(set([25.0, 50.0, 75.0] + [float(x) for x in C.QUANTILE_LEVELS_PCT])))
    top_ns = ", ".join(str(t) for t in C.COVERAGE_TOP_NS)
    labels = C.QUINTILE_LABELS
    qcase = (f"CASE WHEN distance < e0 THEN NULL WHEN distance <= e1 THEN '{labels[0]}' "
             f"WHEN distance <= e2 THEN '{labels[1]}' WHEN distance <= e3 THEN '{labels[2]}' "
             f"WHEN distance <= e4 THEN '{labels[3]}' WHEN distance <= e5 THEN '{labels[4]}' END")
    return {
        "eda_coverage": with_(split_ctes(P), """
SELECT COUNT(*) AS n_rows, MIN(flight_date) AS min_date, MAX(flight_date) AS max_date,
  COUNT(DISTINCT airline) AS n_airlines, COUNT(DISTINCT origin) AS n_origins, COUNT(DISTINCT dest) AS n_dests
FROM train"""),
        "eda_arr_delay_describe": with_(split_ctes(P), f"""
SELECT COUNT(arr_delay) AS count, {r6("AVG(arr_delay)")} AS mean, {r6("STDDEV_SAMP(arr_delay)")} AS std,
  {r6("MIN(arr_delay)")} AS min, {r6("MAX(arr_delay)")} AS max, {q}
FROM train"""),
        "eda_target_shares": with_(split_ctes(P), f"""
SELECT {r6("AVG(CASE WHEN arr_delay < 0 THEN 1.0 ELSE 0.0 END) * 100")} AS pct_early,
  {r6("AVG(CASE WHEN arr_delay = 0 THEN 1.0 ELSE 0.0 END) * 100")} AS pct_on_time,
  {r6("AVG(CASE WHEN arr_delay > 0 THEN 1.0 ELSE 0.0 END) * 100")} AS pct_late,
  {r6("AVG(CASE WHEN is_delayed THEN 1.0 ELSE 0.0 END) * 100")} AS pct_delayed15,
  COUNT(*) FILTER (WHERE arr_delay > 0) AS n_late
FROM train"""),
        "eda_by_dep_hour": _summary("dep_hour"),
        "eda_by_dow": _summary("dow"),
        "eda_by_month": _summary("month"),
        "eda_by_airline": _summary("airline"),
        "eda_by_holiday_flag": _summary("holiday_flag"),
        "eda_by_origin_top15": _summary(
            "origin", f"WHERE origin IN (SELECT origin FROM train GROUP BY origin "
                      f"ORDER BY COUNT(*) DESC, origin LIMIT {C.EDA_TOP_ORIGINS})"),
        "eda_profile_one_pass": with_(split_ctes(P), f"""
SELECT COUNT(*) AS n_rows, MIN(flight_date) AS min_date, MAX(flight_date) AS max_date,
  COUNT(DISTINCT airline) AS n_airlines, COUNT(DISTINCT origin) AS n_origins, COUNT(DISTINCT dest) AS n_dests,
  COUNT(arr_delay) AS count, {r6("AVG(arr_delay)")} AS mean, {r6("STDDEV_SAMP(arr_delay)")} AS std,
  {r6("MIN(arr_delay)")} AS min, {r6("MAX(arr_delay)")} AS max,
  {r6("AVG(CASE WHEN arr_delay < 0 THEN 1.0 ELSE 0.0 END) * 100")} AS pct_early,
  {r6("AVG(CASE WHEN arr_delay = 0 THEN 1.0 ELSE 0.0 END) * 100")} AS pct_on_time,
  {r6("AVG(CASE WHEN arr_delay > 0 THEN 1.0 ELSE 0.0 END) * 100")} AS pct_late,
  {r6("AVG(CASE WHEN is_delayed THEN 1.0 ELSE 0.0 END) * 100")} AS pct_delayed15,
  COUNT(*) FILTER (WHERE arr_delay > 0) AS n_late,
  {r6("AVG(CASE WHEN is_delayed THEN 1.0 ELSE 0.0 END)")} AS positive_rate,
  COUNT(*) FILTER (WHERE is_delayed) AS n_pos, COUNT(*) FILTER (WHERE NOT is_delayed) AS n_neg,
  {r6("corr(distance, arr_delay)")} AS corr_arr_delay,
  {r6("corr(distance, CASE WHEN is_delayed THEN 1.0 ELSE 0.0 END)")} AS corr_is_delayed, {q}
FROM train"""),
        "eda_summaries_one_pass": with_(split_ctes(P), f""",
m AS (SELECT *, CASE WHEN is_delayed THEN 1.0 ELSE 0.0 END AS d, CASE WHEN arr_delay > 0 THEN arr_delay END AS l FROM train),
u AS (
  SELECT 'dep_hour' AS feature, CAST(dep_hour AS VARCHAR) AS level, COUNT(*) AS n, AVG(d) AS r, AVG(l) AS ml FROM m GROUP BY dep_hour
  UNION ALL SELECT 'dow', dow, COUNT(*), AVG(d), AVG(l) FROM m GROUP BY dow
  UNION ALL SELECT 'month', CAST(month AS VARCHAR), COUNT(*), AVG(d), AVG(l) FROM m GROUP BY month
  UNION ALL SELECT 'airline', airline, COUNT(*), AVG(d), AVG(l) FROM m GROUP BY airline
  UNION ALL SELECT 'holiday_flag', CAST(holiday_flag AS VARCHAR), COUNT(*), AVG(d), AVG(l) FROM m GROUP BY holiday_flag
  UNION ALL SELECT * FROM (SELECT 'origin_top15', origin, COUNT(*), AVG(d), AVG(l) FROM m GROUP BY origin
                           ORDER BY COUNT(*) DESC, origin LIMIT {C.EDA_TOP_ORIGINS}))
SELECT feature, level, n, {r6("r")} AS delay_rate, {r6("ml")} AS mean_arr_delay_if_late FROM u"""),
        "eda_airport_coverage": with_(split_ctes(P), f""",
c AS (SELECT 'origin' AS feature, origin AS level, COUNT(*) AS n FROM train GROUP BY origin
      UNION ALL SELECT 'dest', dest, COUNT(*) FROM train GROUP BY dest),
r AS (SELECT feature, level, n,
        ROW_NUMBER() OVER (PARTITION BY feature ORDER BY n DESC, level) AS rk,
        SUM(n) OVER (PARTITION BY feature ORDER BY n DESC, level ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS covered,
        SUM(n) OVER (PARTITION BY feature) AS total,
        COUNT(*) OVER (PARTITION BY feature) AS n_levels FROM c),
t AS (SELECT CAST(unnest([{top_ns}]) AS INTEGER) AS top_n)
SELECT r.feature, t.top_n, r.n_levels, CAST(r.covered AS BIGINT) AS covered, CAST(r.total AS BIGINT) AS total,
  {r6("CAST(r.covered AS DOUBLE) / r.total * 100")} AS pct
FROM t JOIN r ON r.rk = least(t.top_n, r.n_levels)"""),
        "eda_distance_corr": with_(split_ctes(P), f"""
SELECT {r6("corr(distance, arr_delay)")} AS corr_arr_delay,
  {r6("corr(distance, CASE WHEN is_delayed THEN 1.0 ELSE 0.0 END)")} AS corr_is_delayed
FROM train"""),
        "eda_distance_quintiles": with_(split_ctes(P), f""",
e AS (SELECT quantile_cont(distance, 0.0) AS e0, quantile_cont(distance, 0.2) AS e1,
             quantile_cont(distance, 0.4) AS e2, quantile_cont(distance, 0.6) AS e3,
             quantile_cont(distance, 0.8) AS e4, quantile_cont(distance, 1.0) AS e5 FROM train),
b AS (SELECT {qcase} AS quintile, is_delayed, arr_delay, distance FROM train, e)
SELECT quintile, COUNT(*) AS n,
  {r6("AVG(CASE WHEN is_delayed THEN 1.0 ELSE 0.0 END)")} AS delay_rate,
  {r6("AVG(arr_delay)")} AS mean_arr_delay,
  {r6("MIN(distance)")} AS distance_min, {r6("MAX(distance)")} AS distance_max
FROM b WHERE quintile IS NOT NULL GROUP BY quintile"""),
        "eda_hist_arr_delay": _hist("arr_delay", "TRUE", C.HIST_BINS),
        "eda_hist_arr_delay_zoom": _hist("arr_delay", f"arr_delay BETWEEN {C.ZOOM_RANGE[0]} AND {C.ZOOM_RANGE[1]}",
                                         C.ZOOM_BINS),
        "eda_hist_late": _hist("arr_delay", "arr_delay > 0", C.HIST_BINS),
        "eda_hist_late_log": _hist("ln(arr_delay)", "arr_delay > 0", C.HIST_BINS),
        "eda_histograms_two_passes": "\nUNION ALL\n".join(
            f"SELECT '{name}' AS histogram, * FROM ({_hist(*spec)})" for name, spec in {
                "arr_delay": ("arr_delay", "TRUE", C.HIST_BINS),
                "arr_delay_zoom": ("arr_delay", f"arr_delay BETWEEN {C.ZOOM_RANGE[0]} AND {C.ZOOM_RANGE[1]}", C.ZOOM_BINS),
                "late": ("arr_delay", "arr_delay > 0", C.HIST_BINS),
                "late_log": ("ln(arr_delay)", "arr_delay > 0", C.HIST_BINS)}.items()),
        "eda_class_balance": with_(split_ctes(P), f"""
SELECT {r6("AVG(CASE WHEN is_delayed THEN 1.0 ELSE 0.0 END)")} AS positive_rate,
  COUNT(*) FILTER (WHERE is_delayed) AS n_pos, COUNT(*) FILTER (WHERE NOT is_delayed) AS n_neg,
  {r6("AVG(CASE WHEN is_delayed THEN 1.0 ELSE 0.0 END)")} AS no_skill_pr_auc
FROM train"""),
    }

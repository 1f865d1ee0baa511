"""Oracle SQL (DuckDB dialect) for every registered query that SQL can express."""

from __future__ import annotations

from flightlens import constants as C
from flightlens.params import FIXTURE

from .ctes import d, flights_ctes, model_ctes, r1, r2, r6, split_ctes, with_

P = FIXTURE
# the constants of the queries of these names
RELOADED = (1998, 3)
TOP_FLIGHT_NUMBERS = 2_000
DELAYED = "SUM(CASE WHEN is_delayed THEN 1 ELSE 0 END)"


def _measures(avg_col="dep_delay", avg_alias="avg_dep_delay_min", with_delayed=True):
    parts = ["COUNT(*) AS total_flights"]
    if with_delayed:
        parts.append(f"CAST({DELAYED} AS BIGINT) AS delayed_flights")
    parts.append(f"{r2(f'CAST({DELAYED} AS DOUBLE) / COUNT(*) * 100')} AS delay_rate_pct")
    parts.append(f"{r2(f'AVG({avg_col})')} AS {avg_alias}")
    return ", ".join(parts)


def _report(keys: str, having: str = "", tail: str = "", **kw) -> str:
    return with_(flights_ctes(), f"SELECT {keys}, {_measures(**kw)} FROM flights GROUP BY {keys} {having} {tail}")


def _dashboard_union() -> str:
    m = f"COUNT(*) AS total_flights, CAST({DELAYED} AS BIGINT) AS delayed_flights, " \
        f"{r2(f'CAST({DELAYED} AS DOUBLE) / COUNT(*) * 100')} AS delay_rate_pct"
    dep = r2("AVG(dep_delay)")
    arr = r2("AVG(arr_delay)")
    parts = [
        f"SELECT 'delay_by_airline' AS report, airline AS key, CAST(NULL AS INTEGER) AS month, {m}, {dep} AS avg_dep_delay_min, CAST(NULL AS DOUBLE) AS avg_arr_delay_min FROM flights GROUP BY airline",
        f"SELECT 'delay_by_month', CAST(month AS VARCHAR), NULL, {m}, {dep}, NULL FROM flights GROUP BY month",
        f"SELECT 'delay_by_dow', day_of_week, NULL, {m}, {dep}, NULL FROM flights GROUP BY day_of_week",
        f"SELECT * FROM (SELECT 'delay_by_airport', origin, NULL, {m}, {dep}, NULL FROM flights GROUP BY origin "
        f"HAVING COUNT(*) > {P.airport_min_flights} ORDER BY COUNT(*) DESC, origin LIMIT {P.airport_top_k})",
        f"SELECT 'worst_routes', route, NULL, {m}, {dep}, NULL FROM flights GROUP BY route HAVING COUNT(*) > {P.route_min_flights}",
        f"SELECT 'delay_heatmap_dow_month', day_of_week, month, COUNT(*), NULL, "
        f"{r2(f'CAST({DELAYED} AS DOUBLE) / COUNT(*) * 100')}, NULL, {arr} FROM flights GROUP BY day_of_week, month",
    ]
    return with_(flights_ctes(), "\nUNION ALL\n".join(parts))


def oracle_sql() -> dict[str, str]:
    hour_minutes = "CASE WHEN scheduled_dep_time = 2400 THEN 0 ELSE scheduled_dep_time END"
    out = {
        "clean_flights": with_(flights_ctes(), "SELECT * FROM flights"),
        "raw_csv_roundtrip": with_(flights_ctes(), "SELECT * FROM flights"),
        "delay_bucket_counts": with_(flights_ctes(), f"""
SELECT delay_bucket, COUNT(*) AS n_flights,
  CAST(CASE delay_bucket {' '.join(f"WHEN '{b}' THEN {i + 1}" for i, b in enumerate(C.DELAY_BUCKET_LABELS))} END AS INTEGER) AS bucket_order
FROM flights GROUP BY delay_bucket"""),
        "delay_by_airline": _report("airline"),
        "delay_by_month": _report("month"),
        "delay_by_dow": _report("day_of_week"),
        "delay_by_airport": _report("origin", f"HAVING COUNT(*) > {P.airport_min_flights}",
                                    f"ORDER BY total_flights DESC, origin LIMIT {P.airport_top_k}"),
        "worst_routes": _report("route", f"HAVING COUNT(*) > {P.route_min_flights}"),
        "delay_heatmap_dow_month": _report("day_of_week, month", avg_col="arr_delay",
                                           avg_alias="avg_arr_delay_min", with_delayed=False),
        "dashboard_one_pass": _dashboard_union(),
        "delay_by_airline_export": with_(flights_ctes(), f"""
SELECT airline, COUNT(*) AS total_flights,
  {r2(f'CAST({DELAYED} AS DOUBLE) / COUNT(*) * 100')} AS delay_rate_pct,
  {r1('AVG(dep_delay)')} AS avg_dep_delay_min, {r1('AVG(arr_delay)')} AS avg_arr_delay_min
FROM flights GROUP BY airline"""),
        "worst_routes_export": with_(flights_ctes(), f"""
SELECT route, origin, dest, COUNT(*) AS total_flights,
  {r2(f'CAST({DELAYED} AS DOUBLE) / COUNT(*) * 100')} AS delay_rate_pct,
  {r1('AVG(arr_delay)')} AS avg_arr_delay_min
FROM flights GROUP BY route, origin, dest HAVING COUNT(*) >= {P.route_min_flights}
ORDER BY delay_rate_pct DESC, route LIMIT 25"""),
        "delay_heatmap_export": with_(flights_ctes(), f"""
SELECT day_of_week, month, COUNT(*) AS total_flights,
  {r2(f'CAST({DELAYED} AS DOUBLE) / COUNT(*) * 100')} AS delay_rate_pct,
  {r1('AVG(arr_delay)')} AS avg_arr_delay_min
FROM flights GROUP BY day_of_week, month"""),
        "model_table": with_(model_ctes(P), "SELECT * FROM model"),
        "prep_report": with_(model_ctes(P), f"""
SELECT
  COUNT(*) AS rows_loaded,
  COUNT(*) FILTER (WHERE cancelled) AS removed_cancelled,
  COUNT(*) FILTER (WHERE NOT cancelled AND diverted) AS removed_diverted,
  COUNT(*) FILTER (WHERE NOT cancelled AND NOT diverted) AS rows_remaining,
  COUNT(*) FILTER (WHERE NOT cancelled AND NOT diverted AND scheduled_dep_time = 2400) AS remapped_2400,
  (SELECT COUNT(*) FROM model WHERE holiday_flag) AS holiday_rows,
  {r6("(SELECT AVG(CASE WHEN holiday_flag THEN 1.0 ELSE 0.0 END) FROM model)")} AS holiday_share,
  COUNT(*) FILTER (WHERE NOT cancelled AND NOT diverted AND arr_delay IS NULL) AS bad_null_arr_delay,
  COUNT(*) FILTER (WHERE NOT cancelled AND NOT diverted AND NOT (({hour_minutes}) // 100 BETWEEN 0 AND 23)) AS bad_dep_hour,
  COUNT(*) FILTER (WHERE NOT cancelled AND NOT diverted AND dayname(flight_date) NOT IN ({', '.join(f"'{x}'" for x in C.DOW_ORDER)})) AS bad_dow,
  COUNT(*) FILTER (WHERE NOT cancelled AND NOT diverted AND month(flight_date) <> month) AS bad_month
FROM flights"""),
        "split_summary": with_(split_ctes(P), f"""
SELECT 'train' AS split, COUNT(*) AS n_rows, MIN(flight_date) AS min_date, MAX(flight_date) AS max_date,
  {r6("AVG(CASE WHEN is_delayed THEN 1.0 ELSE 0.0 END)")} AS delay_rate FROM train
UNION ALL
SELECT 'test', COUNT(*), MIN(flight_date), MAX(flight_date),
  {r6("AVG(CASE WHEN is_delayed THEN 1.0 ELSE 0.0 END)")} FROM test
UNION ALL
-- the seeded sample is the whole train table while train has at most sample_size rows
SELECT 'train_sample', COUNT(*), MIN(flight_date), MAX(flight_date),
  {r6("AVG(CASE WHEN is_delayed THEN 1.0 ELSE 0.0 END)")} FROM train
HAVING COUNT(*) <= {P.sample_size}"""),
    }
    p = P
    out["model_windows"] = with_(split_ctes(P), "\nUNION ALL\n".join(
        f"SELECT '{name}' AS slice, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE is_delayed) AS n_delayed, "
        f"MIN(flight_date) AS min_date, MAX(flight_date) AS max_date FROM {table} WHERE {cond}"
        for name, table, cond in (
            ("train", "train", "true"), ("test", "test", "true"), ("fit", "train", f"flight_date < {d(p.fit_cutoff)}"),
            ("validation", "train", f"flight_date BETWEEN {d(p.fit_cutoff)} AND {d(p.validation_end)}"),
            ("recalibration", "test", f"flight_date BETWEEN {d(p.split_date)} AND {d(p.recal_end)}"),
            ("remainder", "test", f"flight_date >= {d(p.remainder_start)}"))))
    year, month = RELOADED
    out["month_reload"] = with_(model_ctes(P), f"""
SELECT year(flight_date)::INTEGER AS year, month(flight_date)::INTEGER AS month, COUNT(*) AS n_rows,
  COUNT(*) FILTER (WHERE isodow(flight_date) >= 6) AS n_weekend,
  SUM(CASE WHEN {(again := f"(year(flight_date) = {year} AND month(flight_date) = {month})")} THEN 2 * distance ELSE distance END)::BIGINT AS distance
FROM model WHERE NOT ({again} AND isodow(flight_date) >= 6) GROUP BY 1, 2""")
    out["interval_table_flights"] = with_(flights_ctes(), """,
span AS (SELECT CAST(o_orderdate AS DATE) AS a,
                CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 - 1 AS INTEGER) END AS b
         FROM orders WHERE day(o_orderdate) IN (3, 17)),
inside AS (SELECT DISTINCT f.flight_date FROM (SELECT DISTINCT flight_date FROM flights) f JOIN (SELECT DISTINCT a, b FROM span) s
           ON f.flight_date BETWEEN s.a AND s.b)
SELECT year(f.flight_date)::INTEGER AS year, f.month, COUNT(*) AS n_flights, COUNT(i.flight_date) AS n_inside,
  COUNT(i.flight_date) FILTER (WHERE is_delayed) AS n_inside_delayed
FROM flights f LEFT JOIN inside i ON f.flight_date = i.flight_date GROUP BY 1, 2""")
    out["flight_number_levels"] = with_(flights_ctes(), f""",
top AS (SELECT flight_number FROM (SELECT flight_number, COUNT(*) AS n FROM flights GROUP BY 1) ORDER BY n DESC, flight_number
        LIMIT {TOP_FLIGHT_NUMBERS})
SELECT CASE WHEN flight_number IN (SELECT flight_number FROM top) THEN CAST(flight_number AS VARCHAR) ELSE 'OTHER' END AS folded,
  COUNT(*) AS n_flights, COUNT(*) FILTER (WHERE is_delayed) AS n_delayed
FROM flights GROUP BY 1""")
    out["quarantined_flights"] = with_(flights_ctes(), """,
rule AS (SELECT row_number() OVER () AS row_no, unnest([
    CASE WHEN cancelled THEN 'cancelled' END, CASE WHEN diverted THEN 'diverted' END,
    CASE WHEN arr_delay IS NULL THEN 'no_arrival_delay' END, CASE WHEN arr_delay > 180 THEN 'over_three_hours_late' END,
    CASE WHEN scheduled_dep_time = 2400 THEN 'scheduled_at_2400' END, CASE WHEN origin = dest THEN 'same_airport' END]) AS rule
  FROM flights),
n AS (SELECT *, COUNT(*) OVER (PARTITION BY row_no) AS broken FROM rule WHERE rule IS NOT NULL)
SELECT rule, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE broken = 1) AS n_only FROM n GROUP BY rule""")
    for n in ("delay_by_airline", "delay_by_month", "delay_by_dow", "delay_by_airport", "worst_routes",
              "delay_heatmap_dow_month"):
        out[f"sql_{n}"] = out[n]
    out["published_delay_by_airline"] = out["delay_by_airline"]
    out["exported_worst_routes"] = out["worst_routes_export"]
    from .models_sql import models_sql
    from .profile_sql import profile_sql
    out.update(profile_sql())
    out.update(models_sql())
    return out

"""The six dashboard reports as Spark SQL over the ``flights_2024`` view.

Same semantics as the DataFrame versions in ``operators.reports``:
SAFE_DIVIDE -> try_divide, ROUND -> half away from zero decided on the
decimal text (DECIMAL(38,10)), ORDER BY with a key tie-break so a LIMIT
keeps fixed rows. Each statement plans to scan (pruned) -> partial
HashAggregate -> one exchange on the key -> final HashAggregate -> sort /
TakeOrderedAndProject.
"""

from __future__ import annotations

from .. import constants as C

DELAYED = "SUM(CASE WHEN is_delayed THEN 1 ELSE 0 END)"


def _round2(x: str) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38,10)), 2) AS DOUBLE)"


def _measures(avg_col: str = "dep_delay", avg_alias: str = "avg_dep_delay_min",
              with_delayed: bool = True) -> str:
    parts = ["COUNT(*) AS total_flights"]
    if with_delayed:
        parts.append(f"CAST({DELAYED} AS BIGINT) AS delayed_flights")
    parts.append(f"{_round2(f'try_divide({DELAYED}, COUNT(*)) * 100')} AS delay_rate_pct")
    parts.append(f"{_round2(f'AVG({avg_col})')} AS {avg_alias}")
    return ",\n  ".join(parts)


def report_sql(view: str = "flights_2024", airport_min_flights: int = C.AIRPORT_MIN_FLIGHTS,
               airport_top_k: int = C.AIRPORT_TOP_K,
               route_min_flights: int = C.ROUTE_MIN_FLIGHTS) -> dict[str, str]:
    m = _measures()
    dow_case = " ".join(f"WHEN '{d}' THEN {i + 1}" for i, d in enumerate(C.DOW_ORDER))
    return {
        "delay_by_airline": f"""
SELECT airline,
  {m}
FROM {view}
GROUP BY airline
ORDER BY delay_rate_pct DESC, airline""",
        "delay_by_month": f"""
SELECT month,
  {m}
FROM {view}
GROUP BY month
ORDER BY month""",
        "delay_by_dow": f"""
SELECT day_of_week,
  {m}
FROM {view}
GROUP BY day_of_week
ORDER BY CASE day_of_week {dow_case} END""",
        "delay_by_airport": f"""
SELECT origin,
  {m}
FROM {view}
GROUP BY origin
HAVING total_flights > {airport_min_flights}
ORDER BY total_flights DESC, origin
LIMIT {airport_top_k}""",
        "worst_routes": f"""
SELECT route,
  {m}
FROM {view}
GROUP BY route
HAVING total_flights > {route_min_flights}
ORDER BY delay_rate_pct DESC, route""",
        "delay_heatmap_dow_month": f"""
SELECT day_of_week, month,
  {_measures('arr_delay', 'avg_arr_delay_min', with_delayed=False)}
FROM {view}
GROUP BY day_of_week, month
ORDER BY month, day_of_week""",
    }

"""DuckDB SQL for the stage chain, written independently of the Spark code.

Used only as the correctness oracle: the driver runs these statements over
the shipped tables (registered as views under their own names) and compares
with the Spark results. Where the Spark code uses one formulation, the SQL
here prefers another (isodow for weekends, BETWEEN windows for holidays,
integer division for the hour) so the check is not a copy of itself.
"""

from __future__ import annotations

import datetime as dt

from flightlens import constants as C
from flightlens.params import FIXTURE, StudyParams
from flightlens.sources.fixture import RAW_FLIGHTS_SQL


def r6(x: str) -> str:
    """Round a double to 6 places on the decimal text (same rule as the Spark side)."""
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38,10)), 6) AS DOUBLE)"


def r1(x: str) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38,10)), 1) AS DOUBLE)"


def r2(x: str) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38,10)), 2) AS DOUBLE)"


def d(x: str) -> str:
    return f"DATE '{x}'"


def _holiday_predicate(col: str, p: StudyParams) -> str:
    parts = []
    for iso in p.holidays:
        h = dt.date.fromisoformat(iso)
        lo = h - dt.timedelta(days=p.holiday_window_days)
        hi = h + dt.timedelta(days=p.holiday_window_days)
        parts.append(f"({col} BETWEEN DATE '{lo}' AND DATE '{hi}')")
    return "(" + " OR ".join(parts) + ")"


def _bucket_case(x: str) -> str:
    e = C.DELAY_BUCKET_EDGES
    L = C.DELAY_BUCKET_LABELS
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= {e[0]} THEN '{L[0]}' "
            f"WHEN {x} <= {e[1]} THEN '{L[1]}' WHEN {x} <= {e[2]} THEN '{L[2]}' "
            f"WHEN {x} <= {e[3]} THEN '{L[3]}' ELSE '{L[4]}' END")


def flights_ctes() -> str:
    causes = ",\n    ".join(f"COALESCE({src}, CAST(0 AS DOUBLE)) AS {dst}"
                            for src, dst in C.RAW_COLUMN_MAP.items() if dst in C.CAUSE_COLUMNS)
    return f"""raw AS ({RAW_FLIGHTS_SQL}),
flights AS (
  SELECT
    FL_DATE AS flight_date, OP_UNIQUE_CARRIER AS airline, OP_CARRIER_FL_NUM AS flight_number,
    ORIGIN AS origin, DEST AS dest, CRS_DEP_TIME AS scheduled_dep_time, DEP_TIME AS actual_dep_time,
    DEP_DELAY AS dep_delay, DEP_DELAY_NEW AS dep_delay_min, CRS_ARR_TIME AS scheduled_arr_time,
    ARR_TIME AS actual_arr_time, ARR_DELAY AS arr_delay, ARR_DELAY_NEW AS arr_delay_min,
    CANCELLED <> 0 AS cancelled, CANCELLATION_CODE AS cancellation_code, DIVERTED <> 0 AS diverted,
    AIR_TIME AS air_time, DISTANCE AS distance,
    {causes},
    ORIGIN || '-' || DEST AS route,
    dayname(FL_DATE) AS day_of_week,
    CAST(month(FL_DATE) AS INTEGER) AS month,
    isodow(FL_DATE) >= 6 AS is_weekend,
    COALESCE(ARR_DELAY_NEW >= 15, false) AS is_delayed,
    {_bucket_case('ARR_DELAY_NEW')} AS delay_bucket
  FROM raw
)"""


def model_ctes(p: StudyParams = FIXTURE) -> str:
    return flights_ctes() + f""",
model AS (
  SELECT flight_date, airline, origin, dest,
    CAST((CASE WHEN scheduled_dep_time = 2400 THEN 0 ELSE scheduled_dep_time END) // 100 AS INTEGER) AS dep_hour,
    dayname(flight_date) AS dow,
    month,
    {_holiday_predicate('flight_date', p)} AS holiday_flag,
    distance, arr_delay, is_delayed
  FROM flights
  WHERE NOT cancelled AND NOT diverted
)"""


def split_ctes(p: StudyParams = FIXTURE) -> str:
    return model_ctes(p) + f""",
train AS (SELECT * FROM model WHERE flight_date < {d(p.split_date)}),
test AS (SELECT * FROM model WHERE flight_date >= {d(p.split_date)})"""


def with_(ctes: str, body: str) -> str:
    """WITH <ctes> <body>; a body starting with ',' adds more CTEs first."""
    if body.lstrip().startswith(","):
        return f"WITH {ctes}{body}"
    return f"WITH {ctes}\n{body}"

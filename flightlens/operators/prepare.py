"""Clean table -> leakage-safe model table (11 columns).

Filters (not cancelled, then not diverted), departure hour with the 2400
convention, ordered weekday, month cross-check, holiday window flag.
Narrow transformations only; the counts and checks of the stage are one
aggregation job (``prep_report``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import columns as X
from ..params import StudyParams
from .checks import DataQualityError, quarantine
from .intervals import flag_in_intervals, holiday_windows


def _holiday_flagged(flights: DataFrame, params: StudyParams, holidays: DataFrame | None) -> DataFrame:
    """``flights`` with ``holiday_flag``: near a holiday of the table ``holidays`` (``day``), or of the parameters' list."""
    if holidays is None:
        return flights.withColumn("holiday_flag", X.holiday_flag("flight_date", params.holidays, params.holiday_window_days))
    return flag_in_intervals(flights, "flight_date", holiday_windows(holidays, params.holiday_window_days), "holiday_flag")


def model_table(flights: DataFrame, params: StudyParams, holidays: DataFrame | None = None) -> DataFrame:
    src = flights.select(*C.MODEL_SOURCE_COLUMNS)
    kept = _holiday_flagged(src.filter(~F.col("cancelled")).filter(~F.col("diverted")), params, holidays)
    d = F.col("flight_date")
    out = kept.select(
        "flight_date", "airline", "origin", "dest",
        X.dep_hour("scheduled_dep_time").alias("dep_hour"),
        X.day_name(d).alias("dow"),
        F.col("month").cast("int").alias("month"),
        "holiday_flag",
        "distance", "arr_delay", "is_delayed",
    )
    assert list(out.columns) == C.MODEL_COLUMNS
    leaked = set(out.columns) & set(C.LEAKAGE_COLUMNS)
    if leaked:
        raise DataQualityError(f"leakage columns in model table: {sorted(leaked)}")
    return out


def prep_rules() -> dict[str, Column]:
    """Rule -> true for a row of the clean table that would break it in the model table."""
    kept = ~F.col("cancelled") & ~F.col("diverted")
    hour, d = X.dep_hour("scheduled_dep_time"), F.col("flight_date")
    return {
        "bad_null_arr_delay": kept & F.col("arr_delay").isNull(),
        "bad_dep_hour": kept & (hour.isNull() | ~hour.between(0, 23)),
        "bad_dow": kept & ~F.coalesce(X.day_name(d).isin(C.DOW_ORDER), F.lit(False)),
        "bad_month": kept & ~F.coalesce(F.month(d) == F.col("month"), F.lit(False)),
    }


def prep_report(flights: DataFrame, params: StudyParams, holidays: DataFrame | None = None) -> DataFrame:
    """One row: rows removed per filter step, rows kept, the 2400 remaps,
    holiday-flag count and share, and the violation count of every check."""
    c, dv = F.col("cancelled"), F.col("diverted")
    kept = ~c & ~dv
    t, hol = F.col("scheduled_dep_time"), F.col("holiday_flag")
    n_kept = F.count_if(kept)
    return _holiday_flagged(flights, params, holidays).agg(
        F.count(F.lit(1)).alias("rows_loaded"),
        F.count_if(c).alias("removed_cancelled"),
        F.count_if(~c & dv).alias("removed_diverted"),   # counted after the first filter
        n_kept.alias("rows_remaining"),
        F.count_if(kept & (t == 2400)).alias("remapped_2400"),
        F.count_if(kept & hol).alias("holiday_rows"),
        F.try_divide(F.count_if(kept & hol).cast("double"), n_kept.cast("double")).alias("holiday_share"),
        *[F.count_if(rule).alias(name) for name, rule in prep_rules().items()],
    )


def check_prep(report_row, flights: DataFrame, path: str) -> None:
    """Stop if the report counts violations; the rows are written to ``path`` with the rules they break."""
    if any(report_row[name] for name in prep_rules()):
        rules = prep_rules()
        bad = flights.filter(reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in rules.values())))
        quarantine(bad, rules, path).raise_if_any("prepare")

"""Column expressions shared by every stage.

All of them are built-in Catalyst expressions, so they stay inside
whole-stage codegen; none of them needs Python at run time.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def col_or(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_away_round(c: str | Column, digits: int) -> Column:
    """Decimal rounding, half away from zero, decided on 10 decimal places.

    A double is first fixed to DECIMAL(38,10) so that ties such as 1.005 are
    decided on their decimal text and not on the binary neighbour; the
    result goes back to DOUBLE. The same expression in any SQL engine gives
    the same value.
    """
    return F.round(col_or(c).cast("decimal(38,10)"), digits).cast("double")


def safe_rate_pct(num: Column, den: Column) -> Column:
    """NULL instead of an error when the denominator is 0, times 100."""
    return F.try_divide(num.cast("double"), den.cast("double")) * F.lit(100.0)


def flag_to_bool(c: str | Column) -> Column:
    """0/1 number (or its text) to boolean; NULL stays NULL and is checked upstream."""
    return col_or(c).cast("double") != F.lit(0.0)


def route(origin: str | Column = "origin", dest: str | Column = "dest") -> Column:
    # concat, not concat_ws: a missing airport code gives a missing route
    return F.concat(col_or(origin), F.lit("-"), col_or(dest))


def day_name(d: str | Column) -> Column:
    return F.date_format(col_or(d), "EEEE")


def is_weekend(d: str | Column) -> Column:
    # weekday(): Monday = 0 .. Sunday = 6
    return F.weekday(col_or(d)) >= F.lit(5)


def is_delayed(arr_delay_min: str | Column = "arr_delay_min") -> Column:
    # a missing delay (cancelled / diverted) counts as not delayed
    return F.coalesce(col_or(arr_delay_min) >= F.lit(C.DELAY_THRESHOLD_MIN), F.lit(False))


def right_closed_bins(x: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """``pd.cut`` semantics: (-inf, e0], (e0, e1], ..., (e_last, inf); NULL in, NULL out."""
    assert len(labels) == len(edges) + 1
    x = col_or(x)
    expr = F.when(x.isNull(), F.lit(None).cast("string"))
    for e, lab in zip(edges, labels[:-1]):
        expr = expr.when(x <= F.lit(e), F.lit(lab))
    return expr.otherwise(F.lit(labels[-1]))


def delay_bucket(arr_delay_min: str | Column = "arr_delay_min") -> Column:
    return right_closed_bins(arr_delay_min, C.DELAY_BUCKET_EDGES, C.DELAY_BUCKET_LABELS)


def dep_hour(scheduled_dep_time: str | Column = "scheduled_dep_time") -> Column:
    """HHMM -> hour, with the one schedule convention 2400 meaning midnight."""
    t = col_or(scheduled_dep_time)
    t = F.when(t == F.lit(2400), F.lit(0)).otherwise(t)
    return F.floor(t / F.lit(100)).cast("int")


def dep_hour_bin(h: str | Column = "dep_hour") -> Column:
    """Six day segments over (-1,4], (4,7], (7,11], (11,15], (15,19], (19,23]; outside -> NULL."""
    h = col_or(h)
    expr = F.when(h.isNull() | (h <= F.lit(-1)), F.lit(None).cast("string"))
    for e, lab in zip(C.DEP_HOUR_BIN_EDGES, C.DEP_HOUR_BIN_LABELS):
        expr = expr.when(h <= F.lit(e), F.lit(lab))
    return expr.otherwise(F.lit(None).cast("string"))


def level_ordinal(c: str | Column, levels: Sequence[str]) -> Column:
    """1-based position of the value in an ordered level list; unknown -> NULL."""
    arr = F.array(*[F.lit(v) for v in levels])
    return F.nullif(F.array_position(arr, col_or(c)), F.lit(0)).cast("int")


def top_or_other(c: str | Column, top: Sequence[str], other: str = C.OTHER_LEVEL) -> Column:
    c = col_or(c)
    return F.when(c.isin(list(top)), c).otherwise(F.lit(other))


def holiday_window_dates(holidays: Sequence[str], days: int) -> list[_dt.date]:
    """Every calendar date within +/- ``days`` of a holiday (bounded by the calendar)."""
    out = set()
    for iso in holidays:
        h = _dt.date.fromisoformat(iso)
        for k in range(-days, days + 1):
            out.add(h + _dt.timedelta(days=k))
    return sorted(out)


def holiday_flag(d: str | Column, holidays: Sequence[str], days: int) -> Column:
    """Date within +/- days of any holiday: one hash-set lookup per row (InSet)."""
    dates = holiday_window_dates(holidays, days)
    return F.coalesce(col_or(d).isin([F.lit(x) for x in dates]), F.lit(False))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

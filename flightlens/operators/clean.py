"""Raw flight records -> typed, quality-checked clean table (29 columns).

Narrow transformations only: rename, type fixes, cause fill and six derived
columns. Nothing here shuffles, so the stage scales with the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions import columns as X
from .checks import require_none

# Types of the 23 clean columns (the raw files carry text; the typed fixture
# carries numbers -- both are coerced to these).
CLEAN_TYPES: dict[str, str] = {
    "flight_date": "date",
    "airline": "string",
    "flight_number": "int",
    "origin": "string",
    "dest": "string",
    "scheduled_dep_time": "int",
    "actual_dep_time": "double",
    "dep_delay": "double",
    "dep_delay_min": "double",
    "scheduled_arr_time": "int",
    "actual_arr_time": "double",
    "arr_delay": "double",
    "arr_delay_min": "double",
    "cancelled": "boolean",
    "cancellation_code": "string",
    "diverted": "boolean",
    "air_time": "double",
    "distance": "double",
    "carrier_delay": "double",
    "weather_delay": "double",
    "nas_delay": "double",
    "security_delay": "double",
    "late_aircraft_delay": "double",
}

DERIVED_COLUMNS = ["route", "day_of_week", "month", "is_weekend", "is_delayed", "delay_bucket"]
CLEAN_COLUMNS = list(C.RAW_COLUMN_MAP.values()) + DERIVED_COLUMNS

# FIXED VALUES -- accepted text forms of the raw flight date, each with a character that any text of this form has:
# a form is tried only on texts that hold it, as a failed attempt costs many times a good one
DATE_FORMATS = {"M/d/yyyy h:mm:ss a": ":", "yyyy-MM-dd": "-", "M/d/yyyy": "/"}


def _parse_date(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("date")
    s = F.trim(c.cast("string"))
    parsed = [F.when(F.contains(s, F.lit(mark)), F.try_to_timestamp(s, F.lit(fmt))) for fmt, mark in DATE_FORMATS.items()]
    return F.coalesce(*parsed).cast("date")


def _coerce(c: Column, dtype: T.DataType, target: str) -> Column:
    if target == "string":
        return c.cast("string")
    if isinstance(dtype, T.StringType):
        # text from CSV: blank -> NULL, numbers like "5.00" -> int via double
        s = F.nullif(F.trim(c), F.lit(""))
        if target == "int":
            return s.try_cast("double").try_cast("int")
        return s.try_cast(target)
    return c.cast(target)


def _typed(raw: DataFrame) -> dict[str, tuple[Column | None, Column]]:
    """Clean column -> (source column or None, typed column)."""
    fields = {f.name: f.dataType for f in raw.schema.fields}
    out = {}
    for src, dst in C.RAW_COLUMN_MAP.items():
        # a flag keeps its 0/1 number here; clean_flights makes it a boolean
        target = "double" if CLEAN_TYPES[dst] == "boolean" else CLEAN_TYPES[dst]
        if src not in fields:
            out[dst] = (None, F.lit(None).cast(target))
            continue
        c, kind = F.col(f"`{src}`"), fields[src]
        out[dst] = (c, _parse_date(c, kind) if dst == "flight_date" else _coerce(c, kind, target))
    return out


def rename_and_type(raw: DataFrame) -> DataFrame:
    """Keep the 23 mapped columns by name (absent ones become NULL) and fix types."""
    return raw.select(*[typed.alias(dst) for dst, (_, typed) in _typed(raw).items()])


def _always_typed(kind: T.DataType, target: str) -> bool:
    """Does every value of this source type have a typed form? Then none can be lost and none need be looked at."""
    if target == "string":
        return True
    if target == "date":
        return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))
    return target in ("int", "double") and isinstance(kind, (T.IntegralType, T.FloatType, T.DoubleType))


def _doubtful(raw: DataFrame) -> dict[str, Column]:
    """Clean column -> source text, for the columns whose typing can lose a value."""
    kinds, out = {f.name: f.dataType for f in raw.schema.fields}, {}
    for src, (dst, (source, _)) in zip(C.RAW_COLUMN_MAP, _typed(raw).items()):
        target = "double" if CLEAN_TYPES[dst] == "boolean" else CLEAN_TYPES[dst]
        if source is not None and not _always_typed(kinds[src], target):
            out[dst] = source.cast("string")
    return out


def _lost(columns: list[str]) -> Column:
    """Values of a row that are not blank in the source (``_text_<column>``) but have no typed form."""
    n = F.lit(0)
    for c in columns:
        n = n + F.when(F.col(c).isNull() & (F.trim(f"_text_{c}") != ""), 1).otherwise(0)
    return n


def clean_flights(raw: DataFrame, observation: Observation | None = None) -> DataFrame:
    """Raw frame (source column names) -> the 29-column clean table.

    Pure and lazy. With an ``observation`` the write of the result also counts
    what ``check_clean`` judges: no second scan of the text or of the table.
    """
    if observation is None:
        typed = rename_and_type(raw)
    else:
        # the texts go along to the counts: typing and comparing in one expression makes a method too large to be compiled
        texts = _doubtful(raw)
        typed = raw.select(*[t.alias(c) for c, (_, t) in _typed(raw).items()],
                           *[text.alias(f"_text_{c}") for c, text in texts.items()]).observe(
            observation,
            F.count_if(F.col("flight_date").isNull()).alias("flight_date_unparsed"),
            # a missing flag would otherwise silently count as not cancelled / diverted
            F.count_if(F.col("cancelled").isNull()).alias("cancelled_missing"),
            F.count_if(F.col("diverted").isNull()).alias("diverted_missing"),
            F.sum(_lost(list(texts))).alias("values_unreadable"))
    typed = typed.fillna(0.0, subset=C.CAUSE_COLUMNS)
    d = F.col("flight_date")
    return typed.select(
        *[X.flag_to_bool(c).alias(c) if c in ("cancelled", "diverted") else F.col(c)
          for c in C.RAW_COLUMN_MAP.values()],
        X.route("origin", "dest").alias("route"),
        X.day_name(d).alias("day_of_week"),
        F.month(d).cast("int").alias("month"),
        X.is_weekend(d).alias("is_weekend"),
        X.is_delayed("arr_delay_min").alias("is_delayed"),
        X.delay_bucket("arr_delay_min").alias("delay_bucket"),
    )


def check_clean(observation: Observation) -> None:
    """Raise if the written rows had missing dates or flags, or values lost in parsing.

    A repeated task may be counted twice, which can raise a count above zero
    further but never make a zero count anything else.
    """
    require_none(observation.get, "clean")


def bucket_counts(flights: DataFrame) -> DataFrame:
    """Rows per delay bucket (NULL bucket = cancelled / diverted), in level order."""
    return (flights.groupBy("delay_bucket").agg(F.count(F.lit(1)).alias("n_flights"))
            .withColumn("bucket_order", X.level_ordinal("delay_bucket", C.DELAY_BUCKET_LABELS)))

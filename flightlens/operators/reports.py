"""Delay-rate reports (the dashboard queries) and the generic group summary.

Every report is one grouped aggregation: partial aggregation on the map
side, one shuffle of at most (tasks x groups) partial rows, final
aggregation. Keys are low-cardinality (carrier, month, weekday, airport,
route), so a hot key costs nothing extra: it is collapsed before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import columns as X


def _delayed_int() -> Column:
    return F.when(F.col("is_delayed"), F.lit(1)).otherwise(F.lit(0))


def rate_measures(avg_col: str = "dep_delay", avg_alias: str = "avg_dep_delay_min",
                  with_delayed: bool = True) -> list[Column]:
    """COUNT(*), delayed count, rate in percent (2 dp), average (2 dp)."""
    delayed = F.sum(_delayed_int()).cast("bigint")
    total = F.count(F.lit(1))
    out = [total.alias("total_flights")]
    if with_delayed:
        out.append(delayed.alias("delayed_flights"))
    out.append(X.half_away_round(X.safe_rate_pct(delayed, total), 2).alias("delay_rate_pct"))
    out.append(X.half_away_round(F.avg(avg_col), 2).alias(avg_alias))
    return out


def rate_report(flights: DataFrame, keys: Sequence[str], *, avg_col: str = "dep_delay",
                avg_alias: str = "avg_dep_delay_min", with_delayed: bool = True,
                min_flights: int | None = None, order_by: Sequence[Column] | None = None,
                limit: int | None = None) -> DataFrame:
    out = flights.groupBy(*keys).agg(*rate_measures(avg_col, avg_alias, with_delayed))
    if min_flights is not None:
        out = out.filter(F.col("total_flights") > F.lit(min_flights))  # HAVING total_flights > n
    if order_by is not None:
        out = out.orderBy(*order_by)
    if limit is not None:
        out = out.limit(limit)
    return out


def delay_by_airline(flights: DataFrame) -> DataFrame:
    return rate_report(flights, ["airline"],
                       order_by=[F.col("delay_rate_pct").desc(), F.col("airline")])


def delay_by_month(flights: DataFrame) -> DataFrame:
    return rate_report(flights, ["month"], order_by=[F.col("month")])


def delay_by_dow(flights: DataFrame) -> DataFrame:
    return rate_report(flights, ["day_of_week"],
                       order_by=[X.level_ordinal("day_of_week", C.DOW_ORDER)])


def delay_by_airport(flights: DataFrame, min_flights: int = C.AIRPORT_MIN_FLIGHTS,
                     top_k: int = C.AIRPORT_TOP_K) -> DataFrame:
    # top-k is the feature here; the origin breaks ties so the k rows are fixed
    return rate_report(flights, ["origin"], min_flights=min_flights,
                       order_by=[F.col("total_flights").desc(), F.col("origin")], limit=top_k)


def worst_routes(flights: DataFrame, min_flights: int = C.ROUTE_MIN_FLIGHTS) -> DataFrame:
    return rate_report(flights, ["route"], min_flights=min_flights,
                       order_by=[F.col("delay_rate_pct").desc(), F.col("route")])


def delay_heatmap(flights: DataFrame) -> DataFrame:
    return rate_report(flights, ["day_of_week", "month"], avg_col="arr_delay",
                       avg_alias="avg_arr_delay_min", with_delayed=False,
                       order_by=[F.col("month"), F.col("day_of_week")])


# --- dashboard extract layouts ---------------------------------------------------
# The exported dashboard files differ from the report SQL for two reports:
# carriers carry the arrival average too (no delayed count), averages at one
# decimal; routes carry origin and destination, the arrival average, an
# inclusive volume floor and a row limit. The SQL semantics above stay the
# default; these are the extract layouts as parameters.

EXPORT_AVG_DIGITS = 1
EXPORT_ROUTE_ROWS = 25


def delay_by_airline_export(flights: DataFrame, avg_digits: int = EXPORT_AVG_DIGITS) -> DataFrame:
    delayed = F.sum(_delayed_int()).cast("bigint")
    total = F.count(F.lit(1))
    return (flights.groupBy("airline")
            .agg(total.alias("total_flights"),
                 X.half_away_round(X.safe_rate_pct(delayed, total), 2).alias("delay_rate_pct"),
                 X.half_away_round(F.avg("dep_delay"), avg_digits).alias("avg_dep_delay_min"),
                 X.half_away_round(F.avg("arr_delay"), avg_digits).alias("avg_arr_delay_min"))
            .orderBy(F.col("delay_rate_pct").desc(), F.col("airline")))


def worst_routes_export(flights: DataFrame, min_flights: int = C.ROUTE_MIN_FLIGHTS,
                        limit: int = EXPORT_ROUTE_ROWS, avg_digits: int = EXPORT_AVG_DIGITS) -> DataFrame:
    """Routes with at least ``min_flights`` flights (inclusive), worst ``limit`` by rate."""
    delayed = F.sum(_delayed_int()).cast("bigint")
    total = F.count(F.lit(1))
    return (flights.groupBy("route", "origin", "dest")
            .agg(total.alias("total_flights"),
                 X.half_away_round(X.safe_rate_pct(delayed, total), 2).alias("delay_rate_pct"),
                 X.half_away_round(F.avg("arr_delay"), avg_digits).alias("avg_arr_delay_min"))
            .filter(F.col("total_flights") >= F.lit(min_flights))
            .orderBy(F.col("delay_rate_pct").desc(), F.col("route")).limit(limit))


def delay_heatmap_export(flights: DataFrame, avg_digits: int = EXPORT_AVG_DIGITS) -> DataFrame:
    delayed = F.sum(_delayed_int()).cast("bigint")
    total = F.count(F.lit(1))
    return (flights.groupBy("day_of_week", "month")
            .agg(total.alias("total_flights"),
                 X.half_away_round(X.safe_rate_pct(delayed, total), 2).alias("delay_rate_pct"),
                 X.half_away_round(F.avg("arr_delay"), avg_digits).alias("avg_arr_delay_min"))
            .orderBy(F.col("month"), F.col("day_of_week")))


# --- all six reports from one scan -------------------------------------------

DASHBOARD_SETS = {
    "delay_by_airline": ["airline"],
    "delay_by_month": ["month"],
    "delay_by_dow": ["day_of_week"],
    "delay_by_airport": ["origin"],
    "worst_routes": ["route"],
    "delay_heatmap_dow_month": ["day_of_week", "month"],
}


def dashboard_one_pass(flights: DataFrame, airport_min_flights: int = C.AIRPORT_MIN_FLIGHTS,
                       airport_top_k: int = C.AIRPORT_TOP_K,
                       route_min_flights: int = C.ROUTE_MIN_FLIGHTS) -> DataFrame:
    """The six dashboard tables as one long table from ONE scan (GROUPING SETS).

    Expand replays each row once per grouping set inside the same stage, so a
    100 TB table is read once instead of six times; partial aggregation still
    happens before the single shuffle.
    Columns: report, key, month, then the measures of the reports (the
    heat map fills ``avg_arr_delay_min``, the others ``avg_dep_delay_min``).
    """
    keys = ["airline", "month", "day_of_week", "origin", "route"]
    sets = [[F.col(c) for c in cols] for cols in DASHBOARD_SETS.values()]
    delayed = F.sum(_delayed_int()).cast("bigint")
    g = (flights.select(*keys, "is_delayed", "dep_delay", "arr_delay")
         .groupingSets(sets, *keys)
         .agg(F.grouping_id().alias("gid"),
              F.count(F.lit(1)).alias("total_flights"),
              delayed.alias("delayed_flights"),
              F.avg("dep_delay").alias("avg_dep"),
              F.avg("arr_delay").alias("avg_arr")))

    def gid_of(cols: list[str]) -> int:
        # bit i (from the left) is 1 when key i is NOT in the set
        bits = "".join("0" if k in cols else "1" for k in keys)
        return int(bits, 2)

    report = F.lit(None).cast("string")
    for name, cols in DASHBOARD_SETS.items():
        report = F.when(F.col("gid") == F.lit(gid_of(cols)), F.lit(name)).otherwise(report)
    key = (F.when(F.col("gid") == F.lit(gid_of(["airline"])), F.col("airline"))
           .when(F.col("gid") == F.lit(gid_of(["month"])), F.col("month").cast("string"))
           .when(F.col("gid") == F.lit(gid_of(["origin"])), F.col("origin"))
           .when(F.col("gid") == F.lit(gid_of(["route"])), F.col("route"))
           .otherwise(F.col("day_of_week")))
    is_heat = F.col("report") == F.lit("delay_heatmap_dow_month")
    long = g.select(
        report.alias("report"), key.alias("key"),
        F.when(F.col("gid") == F.lit(gid_of(["day_of_week", "month"])), F.col("month"))
         .cast("int").alias("month"),
        "total_flights", "delayed_flights",
        X.half_away_round(X.safe_rate_pct(F.col("delayed_flights"), F.col("total_flights")), 2)
         .alias("delay_rate_pct"),
        X.half_away_round(F.col("avg_dep"), 2).alias("avg_dep_delay_min"),
        X.half_away_round(F.col("avg_arr"), 2).alias("avg_arr_delay_min"),
    )
    long = long.select(
        "report", "key", "month", "total_flights",
        F.when(is_heat, F.lit(None).cast("bigint")).otherwise(F.col("delayed_flights")).alias("delayed_flights"),
        "delay_rate_pct",
        F.when(is_heat, F.lit(None).cast("double")).otherwise(F.col("avg_dep_delay_min")).alias("avg_dep_delay_min"),
        F.when(is_heat, F.col("avg_arr_delay_min")).otherwise(F.lit(None).cast("double")).alias("avg_arr_delay_min"),
    )
    # HAVING floors, then the airport top-k. The window runs over the
    # aggregated report rows (bounded by the airport / route counts), never
    # over flights; ranking in place keeps the plan to ONE scan (splitting the
    # long table into two branches would scan the source twice).
    keep = (((F.col("report") == "delay_by_airport") & (F.col("total_flights") > airport_min_flights))
            | ((F.col("report") == "worst_routes") & (F.col("total_flights") > route_min_flights))
            | ~F.col("report").isin("delay_by_airport", "worst_routes"))
    long = long.filter(keep)
    w = Window.partitionBy("report").orderBy(F.col("total_flights").desc(), F.col("key"))
    rank = F.when(F.col("report") == "delay_by_airport", F.row_number().over(w))
    return (long.withColumn("_rk", rank)
            .filter(F.col("_rk").isNull() | (F.col("_rk") <= airport_top_k))
            .drop("_rk"))


# --- generic summary (EDA) ----------------------------------------------------

def summarize_by(df: DataFrame, group_col: str, sort_by: str = "index", ascending: bool = True,
                 levels: Sequence | None = None) -> DataFrame:
    """n, mean(is_delayed), mean(arr_delay | arr_delay > 0) per observed level.

    One grouped pass: the late-only mean is a conditional average, so no
    second scan and no join is needed. sort_by: index (level order, or the
    natural order of the key), value (delay rate) or volume (n).
    """
    out = df.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("is_delayed").cast("double")).alias("delay_rate"),
        F.avg(F.when(F.col("arr_delay") > 0, F.col("arr_delay"))).alias("mean_arr_delay_if_late"),
    )
    if sort_by == "value":
        key = F.col("delay_rate")
    elif sort_by == "volume":
        key = F.col("n")
    elif levels is not None:
        key = X.level_ordinal(group_col, levels)
    else:
        key = F.col(group_col)
    key = key.asc() if ascending else key.desc()
    return out.orderBy(key, F.col(group_col))


def summaries_one_pass(df: DataFrame, cols: Sequence[str] = ("dep_hour", "dow", "month", "airline",
                                                             "holiday_flag", "origin"),
                       top_origins: int = C.EDA_TOP_ORIGINS) -> DataFrame:
    """Every ``summarize_by`` table from ONE scan (GROUPING SETS).

    Long format: feature, level (as text), n, delay_rate,
    mean_arr_delay_if_late. The origin rows are cut to the ``top_origins``
    busiest (ties by level) as feature ``origin_top15``; that window runs
    over per-airport rows only.
    """
    cols = list(cols)
    late = F.when(F.col("arr_delay") > 0, F.col("arr_delay"))
    g = (df.select(*cols, "is_delayed", "arr_delay")
         .groupingSets([[F.col(c)] for c in cols], *cols)
         .agg(F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("n"),
              F.avg(F.col("is_delayed").cast("double")).alias("delay_rate"),
              F.avg(late).alias("mean_arr_delay_if_late")))
    feature, level = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(cols):
        gid = int("".join("0" if j == i else "1" for j in range(len(cols))), 2)
        name = "origin_top15" if c == "origin" else c
        feature = F.when(F.col("_gid") == gid, F.lit(name)).otherwise(feature)
        level = F.when(F.col("_gid") == gid, F.col(c).cast("string")).otherwise(level)
    long = g.select(feature.alias("feature"), level.alias("level"), "n", "delay_rate", "mean_arr_delay_if_late")
    w = Window.partitionBy("feature").orderBy(F.col("n").desc(), F.col("level"))
    rk = F.when(F.col("feature") == "origin_top15", F.row_number().over(w))
    return (long.withColumn("_rk", rk)
            .filter(F.col("_rk").isNull() | (F.col("_rk") <= top_origins)).drop("_rk"))

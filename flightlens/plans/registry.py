"""Named queries over the shipped test tables, one per operator family.

Each entry takes (spark, sf_dir) and returns a DataFrame built from the
stage tables of that input (``plans.stages``). Doubles that come out of
sums whose order is engine-dependent are rounded to 6 places (same rule in
the oracle SQL) so results compare exactly across engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as X
from .. import constants as C
from ..operators import checks, intervals, levels
from ..operators import clean as clean_op
from ..operators import profile as PR
from ..operators import reports as R
from ..params import FIXTURE
from ..session import work_root
from ..sources import fixture, months, sinks
from .stages import csv_study, study_for

QueryFn = Callable[[SparkSession, str], DataFrame]
P = FIXTURE
RELOADED = (1998, 3)             # the month that ``month_reload`` sends again
TOP_FLIGHT_NUMBERS = 2_000


def r6(c) -> "F.Column":
    return X.half_away_round(c, 6)


def round_doubles(df: DataFrame, digits: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[X.half_away_round(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) and f.name not in skip else F.col(f.name)
                       for f in df.schema.fields])


def _st(spark: SparkSession, sf_dir: str):
    return study_for(spark, sf_dir, P)


# --- clean stage -------------------------------------------------------------

def q_clean_flights(spark, sf_dir):
    return _st(spark, sf_dir).flights()


def q_raw_csv_roundtrip(spark, sf_dir):
    """Clean table built from raw CSV files in two layouts (by-name read)."""
    return csv_study(spark, sf_dir, P).flights()


def q_delay_bucket_counts(spark, sf_dir):
    return clean_op.bucket_counts(_st(spark, sf_dir).flights())


# --- dashboard reports ---------------------------------------------------------

def q_delay_by_airline(spark, sf_dir):
    return R.delay_by_airline(_st(spark, sf_dir).flights())


def q_delay_by_month(spark, sf_dir):
    return R.delay_by_month(_st(spark, sf_dir).flights())


def q_delay_by_dow(spark, sf_dir):
    return R.delay_by_dow(_st(spark, sf_dir).flights())


def q_delay_by_airport(spark, sf_dir):
    return R.delay_by_airport(_st(spark, sf_dir).flights(), P.airport_min_flights, P.airport_top_k)


def q_worst_routes(spark, sf_dir):
    return R.worst_routes(_st(spark, sf_dir).flights(), P.route_min_flights)


def q_delay_heatmap_dow_month(spark, sf_dir):
    return R.delay_heatmap(_st(spark, sf_dir).flights())


def q_delay_by_airline_export(spark, sf_dir):
    return R.delay_by_airline_export(_st(spark, sf_dir).flights())


def q_worst_routes_export(spark, sf_dir):
    return R.worst_routes_export(_st(spark, sf_dir).flights(), P.route_min_flights)


def q_delay_heatmap_export(spark, sf_dir):
    return R.delay_heatmap_export(_st(spark, sf_dir).flights())


def _sql_report(name):
    """The report as Spark SQL text over the ``flights_2024`` view (the warehouse path)."""
    def q(spark, sf_dir):
        from .dashboard import report_sql
        from .stages import flights_view
        flights_view(spark, sf_dir, P)
        sql = report_sql(airport_min_flights=P.airport_min_flights, airport_top_k=P.airport_top_k,
                         route_min_flights=P.route_min_flights)
        return spark.sql(sql[name])   # the view is resolved now, so later re-registration is harmless
    return q


def q_published_delay_by_airline(spark, sf_dir):
    """The carrier report published as a catalog table (replaced if there), read back from it."""
    path = f"{work_root(spark)}/tables/{uuid.uuid4().hex}"
    report = R.delay_by_airline(_st(spark, sf_dir).flights())
    sinks.publish_table(report.limit(0), "flightlens_delay_by_airline", path=path)
    return sinks.publish_table(report, "flightlens_delay_by_airline", path=path)


def q_exported_worst_routes(spark, sf_dir):
    """The route extract exported as CSV and read back."""
    path = f"{work_root(spark)}/exports/{uuid.uuid4().hex}"
    report = R.worst_routes_export(_st(spark, sf_dir).flights(), P.route_min_flights)
    sinks.export_report_csv(report, path)
    return sinks.read_report_csv(report, path)


def q_dashboard_one_pass(spark, sf_dir):
    return R.dashboard_one_pass(_st(spark, sf_dir).flights(), P.airport_min_flights,
                                P.airport_top_k, P.route_min_flights)


# --- model table and split -------------------------------------------------------

def q_model_table(spark, sf_dir):
    return _st(spark, sf_dir).model_table()


def q_prep_report(spark, sf_dir):
    return round_doubles(_st(spark, sf_dir).prep_report())


def q_split_summary(spark, sf_dir):
    """Rows, date range and delay rate of train, test and the seeded train sample."""
    st = _st(spark, sf_dir)
    mt = st.model_table()
    side = F.when(F.col("flight_date") < F.lit(P.split_date).cast("date"), F.lit("train")).otherwise(F.lit("test"))
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.min("flight_date").alias("min_date"),
            F.max("flight_date").alias("max_date"),
            r6(F.avg(F.col("is_delayed").cast("double"))).alias("delay_rate")]
    sample = st.train_sample().agg(*aggs).select(F.lit("train_sample").alias("split"), "*")
    return mt.groupBy(side.alias("split")).agg(*aggs).unionByName(sample)


def q_model_windows(spark, sf_dir):
    """Rows and delayed rows of every slice, each read from its own months."""
    from .models_registry import risk
    r = risk(spark, sf_dir)
    slices = {"train": r.study.train(), "test": r.study.test(), "fit": r.fit_rows, "validation": r.val_rows,
              "recalibration": r.recal_rows, "remainder": r.remaining_rows}
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("is_delayed").alias("n_delayed"), F.min("flight_date").alias("min_date"),
                    F.max("flight_date").alias("max_date")).select(F.lit(name).alias("slice"), "*") for name, df in slices.items()]
    return reduce(DataFrame.unionByName, parts)


def q_month_reload(spark, sf_dir):
    """The model table kept by month, after one month was sent again (without weekend flights, distances doubled)."""
    mt, path = _st(spark, sf_dir).model_table(), f"{work_root(spark)}/tables/{uuid.uuid4().hex}"
    months.write_months(mt, path, together=True)
    year, month = RELOADED
    start, before = f"{year}-{month:02}-01", f"{year}-{month + 1:02}-01"
    again = _st(spark, sf_dir).train(start, before).filter(~X.is_weekend("flight_date")).withColumn("distance", F.col("distance") * 2)
    months.replace_months(again, path)
    d = F.col("flight_date")
    return months.read_months(spark, path, mt.schema).groupBy(F.year(d).alias("year"), F.month(d).alias("month")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(X.is_weekend("flight_date")).alias("n_weekend"),
        F.sum(F.col("distance").cast("bigint")).alias("distance"))


def q_interval_table_flights(spark, sf_dir):
    """Flights by month, inside and outside the intervals of a table derived from orders.

    Of the table's intervals many repeat or overlap, some have no end and some end before they start.
    """
    orders = fixture.read_table(spark, sf_dir, "orders")
    d, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    table = orders.filter(F.dayofmonth(d).isin(3, 17)).select(
        d.alias("first_day"), F.when(k % 7 != 0, F.date_add(d, (k % 5).cast("int") - 1)).alias("last_day"))
    flagged = intervals.flag_in_intervals(_st(spark, sf_dir).flights(), "flight_date", table, "inside")
    return flagged.groupBy(F.year("flight_date").alias("year"), "month").agg(
        F.count(F.lit(1)).alias("n_flights"), F.count_if("inside").alias("n_inside"),
        F.count_if(F.col("inside") & F.col("is_delayed")).alias("n_inside_delayed"))


def q_flight_number_levels(spark, sf_dir):
    """Flights per flight number, the many beyond the most frequent ones as OTHER."""
    fl = _st(spark, sf_dir).flights()
    table = levels.top_level_table(fl, "flight_number", TOP_FLIGHT_NUMBERS)
    return levels.fold_levels(fl, "flight_number", table, "folded").groupBy("folded").agg(
        F.count(F.lit(1)).alias("n_flights"), F.count_if("is_delayed").alias("n_delayed"))


def q_quarantined_flights(spark, sf_dir):
    """Rows that break rules set apart: per rule, its rows and those that break no other one."""
    rules = {"cancelled": F.col("cancelled"), "diverted": F.col("diverted"), "no_arrival_delay": F.col("arr_delay").isNull(),
             "over_three_hours_late": F.col("arr_delay") > 180, "scheduled_at_2400": F.col("scheduled_dep_time") == 2400,
             "same_airport": F.col("origin") == F.col("dest")}
    return checks.rule_counts(checks.quarantine(_st(spark, sf_dir).flights(), rules, f"{work_root(spark)}/tables/{uuid.uuid4().hex}"))


# --- train-only profile ---------------------------------------------------------

def q_eda_coverage(spark, sf_dir):
    return PR.coverage(_st(spark, sf_dir).train())


def q_eda_arr_delay_describe(spark, sf_dir):
    return round_doubles(PR.describe(_st(spark, sf_dir).train(), "arr_delay"))


def q_eda_target_shares(spark, sf_dir):
    return round_doubles(PR.target_shares(_st(spark, sf_dir).train()))


def _summary(col, sort_by="index", ascending=True, levels=None):
    def q(spark, sf_dir):
        return round_doubles(R.summarize_by(_st(spark, sf_dir).train(), col, sort_by, ascending, levels))
    return q


def q_eda_by_origin_top15(spark, sf_dir):
    tr = _st(spark, sf_dir).train()
    top = PR.top_levels(tr, "origin", C.EDA_TOP_ORIGINS)
    return round_doubles(R.summarize_by(tr.filter(F.col("origin").isin(top)), "origin",
                                        sort_by="volume", ascending=False))


def q_eda_profile_one_pass(spark, sf_dir):
    return round_doubles(PR.train_profile_one_pass(_st(spark, sf_dir).train()))


def q_eda_summaries_one_pass(spark, sf_dir):
    return round_doubles(R.summaries_one_pass(_st(spark, sf_dir).train()))


def q_eda_airport_coverage(spark, sf_dir):
    return round_doubles(PR.airport_coverage(_st(spark, sf_dir).train()))


def q_eda_distance_corr(spark, sf_dir):
    return round_doubles(PR.distance_correlation(_st(spark, sf_dir).train()))


def q_eda_distance_quintiles(spark, sf_dir):
    return round_doubles(PR.distance_quintiles(_st(spark, sf_dir).train()))


def q_eda_hist_arr_delay(spark, sf_dir):
    return round_doubles(PR.histogram(_st(spark, sf_dir).train(), "arr_delay", C.HIST_BINS))


def q_eda_hist_arr_delay_zoom(spark, sf_dir):
    lo, hi = C.ZOOM_RANGE
    tr = _st(spark, sf_dir).train().filter(F.col("arr_delay").between(lo, hi))
    return round_doubles(PR.histogram(tr, "arr_delay", C.ZOOM_BINS))


def q_eda_hist_late(spark, sf_dir):
    tr = _st(spark, sf_dir).train().filter(F.col("arr_delay") > 0)
    return round_doubles(PR.histogram(tr, "arr_delay", C.HIST_BINS))


def q_eda_hist_late_log(spark, sf_dir):
    tr = _st(spark, sf_dir).train().filter(F.col("arr_delay") > 0)
    return round_doubles(PR.histogram(tr, F.log(F.col("arr_delay")), C.HIST_BINS))


def q_eda_histograms_two_passes(spark, sf_dir):
    return round_doubles(PR.delay_histograms(_st(spark, sf_dir).train()))


def q_eda_class_balance(spark, sf_dir):
    return round_doubles(PR.class_balance(_st(spark, sf_dir).train()))


QUERIES: dict[str, QueryFn] = {
    "clean_flights": q_clean_flights,
    "raw_csv_roundtrip": q_raw_csv_roundtrip,
    "delay_bucket_counts": q_delay_bucket_counts,
    "delay_by_airline": q_delay_by_airline,
    "delay_by_month": q_delay_by_month,
    "delay_by_dow": q_delay_by_dow,
    "delay_by_airport": q_delay_by_airport,
    "worst_routes": q_worst_routes,
    "delay_heatmap_dow_month": q_delay_heatmap_dow_month,
    "dashboard_one_pass": q_dashboard_one_pass,
    **{f"sql_{n}": _sql_report(n) for n in ("delay_by_airline", "delay_by_month", "delay_by_dow",
                                            "delay_by_airport", "worst_routes", "delay_heatmap_dow_month")},
    "delay_by_airline_export": q_delay_by_airline_export,
    "worst_routes_export": q_worst_routes_export,
    "delay_heatmap_export": q_delay_heatmap_export,
    "published_delay_by_airline": q_published_delay_by_airline,
    "exported_worst_routes": q_exported_worst_routes,
    "model_table": q_model_table,
    "prep_report": q_prep_report,
    "split_summary": q_split_summary,
    "model_windows": q_model_windows,
    "month_reload": q_month_reload,
    "interval_table_flights": q_interval_table_flights,
    "flight_number_levels": q_flight_number_levels,
    "quarantined_flights": q_quarantined_flights,
    "eda_coverage": q_eda_coverage,
    "eda_arr_delay_describe": q_eda_arr_delay_describe,
    "eda_target_shares": q_eda_target_shares,
    "eda_by_dep_hour": _summary("dep_hour"),
    "eda_by_dow": _summary("dow", levels=C.DOW_ORDER),
    "eda_by_month": _summary("month"),
    "eda_by_airline": _summary("airline", sort_by="value", ascending=False),
    "eda_by_holiday_flag": _summary("holiday_flag"),
    "eda_by_origin_top15": q_eda_by_origin_top15,
    "eda_summaries_one_pass": q_eda_summaries_one_pass,
    "eda_profile_one_pass": q_eda_profile_one_pass,
    "eda_airport_coverage": q_eda_airport_coverage,
    "eda_distance_corr": q_eda_distance_corr,
    "eda_distance_quintiles": q_eda_distance_quintiles,
    "eda_hist_arr_delay": q_eda_hist_arr_delay,
    "eda_hist_arr_delay_zoom": q_eda_hist_arr_delay_zoom,
    "eda_hist_late": q_eda_hist_late,
    "eda_hist_late_log": q_eda_hist_late_log,
    "eda_histograms_two_passes": q_eda_histograms_two_passes,
    "eda_class_balance": q_eda_class_balance,
}


def _register_models() -> None:
    from .models_registry import MODEL_QUERIES
    QUERIES.update(MODEL_QUERIES)


_register_models()

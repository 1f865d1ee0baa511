"""Run the whole study on raw monthly files.

    python -m flightlens --raw 'data/raw/*.csv' --out <shared folder> [--table flights_2024]

raw CSV -> clean -> model table -> train / test / sample (written stages),
the six delay reports and their extract layouts as one CSV each, the
train-only profile, the magnitude (OLS) and risk (logistic) studies as
Parquet tables under ``--out``. On a cluster, submit it with spark-submit
and set ``spark.checkpoint.dir`` to a shared folder.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as C
from .operators import profile as PR
from .operators import reports as R
from .params import STUDY_2024, StudyParams
from .plans.magnitude import Magnitude
from .plans.risk import Risk
from .plans.stages import Study, input_state
from .session import build_session, reliable_checkpoint
from .sources.raw_csv import read_raw_csv
from .sources.sinks import export_report_csv, publish_table, write_parquet


_MEASURES = ["total_flights", "delayed_flights", "delay_rate_pct", "avg_dep_delay_min"]


def _report_layouts() -> list:
    """report -> (columns from the one-pass table, order of the exported rows)."""
    return [
        ("delay_by_airline", [F.col("key").alias("airline"), *_MEASURES],
         [F.col("delay_rate_pct").desc(), F.col("airline")]),
        ("delay_by_month", [F.col("key").cast("int").alias("month"), *_MEASURES], [F.col("month")]),
        ("delay_by_dow", [F.col("key").alias("day_of_week"), *_MEASURES],
         [F.array_position(F.array(*[F.lit(d) for d in C.DOW_ORDER]), F.col("day_of_week"))]),
        ("delay_by_airport", [F.col("key").alias("origin"), *_MEASURES],
         [F.col("total_flights").desc(), F.col("origin")]),
        ("worst_routes", [F.col("key").alias("route"), *_MEASURES], [F.col("delay_rate_pct").desc(), F.col("route")]),
        ("delay_heatmap_dow_month", [F.col("key").alias("day_of_week"), "month", "total_flights", "delay_rate_pct",
                                     "avg_arr_delay_min"], [F.col("month"), F.col("day_of_week")]),
    ]


def run_study(spark: SparkSession, raw: str, out: str, params: StudyParams = STUDY_2024,
              table: str | None = None, models: bool = True, holidays: str | None = None) -> dict[str, str]:
    """Build every stage and write every result; returns {result name: path}.

    ``holidays``: a headed CSV with a column ``day`` (YYYY-MM-DD), instead of the parameters' list.
    """
    out = out.rstrip("/")
    days = spark.read.option("header", True).csv(holidays).select("day") if holidays else None
    st = Study(spark, params, raw=lambda: read_raw_csv(spark, raw), source_key=f"csv:{raw}:{input_state(spark, raw)}",
               by_month=True, holidays=days)
    flights = st.flights()
    if table:
        publish_table(flights, table)
    written: dict[str, str] = {}

    def csv(name: str, df: DataFrame) -> None:
        path = f"{out}/reports/{name}"
        export_report_csv(df, path)
        written[name] = path

    def parquet(name: str, df: DataFrame) -> None:
        path = f"{out}/tables/{name}"
        write_parquet(df, path)
        written[name] = path

    p = params
    # the six reports from ONE scan of the clean table, then reshaped per report
    dash = reliable_checkpoint(R.dashboard_one_pass(flights, p.airport_min_flights, p.airport_top_k,
                                                    p.route_min_flights))
    for name, cols, order in _report_layouts():
        part = dash.filter(F.col("report") == name).select(*cols)
        csv(name, part.orderBy(*order))
    csv("delay_by_airline_extract", R.delay_by_airline_export(flights))
    csv("worst_routes_extract", R.worst_routes_export(flights, p.route_min_flights))
    csv("delay_heatmap_extract", R.delay_heatmap_export(flights))

    parquet("prep_report", st.prep_report())
    parquet("split_proof", st.split_proof())
    st.train_sample()

    tr = st.train()
    # coverage, describe + quantiles, shares, class balance, correlations: one aggregation
    parquet("eda_profile", PR.train_profile_one_pass(tr))
    # every group summary (hour, weekday, month, carrier, holiday, top-15 origins) from one scan
    parquet("eda_summaries", R.summaries_one_pass(tr))
    parquet("eda_airport_coverage", PR.airport_coverage(tr))
    parquet("eda_distance_quintiles", PR.distance_quintiles(tr))
    hist = reliable_checkpoint(PR.delay_histograms(tr))     # four histograms in two passes
    for name in ("arr_delay", "arr_delay_zoom", "late", "late_log"):
        parquet(f"eda_hist_{name}", hist.filter(F.col("histogram") == name).drop("histogram"))

    if models:
        m = Magnitude(st)
        parquet("ols_m1_coefficients", m.coefficients("m1"))
        parquet("ols_m2_coefficients", m.coefficients("m2"))
        parquet("ols_model_stats", m.model_stats())
        parquet("ols_model_comparison", m.comparison())
        parquet("ols_headline", m.headline())
        parquet("ols_breusch_pagan", m.breusch_pagan())
        parquet("ols_vif", m.vif_table())
        parquet("ols_residuals_sample", m.residuals_vs_fitted())
        pts, lines = m.qq()
        parquet("ols_qq_points", pts)
        parquet("ols_qq_lines", lines)

        r = Risk(st)
        parquet("risk_baselines", r.baselines())
        parquet("risk_fit_summary", r.fit_summary())
        parquet("risk_coefficients", r.coefficients())
        parquet("risk_discrimination", r.discrimination())
        parquet("risk_calibration", r.calibration())
        parquet("risk_brier", r.brier_full())
        parquet("risk_recalibration", r.recalibration())
        parquet("risk_recalibration_curves", r.recalibration_curves())
        parquet("risk_threshold_costs", r.threshold_costs())
        parquet("risk_threshold_report", r.threshold_report())
        parquet("risk_cost_sensitivity", r.sensitivity())
        parquet("risk_sensitivity_findings", r.findings())
        parquet("risk_odds_ratios", r.odds_ratios())
        parquet("risk_inference_summary", r.inference_summary())
    return written


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="python -m flightlens", description=__doc__.splitlines()[0])
    ap.add_argument("--raw", required=True, help="raw monthly CSV files (path or glob)")
    ap.add_argument("--out", required=True, help="output folder (shared storage on a cluster)")
    ap.add_argument("--table", default=None, help="also replace this catalog table with the clean flights")
    ap.add_argument("--holidays", default=None, help="headed CSV of holidays (column day) instead of the built-in ones")
    ap.add_argument("--master", default=None, help="only for local runs, e.g. local[8]")
    ap.add_argument("--no-models", action="store_true", help="stop after the reports and the profile")
    a = ap.parse_args(argv)
    spark = build_session(a.master)
    for name, path in run_study(spark, a.raw, a.out, table=a.table, models=not a.no_models, holidays=a.holidays).items():
        print(f"{name}\t{path}")


if __name__ == "__main__":
    main()

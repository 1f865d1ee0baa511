"""The 2024 study parameters end to end on a small generated set of raw monthly files.

The shipped tables exercise the fixture preset; this runs the real preset
(2024 holidays, the 2024-10-01 split, references WN / ATL, the published
headline terms) through ``python -m flightlens``'s ``run_study``.
"""

import datetime as dt
import os

import numpy as np
from pyspark.sql import functions as F

from flightlens import constants as C
from flightlens.__main__ import run_study
from flightlens.params import STUDY_2024

HEADER = list(C.RAW_COLUMN_MAP)


def _airports(n=60):
    letters = "BCEGJKMNPQRSTVWXYZ"
    codes = ["ATL", "ORD", "DEN", "DFW"]
    i = 0
    while len(codes) < n:
        c = "Q" + letters[i // len(letters) % len(letters)] + letters[i % len(letters)]
        if c not in codes:
            codes.append(c)
        i += 1
    return codes


def write_raw_2024(folder: str, n: int = 6000, seed: int = 7) -> int:
    rng = np.random.default_rng(seed)
    airports = _airports()
    w_air = np.array([0.15, 0.08, 0.07, 0.07] + [0.63 / (len(airports) - 4)] * (len(airports) - 4))
    airlines = ["WN", "AA", "DL", "UA", "F9", "HA", "B6", "NK"]
    w_car = np.array([0.3, 0.15, 0.15, 0.12, 0.08, 0.06, 0.08, 0.06])
    days = rng.integers(0, 366, n)
    origin = rng.choice(len(airports), n, p=w_air)
    dest = rng.choice(len(airports), n, p=w_air)
    dest = np.where(dest == origin, (dest + 1) % len(airports), dest)
    carrier = rng.choice(len(airlines), n, p=w_car)
    hour = rng.integers(0, 24, n)
    minute = rng.integers(0, 60, n)
    crs = hour * 100 + minute
    crs[:3] = 2400
    arr = np.round(rng.exponential(35, n) - 18 + hour * 0.8)
    dep = arr - rng.integers(-5, 6, n)
    cancelled = rng.random(n) < 0.02
    diverted = (~cancelled) & (rng.random(n) < 0.005)
    by_month: dict[int, list[str]] = {}
    for i in range(n):
        d = dt.date(2024, 1, 1) + dt.timedelta(days=int(days[i]))
        gone = cancelled[i] or diverted[i]
        a = "" if gone else f"{arr[i]:.2f}"
        late = (not gone) and arr[i] >= 15
        row = {
            "FL_DATE": f"{d.month}/{d.day}/{d.year} 12:00:00 AM",
            "OP_UNIQUE_CARRIER": airlines[carrier[i]], "OP_CARRIER_FL_NUM": str(100 + i % 900),
            "ORIGIN": airports[origin[i]], "DEST": airports[dest[i]], "CRS_DEP_TIME": str(crs[i]),
            "DEP_TIME": "" if cancelled[i] else f"{crs[i] % 2400:.2f}",
            "DEP_DELAY": "" if cancelled[i] else f"{dep[i]:.2f}",
            "DEP_DELAY_NEW": "" if cancelled[i] else f"{max(dep[i], 0):.2f}",
            "CRS_ARR_TIME": str((crs[i] + 130) % 2400), "ARR_TIME": "" if gone else f"{(crs[i] + 130) % 2400:.2f}",
            "ARR_DELAY": a, "ARR_DELAY_NEW": "" if gone else f"{max(arr[i], 0):.2f}",
            "CANCELLED": "1.00" if cancelled[i] else "0.00", "CANCELLATION_CODE": "B" if cancelled[i] else "",
            "DIVERTED": "1.00" if diverted[i] else "0.00", "AIR_TIME": "" if gone else "95.00",
            "DISTANCE": f"{200 + (origin[i] * 37 + dest[i] * 91) % 2000:.2f}",
            "CARRIER_DELAY": f"{arr[i]:.2f}" if late else "", "WEATHER_DELAY": "0.00" if late else "",
            "NAS_DELAY": "0.00" if late else "", "SECURITY_DELAY": "0.00" if late else "",
            "LATE_AIRCRAFT_DELAY": "0.00" if late else "",
        }
        by_month.setdefault(d.month, []).append(",".join(row[c] for c in HEADER) + ",")
    for m, lines in by_month.items():
        with open(os.path.join(folder, f"ontime_2024_{m:02d}.csv"), "w") as f:
            f.write(",".join(HEADER) + ",\n")
            f.write("\n".join(lines) + "\n")
    return n


def test_full_2024_study_runs(spark, tmp_dir):
    raw = os.path.join(tmp_dir, "raw")
    os.makedirs(raw)
    n = write_raw_2024(raw)
    out = os.path.join(tmp_dir, "out")
    written = run_study(spark, raw + "/*.csv", out, STUDY_2024)
    assert {"delay_by_airline", "worst_routes_extract", "ols_headline", "risk_sensitivity_findings",
            "eda_summaries", "eda_profile"} <= set(written)
    prof = spark.read.parquet(written["eda_profile"]).collect()[0]
    assert prof["n_pos"] + prof["n_neg"] == prof["n_rows"] and prof["p99_9"] >= prof["p50"]
    feats = {r[0] for r in spark.read.parquet(written["eda_summaries"]).select("feature").distinct().collect()}
    assert feats == {"dep_hour", "dow", "month", "airline", "holiday_flag", "origin_top15"}
    air = spark.read.option("header", True).csv(written["delay_by_airline"])
    assert air.columns == ["airline", "total_flights", "delayed_flights", "delay_rate_pct", "avg_dep_delay_min"]
    assert air.agg(F.sum(F.col("total_flights").cast("long"))).collect()[0][0] == n
    heat = spark.read.option("header", True).csv(written["delay_heatmap_dow_month"])
    assert heat.count() == 84 and heat.columns[-1] == "avg_arr_delay_min"
    head = spark.read.parquet(written["ols_headline"])
    assert head.count() == len(STUDY_2024.headline_terms)          # every published term is found once
    assert {r["term"] for r in head.collect()} >= {"C(airline)[T.F9]", "C(origin_top)[T.ORD]", "log_distance"}
    fit = spark.read.parquet(written["risk_fit_summary"]).collect()[0]
    assert fit["ref_airline"] == "WN" and fit["ref_airport"] == "ATL" and fit["converged"]
    proof = spark.read.parquet(written["split_proof"]).collect()[0]
    assert proof["max_before"] < dt.date(2024, 10, 1) <= proof["min_after"]
    prep = spark.read.parquet(written["prep_report"]).collect()[0]
    assert prep["remapped_2400"] >= 1 and prep["holiday_rows"] > 0

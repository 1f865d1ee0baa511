"""Fixed values that results depend on.

FIXED VALUES: everything in this module must stay equal to the published
definitions of the on-time-performance data model (column names, level
lists, bin edges, holiday calendar, cost scenarios). Do not reorder.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES -- raw on-time-performance column name -> clean name (23 columns)
# ---------------------------------------------------------------------------
RAW_COLUMN_MAP: dict[str, str] = {
    "FL_DATE": "flight_date",
    "OP_UNIQUE_CARRIER": "airline",
    "OP_CARRIER_FL_NUM": "flight_number",
    "ORIGIN": "origin",
    "DEST": "dest",
    "CRS_DEP_TIME": "scheduled_dep_time",
    "DEP_TIME": "actual_dep_time",
    "DEP_DELAY": "dep_delay",
    "DEP_DELAY_NEW": "dep_delay_min",
    "CRS_ARR_TIME": "scheduled_arr_time",
    "ARR_TIME": "actual_arr_time",
    "ARR_DELAY": "arr_delay",
    "ARR_DELAY_NEW": "arr_delay_min",
    "CANCELLED": "cancelled",
    "CANCELLATION_CODE": "cancellation_code",
    "DIVERTED": "diverted",
    "AIR_TIME": "air_time",
    "DISTANCE": "distance",
    "CARRIER_DELAY": "carrier_delay",
    "WEATHER_DELAY": "weather_delay",
    "NAS_DELAY": "nas_delay",
    "SECURITY_DELAY": "security_delay",
    "LATE_AIRCRAFT_DELAY": "late_aircraft_delay",
}

# FIXED VALUES -- delay-cause columns, null unless the flight was delayed; filled with 0
CAUSE_COLUMNS = [
    "carrier_delay", "weather_delay", "nas_delay",
    "security_delay", "late_aircraft_delay",
]

# FIXED VALUES -- delay severity: right-closed bins (-inf,0], (0,15], (15,60], (60,180], (180,inf)
DELAY_BUCKET_EDGES = [0.0, 15.0, 60.0, 180.0]
DELAY_BUCKET_LABELS = ["on_time_or_early", "minor", "moderate", "severe", "extreme"]

# FIXED VALUES -- a flight is delayed when it arrives this many minutes late or more
DELAY_THRESHOLD_MIN = 15.0

# FIXED VALUES -- day names, Monday first (the reference level)
DOW_ORDER = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# FIXED VALUES -- 2024 US federal holidays (observed dates); +/- 3 days is a holiday window
HOLIDAYS_2024 = {
    "New Year's Day": "2024-01-01",
    "MLK Day": "2024-01-15",
    "Memorial Day": "2024-05-27",
    "July 4th": "2024-07-04",
    "Labor Day": "2024-09-02",
    "Thanksgiving": "2024-11-28",
    "Christmas": "2024-12-25",
}
HOLIDAY_WINDOW_DAYS = 3

# FIXED VALUES -- columns the model table reads from the clean table
MODEL_SOURCE_COLUMNS = [
    "flight_date", "airline", "origin", "dest", "scheduled_dep_time",
    "arr_delay", "cancelled", "diverted", "distance", "month", "is_delayed",
]

# FIXED VALUES -- the model table's 11 columns, in order
MODEL_COLUMNS = [
    "flight_date", "airline", "origin", "dest",
    "dep_hour", "dow", "month", "holiday_flag",
    "distance", "arr_delay", "is_delayed",
]

# FIXED VALUES -- post-departure ("leakage") columns that must never reach the model table
LEAKAGE_COLUMNS = [
    "dep_delay", "dep_delay_min", "actual_dep_time", "actual_arr_time", "air_time",
    "arr_delay_min", "delay_bucket", "cancellation_code", "carrier_delay",
    "weather_delay", "nas_delay", "security_delay", "late_aircraft_delay",
]

# FIXED VALUES -- departure-hour bins: right-closed (-1,4], (4,7], (7,11], (11,15], (15,19], (19,23]
DEP_HOUR_BIN_EDGES = [4, 7, 11, 15, 19, 23]
DEP_HOUR_BIN_LABELS = ["red_eye", "early_morning", "morning", "midday", "evening", "night"]
# FIXED VALUES -- model level order for the bins; the first one is the reference
DEP_HOUR_BIN_MODEL_ORDER = ["early_morning", "red_eye", "morning", "midday", "evening", "night"]

OTHER_LEVEL = "OTHER"

# FIXED VALUES -- split and sampling parameters of the 2024 study
SPLIT_DATE_2024 = "2024-10-01"
FIT_CUTOFF_2024 = "2024-09-01"
VALIDATION_END_2024 = "2024-09-30"
RECAL_END_2024 = "2024-10-14"
REMAINDER_START_2024 = "2024-10-15"
TRAIN_START_2024 = "2024-01-01"
SAMPLE_SIZE = 1_000_000
SAMPLE_SEED = 42
DIAG_SAMPLE_SIZE = 50_000
DIAG_SEED = 42
TOP_N_AIRPORTS = 50
REF_AIRLINE_2024 = "WN"
REF_AIRPORT_2024 = "ATL"

# FIXED VALUES -- report filters of the dashboard SQL
AIRPORT_MIN_FLIGHTS = 5000
AIRPORT_TOP_K = 30
ROUTE_MIN_FLIGHTS = 1000

# FIXED VALUES -- EDA quantile levels (percent) and histogram settings
QUANTILE_LEVELS_PCT = [1, 5, 25, 50, 75, 95, 99, 99.9]
COVERAGE_TOP_NS = [10, 20, 30, 50, 100]
HIST_BINS = 100
ZOOM_RANGE = (-60.0, 180.0)
ZOOM_BINS = 48
QUINTILE_LABELS = ["Q1 (shortest)", "Q2", "Q3", "Q4", "Q5 (longest)"]
EDA_TOP_ORIGINS = 15

# FIXED VALUES -- risk model decisions
FALSE_ALARM_COST = 2.0
MISSED_DELAY_COST = 25.0
COST_SCENARIOS = [(2, 25), (2, 10), (2, 6), (5, 10), (10, 25), (2, 4)]
THRESHOLD_PCT_RANGE = (5, 95)  # thresholds 0.05 .. 0.95 step 0.01
CALIBRATION_BINS = 10
RULE_BASELINE_HOUR = 16
DEFAULT_THRESHOLD = 0.5
LOGREG_MAX_ITER = 1000
LOGIT_MAX_ITER = 100
FLAGGED_SHARE_LIMIT = 0.5
MEANINGFUL_SAVING_PCT = 10.0
TOP_COEFFICIENTS = 15

# FIXED VALUES -- headline magnitude-model terms: (factor, level); level None = numeric/flag term
HEADLINE_TERMS_2024 = [
    ("holiday_flag", None),
    ("log_distance", None),
    ("dep_hour_bin", "night"),
    ("dep_hour_bin", "midday"),
    ("dow", "Friday"),
    ("airline", "F9"),
    ("airline", "HA"),
    ("origin_top", "ORD"),
    ("origin_top", "DEN"),
    ("origin_top", "DFW"),
]

# FIXED VALUES -- two-sided 95% normal quantile
Z_975 = 1.959963984540054

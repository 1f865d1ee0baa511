"""Study parameters: the 2024 study itself and the preset for the shipped test tables.

The shipped tables span 1995-2001 instead of one year, so the date cut-offs,
holiday calendar, top-N and HAVING floors move with the data; every operator
takes a ``StudyParams`` instead of reading globals.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, replace

from . import constants as C


@dataclass(frozen=True)
class StudyParams:
    holidays: tuple[str, ...] = tuple(C.HOLIDAYS_2024.values())
    holiday_window_days: int = C.HOLIDAY_WINDOW_DAYS
    train_start: str = C.TRAIN_START_2024
    split_date: str = C.SPLIT_DATE_2024
    fit_cutoff: str = C.FIT_CUTOFF_2024
    validation_end: str = C.VALIDATION_END_2024
    recal_end: str = C.RECAL_END_2024
    remainder_start: str = C.REMAINDER_START_2024
    top_n_airports: int = C.TOP_N_AIRPORTS
    ref_airline: str | None = C.REF_AIRLINE_2024
    ref_airport: str | None = C.REF_AIRPORT_2024
    sample_size: int = C.SAMPLE_SIZE
    sample_seed: int = C.SAMPLE_SEED
    diag_sample_size: int = C.DIAG_SAMPLE_SIZE
    diag_seed: int = C.DIAG_SEED
    airport_min_flights: int = C.AIRPORT_MIN_FLIGHTS
    airport_top_k: int = C.AIRPORT_TOP_K
    route_min_flights: int = C.ROUTE_MIN_FLIGHTS
    headline_terms: tuple = tuple(C.HEADLINE_TERMS_2024)
    cost_scenarios: tuple = tuple(C.COST_SCENARIOS)
    false_alarm_cost: float = C.FALSE_ALARM_COST
    missed_delay_cost: float = C.MISSED_DELAY_COST

    def with_(self, **kw) -> "StudyParams":
        return replace(self, **kw)

    def key(self) -> str:
        """Stable text for cache keys of stage tables."""
        parts = [f"{k}={getattr(self, k)!r}" for k in sorted(self.__dataclass_fields__)]
        return ";".join(parts)


STUDY_2024 = StudyParams()


def _yearly_holidays(years: range) -> tuple[str, ...]:
    """The 2024 calendar's month/day pairs repeated for each year of the data."""
    out = []
    for y in years:
        for iso in C.HOLIDAYS_2024.values():
            d = _dt.date.fromisoformat(iso)
            out.append(_dt.date(y, d.month, d.day).isoformat())
    return tuple(out)


# Preset for the shipped TPC-H-shaped tables (ship dates 1995-01-02 .. 2001-11-04).
FIXTURE = StudyParams(
    holidays=_yearly_holidays(range(1995, 2002)),
    train_start="1995-01-01",
    split_date="2000-10-01",
    fit_cutoff="2000-09-01",
    validation_end="2000-09-30",
    recal_end="2000-10-14",
    remainder_start="2000-10-15",
    top_n_airports=10,
    ref_airline=None,   # highest-volume airline in train
    ref_airport=None,   # highest-volume origin in train
    sample_size=1_000_000,
    sample_seed=42,
    diag_sample_size=50_000,    # the study's own
    diag_seed=42,
    airport_min_flights=2000,
    airport_top_k=30,
    route_min_flights=100,
    headline_terms=(
        ("holiday_flag", None),
        ("log_distance", None),
        ("dep_hour_bin", "night"),
        ("dep_hour_bin", "midday"),
        ("dow", "Friday"),
        ("dow", "Sunday"),
        ("dep_hour_bin", "evening"),
        ("dest_top", "OTHER"),
    ),   # levels present at every shipped scale (sf0.001 has only 10 origin nations: no OTHER origin)
)

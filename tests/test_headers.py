"""Headers of many raw files, read by tasks."""

import gzip
import os

import pytest

from flightlens import constants as C
from flightlens.operators.clean import clean_flights
from flightlens.sources import raw_csv

HEADER = list(C.RAW_COLUMN_MAP)
ROW = {c: "" for c in HEADER} | {"FL_DATE": "2024-01-05", "ORIGIN": "ATL", "DEST": "DEN", "CANCELLED": "0", "DIVERTED": "0"}


def _text(order, number, end="\n"):
    return ",".join(order) + end + ",".join(str(number) if c == "OP_CARRIER_FL_NUM" else ROW.get(c, "") for c in order) + end


def test_five_thousand_files_of_three_layouts(spark, tmp_dir, monkeypatch):
    layouts = [HEADER, HEADER[::-1], HEADER[5:] + HEADER[:5] + [""]]
    for i in range(5000):
        with open(os.path.join(tmp_dir, f"{i:04}.csv"), "w") as f:
            f.write(_text(layouts[i % 3], i))
    monkeypatch.setattr(raw_csv, "_first_line", None)       # nothing on the driver may open a file
    groups = raw_csv.header_groups(spark, raw_csv.list_files(spark, tmp_dir + "/*.csv"))
    assert [len(files) for _, files in groups] == [1667, 1667, 1666]
    assert [h[:2] for h, _ in groups] == [tuple(x[:2]) for x in layouts]
    assert groups[2][0][-1] == f"_c{len(HEADER)}"
    rows = clean_flights(raw_csv.read_raw_csv(spark, tmp_dir + "/*.csv")).select("flight_number", "origin", "flight_date").collect()
    assert sorted(r.flight_number for r in rows) == list(range(5000))
    assert {(r.origin, str(r.flight_date)) for r in rows} == {("ATL", "2024-01-05")}


def test_line_ends_marks_compressed_and_empty_files(spark, tmp_dir):
    with open(os.path.join(tmp_dir, "a.csv"), "wb") as f:
        f.write(("﻿" + _text(HEADER, 1, "\r\n")).encode())
    with gzip.open(os.path.join(tmp_dir, "b.csv.gz"), "wt") as f:
        f.write(_text(HEADER, 2))
    open(os.path.join(tmp_dir, "c.csv"), "w").close()
    with open(os.path.join(tmp_dir, "d.csv"), "w") as f:                # a header longer than one read
        f.write(_text(HEADER + [f"x{i:06}" for i in range(12_000)], 3))
    files = raw_csv.list_files(spark, tmp_dir)
    groups = raw_csv.header_groups(spark, files)
    assert [len(h) for h, _ in groups] == [23, 12_023] and [len(f) for _, f in groups] == [2, 1]
    assert groups[0][0] == tuple(HEADER)
    assert raw_csv.file_header(spark, [f for f in files if "b.csv" in f][0]) == tuple(HEADER)
    open(os.path.join(tmp_dir, "only"), "w").close()
    with pytest.raises(FileNotFoundError):
        raw_csv.read_raw_csv(spark, os.path.join(tmp_dir, "only"))


def test_files_that_only_spark_can_open_are_read_through(spark, tmp_dir):
    for i, order in enumerate((HEADER, HEADER[::-1], HEADER)):
        with open(os.path.join(tmp_dir, f"{i}.csv"), "w") as f:
            f.write(_text(order, i) + "\n".join([",".join("" for _ in order)] * 50))
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.flights.link./raw", f"file://{tmp_dir}")
    files = [f"viewfs://flights/raw/{i}.csv" for i in range(3)]
    assert raw_csv._first_line(files[0]) is None
    groups = raw_csv.header_groups(spark, files)
    assert [(h[0], [f[-5:] for f in fs]) for h, fs in groups] == [(HEADER[0], ["0.csv", "2.csv"]), (HEADER[-1], ["1.csv"])]
    rows = raw_csv.read_raw_csv(spark, "viewfs://flights/raw/*.csv").filter("ORIGIN = 'ATL'").collect()
    assert sorted(r.OP_CARRIER_FL_NUM for r in rows) == ["0", "1", "2"]

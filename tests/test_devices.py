"""Device dimension: validity dates, fallbacks, validation."""

from datetime import date, datetime

import pytest

from motioncat.operators.devices import device_asof, device_overlaps, distinct_devices, validate_devices
from motioncat.sources.tables import read_devices

SCHEMA = "ord int, serial string, device string, start_date date, end_date date"
SWAP = [
    (1, "A1", "Garage", None, date(2025, 8, 31)),
    (2, "A1", "Balcony", date(2025, 9, 1), None),
    (3, "B2", "Balcony", None, date(2025, 8, 31)),
    (4, "B2", "Garage", date(2025, 9, 1), None),
]


def look_up(spark, entries, cases, **options):
    dims = spark.createDataFrame(entries, SCHEMA)
    clips = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(cases)], "id int, serial string, dt timestamp_ntz")
    return [r.device for r in device_asof(clips, dims, **options).orderBy("id").collect()]


def test_no_dates_gives_first_entry(spark):
    rows = [(1, "A1", "Garage", None, None), (2, "B2", "Balcony", None, None), (3, "C3", "Yard", None, None)]
    assert look_up(spark, rows, [("A1", datetime(2020, 1, 1)), ("C3", datetime(2030, 5, 5, 12))]) == ["Garage", "Yard"]


def test_swap_and_its_midnights(spark):
    cases = [
        ("A1", datetime(2025, 8, 1)), ("B2", datetime(2025, 8, 1)), ("A1", datetime(2025, 8, 31)), ("A1", datetime(2025, 9, 1)),
        ("B2", datetime(2025, 9, 1)), ("B2", datetime(2026, 1, 1)),
    ]
    assert look_up(spark, SWAP, cases) == ["Garage", "Balcony", "Garage", "Balcony", "Garage", "Garage"]


def test_end_date_is_its_midnight(spark):
    """Later on the last day no entry covers the time, so the first entry of the serial is taken."""
    entries = [(1, "A1", "Late", date(2025, 9, 1), None), (2, "A1", "Early", None, date(2025, 8, 31))]
    noon = [("A1", datetime(2025, 8, 31, 12))]
    assert look_up(spark, entries, noon) == ["Late"]
    assert look_up(spark, entries, noon, end_of_day=True) == ["Early"]


def test_open_ranges_and_unknown_serial(spark):
    entries = [(1, "A1", "Garage", date(2025, 6, 1), None), (2, "B2", "Yard", None, date(2025, 6, 1))]
    cases = [("A1", datetime(2025, 1, 1)), ("B2", datetime(2025, 12, 1)), ("Z9", datetime(2025, 1, 1))]
    assert look_up(spark, entries, cases) == ["Garage", "Yard", "Z9"]


def test_three_ranges_of_one_serial(spark):
    entries = [
        (1, "A1", "Garage", None, date(2025, 3, 31)), (2, "A1", "Workshop", date(2025, 4, 1), date(2025, 8, 31)),
        (3, "A1", "Balcony", date(2025, 9, 1), None),
    ]
    cases = [("A1", datetime(2025, m, 15)) for m in (2, 6, 11)]
    assert look_up(spark, entries, cases) == ["Garage", "Workshop", "Balcony"]


def test_first_entry_wins_where_entries_overlap(spark):
    entries = [(1, "A1", "One", date(2025, 2, 1), date(2025, 4, 1)), (2, "A1", "Two", date(2025, 1, 1), None)]
    cases = [("A1", datetime(2025, 1, 5)), ("A1", datetime(2025, 3, 1)), ("A1", datetime(2025, 5, 1))]
    assert look_up(spark, entries, cases) == ["Two", "One", "Two"]


def test_lookup_keeps_every_clip_once(spark):
    dims = spark.createDataFrame(SWAP, SCHEMA)
    clips = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 'A1', 'B2') AS serial", "timestamp_ntz'2025-08-30 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 10) AS dt")
    assert device_asof(clips, dims).count() == 1000


def test_overlap_is_an_error(spark):
    bad = spark.createDataFrame([(1, "A1", "One", None, date(2025, 9, 15)), (2, "A1", "Two", date(2025, 9, 1), None)], SCHEMA)
    with pytest.raises(ValueError, match="Overlapping date ranges for serial A1"):
        validate_devices(bad)
    validate_devices(spark.createDataFrame(SWAP, SCHEMA))
    assert device_overlaps(bad).count() == 1


def test_csv_dates(spark, tmp_path):
    file = tmp_path / "devices.csv"
    file.write_text("Serial,Device,start_date,end_date\nA1,Garage,,2025-13-45\nB2,Yard,soon,\nC3,Gate,2025-01-01,\n")
    rows = read_devices(spark, str(file)).orderBy("ord").collect()
    assert [(r.serial, r.start_date, r.end_date) for r in rows] == [("A1", None, None), ("B2", None, None), ("C3", date(2025, 1, 1), None)]
    plain = tmp_path / "plain.csv"
    plain.write_text("Serial,Device\nA1,Garage\n")
    assert read_devices(spark, str(plain)).first().start_date is None


def test_distinct_devices_in_order(spark):
    rows = [(i, f"S{i}", d, None, None) for i, d in enumerate(["Garage", "Balcony", "Garage", "Yard", "Balcony"])]
    assert [r.device for r in distinct_devices(spark.createDataFrame(rows, SCHEMA)).collect()] == ["Garage", "Balcony", "Yard"]

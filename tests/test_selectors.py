"""Selectors and stories: edge cases of the criteria."""

from datetime import datetime

import pytest

from motioncat.plans.selectors import Selector, select_clips, selector_devices
from motioncat.plans.story import Story, filter_occupancy

ROWS = [
    (1, "a.mp4", "Yard", datetime(2024, 1, 5, 23, 30), 10.0), (2, "b.mp4", "Gate", datetime(2024, 1, 6, 0, 15), 20.0),
    (3, "c.mp4", "Yard", datetime(2024, 1, 6, 12, 0), 30.0), (4, "d.mp4", "Gate", datetime(2024, 1, 7, 5, 0), 40.0),
]


@pytest.fixture(scope="module")
def clips(spark):
    return spark.createDataFrame(ROWS, "load_seq int, filename string, device string, dt timestamp_ntz, duration_s double")


def ids(df):
    return sorted(r.load_seq for r in df.collect())


@pytest.mark.parametrize("selector, expected", [
    (Selector(), [1, 2, 3, 4]),
    (Selector(devices=[]), [1, 2, 3, 4]),
    (Selector(devices=[], filenames=["nothing"]), [1, 2, 3, 4]),
    (Selector(devices=["Yard"], filenames=[], duration_range=(100, None)), [1, 3]),
    (Selector(filenames=["a.mp4", "d.mp4"], weekdays=[], time_range=("10:00:00", "11:00:00")), [1, 4]),
    (Selector(weekdays=["SATURDAY"]), [2, 3]),
    (Selector(weekdays=["caturday"]), []),
    (Selector(date_range=("2024-01-06", "2024-01-06")), [2, 3]),
    (Selector(date_range=(None, "2024-01-05")), [1]),
    (Selector(date_regex="2024-01-05|.*-07"), [1, 4]),
    (Selector(date_regex="2024-01|07"), [1, 2, 3, 4]),
    (Selector(date_regex="01-07"), []),
    (Selector(time_range=("23:00:00", "05:00:00")), [1, 2, 4]),
    (Selector(time_range=("12:00:00", None)), [1, 3]),
    (Selector(time_range=(None, "00:15:00")), [2]),
    (Selector(duration_range=(20, 30)), [2, 3]),
])
def test_selector(clips, selector, expected):
    assert ids(select_clips(clips, selector)) == expected


def test_or_and_empty_lists(clips):
    either = [Selector(devices=["Gate"], duration_range=(30, None)), Selector(filenames=["a.mp4"])]
    assert ids(select_clips(clips, either)) == [1, 4]
    assert ids(select_clips(clips, None)) == ids(select_clips(clips, [])) == [1, 2, 3, 4]


@pytest.mark.parametrize("bad", [
    {"date_range": (None, None)}, {"duration_range": (None, None)}, {"time_range": (None, None)}, {"time_range": ("25:00:00", None)},
    {"date_range": ("2024-13-01", None)}, {"date_regex": "(["},
])
def test_bad_criteria_raise(bad):
    with pytest.raises(ValueError):
        Selector(**bad)


def test_from_dict():
    one = Selector.from_dict({"devices": "Yard", "time_range": {"start": "08:00:00"}, "typo": 1}, known_devices=["Yard"])
    assert one == Selector(devices=["Yard"], time_range=("08:00:00", None))
    with pytest.raises(ValueError, match="Unknown devices: Shed"):
        Selector.from_dict({"devices": ["Shed"]}, known_devices=["Yard"])
    with pytest.raises(ValueError, match="typo"):
        Selector.from_dict({"typo": 1}, strict=True)


def test_selector_devices():
    assert selector_devices([Selector(devices=["B", "A"]), Selector(), Selector(devices=["A", "C"])]) == ["B", "A", "C"]


def test_date_range_reaches_the_scan(spark, clips, tmp_path):
    path = str(tmp_path / "clips")
    clips.write.parquet(path)
    plan = select_clips(spark.read.parquet(path), Selector(date_range=("2024-01-06", None), devices=["Yard"]))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(dt" in plan and "EqualTo(device,Yard)" in plan


def test_story_and_occupancy(spark, clips):
    calendar = spark.createDataFrame(
        [(1, "2024-01-05", "2024-01-06", "OCCUPIED"), (2, "2024-01-06", "2024-01-06", "NOT_OCCUPIED")], "ord int, s string, e string, status string"
    ).selectExpr("ord", "date(s) AS start_date", "date(e) AS end_date", "status")
    assert ids(filter_occupancy(clips, calendar, ["OCCUPIED", "UNKNOWN"])) == [1, 4]
    story = Story.from_dict({"name": "x", "selectors": [{"devices": ["Yard"]}], "occupancy_status": ["NOT_OCCUPIED"]})
    assert ids(story.select(clips.union(clips), calendar)) == [3]
    with pytest.raises(ValueError):
        Story.from_dict({"name": "x", "occupancy_status": ["MAYBE"]})
    with pytest.raises(ValueError):
        Story.from_dict({"selectors": []})

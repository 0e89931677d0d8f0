"""Views of the dashboard, the projected series' first point, and embeddings as a table."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from motioncat.operators.rollup import forecast_counts
from motioncat.plans.dashboard import WEEKDAYS, Dashboard, clock_of
from motioncat.plans.selectors import Selector
from motioncat.session import scratch_path
from motioncat.sources import documents as docs

BOUNDS, KNOWN = ("2024-01-01", "2024-02-01"), ["A", "B"]


@pytest.mark.parametrize("view, want", [
    (Dashboard(), Selector()),
    (Dashboard(start_date="2024-01-01", end_date="2024-02-01", devices=["B", "A", "C"], weekdays=list(WEEKDAYS), date_regex="", start_hour=0, end_hour=24), Selector()),
    (Dashboard(duration_min=" ", duration_max="abc"), Selector()),
    (Dashboard(duration_min="2.5"), Selector(duration_range=(2.5, None))),
    (Dashboard(end_date="2024-01-05"), Selector(date_range=("2024-01-01", "2024-01-05"))),
    (Dashboard(devices=["A"], weekdays=["Monday"], date_regex="2024-.*", end_hour=6.5),
     Selector(devices=["A"], weekdays=["Monday"], date_regex="2024-.*", time_range=("00:00:00", "06:30:00"))),
    (Dashboard(devices=[]), Selector(devices=[])),
])
def test_full_ranges_are_no_criterion(view, want):
    assert view.selector(BOUNDS, KNOWN) == want


def test_clock_and_metric():
    assert [clock_of(t) for t in (0, 6.25, 11.999, 23.5, 24)] == ["00:00:00", "06:15:00", "12:00:00", "23:30:00", "23:59:59"]
    with pytest.raises(ValueError):
        Dashboard(metric="colour")


CLIPS = "dt timestamp_ntz, device string, frame_count long, duration_s double, file_size double"


def test_figures_of_one_selection(spark):
    rows = [(datetime(2024, 1, d, h, 20), dev, 10, 60.0 * d, 2.0) for d, h, dev in [(1, 5, "A"), (1, 5, "B"), (3, 7, "A"), (3, 7, "A"), (4, 23, "C")]]
    clips = spark.createDataFrame(rows, CLIPS)
    got = Dashboard(metric="duration", end_hour=22, bins_per_hour=1).frames(clips, KNOWN, ["A", "B", "C"])
    assert got["totals"].first().asDict() == {"num_videos": 4, "num_days": 2, "num_frames": 40, "seconds": 480.0, "size_mb": 8.0}
    day = {r.date.day: (r.A, r.B, r.C) for r in got["daily"].collect()}
    assert day == {1: (1.0, 1.0, 0.0), 3: (6.0, 0.0, 0.0)}
    assert {r.hour: r.A for r in got["hourly"].collect()} == {5.5: 1.0, 7.5: 6.0}
    assert {r.date.day: r.A for r in got["cumulative"].collect()} == {1: 1.0, 2: 0.0, 3: 7.0}


@pytest.mark.parametrize("rows", [[], [(datetime(2024, 1, 1, 5), "A", 10, 60.0, 2.0)]])
def test_nothing_selected(spark, rows):
    got = Dashboard(duration_min="100").frames(spark.createDataFrame(rows, CLIPS), KNOWN, ["A", "B"])
    assert got["totals"].first().asDict() == {"num_videos": 0, "num_days": 0, "num_frames": 0, "seconds": 0.0, "size_mb": 0.0}
    assert [got[n].count() for n in ("daily", "hourly", "cumulative")] == [0, 0, 0]


def test_projected_series_starts_at_the_last_actual_day(spark):
    counts = spark.createDataFrame([("a", date(2024, 1, 1), 4), ("a", date(2024, 1, 3), 2), ("b", date(2024, 1, 2), 7)], "device string, date date, value long")
    out = forecast_counts(counts, ["device"], 2, 14, bridge=True).filter("kind = 'projected'").orderBy("device", "date").collect()
    assert [(r.device, r.date.day) for r in out] == [("a", 3), ("a", 4), ("a", 5), ("b", 2), ("b", 3), ("b", 4)]
    first = out[0]
    assert (first["count"], first.count_lower, first.count_upper, first.cumulative, first.cumulative_lower, first.cumulative_upper) == (2, 2, 2, 6, 6, 6)


def test_embeddings_table(spark):
    people = spark.range(60).selectExpr(
        "id AS track_id", "CAST(id % 7 AS INT) AS frame_number", "concat('v', id % 5, '.mp4') AS video_filename",
        "IF(id = 3, NULL, array(CAST(id AS FLOAT), 0.5F)) AS embedding", "0.5D AS confidence", "id / 60.0D AS embedding_quality", "'x' AS timestamp")
    path = scratch_path(spark, "embeddings")
    docs.write_embeddings(people, path, timestamp="2024-01-01")
    back = docs.read_embeddings(spark, path)
    rows = {r.track_id: r for r in back.collect()}
    assert len(rows) == 60 and rows["5"].embedding == [5.0, 0.5] and rows["5"].embedding_dim == 2 and rows["3"].embedding is None
    assert {r.timestamp for r in rows.values()} == {"2024-01-01"}
    some = docs.read_embeddings(spark, path, ["v1.mp4"], 0.5)
    assert "PushedFilters: [" in some._jdf.queryExecution().toString() and some.count() == 6
    docs.write_embeddings(people.filter(F.lit(False)), path)
    assert docs.read_embeddings(spark, path).count() == 0

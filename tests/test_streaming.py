"""Streaming jobs over files that arrive one after another, and the session helpers."""

import os
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from motioncat import session
from motioncat.operators.catalog import dedup_clips, union_archives
from motioncat.streaming import jobs

SCHEMA = "filename string, serial string, dt timestamp, ts timestamp, duration_s double, file_size double"
START = datetime(2024, 1, 1)


def arrive(spark, folder, batches):
    """One Parquet file per batch, oldest first."""
    for i, minutes in enumerate(batches):
        rows = [(f"c{m}", "A1", START + timedelta(minutes=m), START + timedelta(minutes=m), 60.0, 1.0) for m in minutes]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/b{i}")
        for name in os.listdir(f"{folder}/b{i}"):
            os.utime(f"{folder}/b{i}/{name}", (time.time() - 1000 + i * 100,) * 2)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def test_late_rows_are_dropped_and_closed_windows_emitted(spark, tmp_path):
    stream = arrive(spark, tmp_path / "in", [[1, 5, 20], [300], [302], [2, 301], [700]])
    out = jobs.drain(jobs.rollup(stream, "1 hour", "30 minutes", ["serial"]), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r.start: r.clips for r in out.collect()}
    # a batch drops rows behind the watermark its predecessor ran with: 270 when minute 2 arrives;
    # the window of minute 700 stays open
    assert got == {START: 3, START + timedelta(hours=5): 3}


def test_sessions_join_at_exactly_the_gap(spark, tmp_path):
    stream = arrive(spark, tmp_path / "in", [[0, 10, 20], [31, 35], [5000]])
    out = jobs.drain(jobs.sessions(stream, "10 minutes", "1 hour", ["serial"]), str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted((r["first"].minute, r.clips) for r in out.collect())
    assert got == [(0, 3), (31, 2)]


def test_ingest_resumes_where_it_stopped(spark, tmp_path):
    stream = arrive(spark, tmp_path / "in", [[1, 2, 2], [2, 3]])
    paths = (str(tmp_path / "out"), str(tmp_path / "state"))
    first = jobs.drain(jobs.deduplicated(stream, "1 day"), *paths)
    assert sorted(r.filename for r in first.collect()) == ["c1", "c2", "c3"]
    arrive(spark, tmp_path / "in" / "later", [[3, 4]])
    again = jobs.drain(jobs.deduplicated(stream, "1 day"), *paths)
    assert sorted(r.filename for r in again.collect()) == ["c1", "c2", "c3", "c4"]


def test_occupancy_of_a_stream(spark, tmp_path):
    days = spark.createDataFrame([(START.date(), "OCCUPIED")], "date date, status string")
    stream = arrive(spark, tmp_path / "in", [[1], [2000]])
    out = jobs.drain(jobs.with_occupancy(stream, days), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.status for r in out.collect()) == ["OCCUPIED", "UNKNOWN"]


def test_small_side_falls_back(spark):
    rows = spark.range(10)
    assert session.small_side(rows, 9) is rows
    joined = spark.range(100).join(session.small_side(rows, 10), "id")
    assert "Broadcast" in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 10


def test_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_first_loaded_copy_of_a_hot_clip_stays(spark):
    hot = spark.range(5000).select(
        F.col("id").alias("load_seq"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("filename"),
        F.lit(START).cast("timestamp_ntz").alias("dt"), (F.col("id") * 2).alias("file_size"),
    )
    got = {r.filename: r.file_size for r in dedup_clips(hot.orderBy(F.desc("load_seq"))).collect()}
    assert got["hot"] == 0 and len(got) == 1 + 5000 - 1667
    second = hot.withColumn("file_size", F.lit(-1).cast("bigint"))
    assert {r.file_size < 0 for r in union_archives([hot, second]).collect()} == {False}

"""Streaming twins over the events table read as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from motioncat import fixtures as fx
from motioncat.fixtures import with_ctes
from motioncat.operators.devices import device_asof
from motioncat.operators.occupancy import calendar_expand
from motioncat.registry import query
from motioncat.registry.common import rounded
from motioncat.session import scratch_path
from motioncat.streaming import jobs


def clip_stream(spark, sf):
    """The clips projection over a file stream of the events."""
    schema = fx.table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    name = "concat('S', lpad(CAST(user_id % 8 AS STRING), 3, '0'), '_', date_format(ts, 'yyyyMMddHHmmss'), '.mp4')"
    return raw.selectExpr(
        "event_id AS load_seq", "concat('S', lpad(CAST(user_id % 8 AS STRING), 3, '0')) AS serial", f"{name} AS filename",
        "CAST(date_trunc('second', ts) AS TIMESTAMP_NTZ) AS dt", "date_trunc('second', ts) AS ts", "value AS duration_s", "value * 0.5D AS file_size",
    )


def drained(stream, name):
    spark = stream.sparkSession
    return jobs.drain(stream, scratch_path(spark, name), scratch_path(spark, f"{name}-state"))


@query("stream_ingest_dedup", with_ctes("clips", "SELECT DISTINCT filename, dt FROM clips"))
def stream_ingest_dedup(spark, sf):
    """Every clip arrives twice and is stored once."""
    twice = clip_stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    return drained(jobs.deduplicated(twice, "1 day"), "ingest").select("filename", "dt")


CLOSED = "(SELECT max(dt) - INTERVAL 1 DAY FROM clips)"


@query("stream_rollup", with_ctes("clipd", f"""SELECT date_trunc('day', dt) AS start, device, count(*) AS clips, round(sum(duration_s / 60), 6) AS minutes, round(sum(file_size), 6) AS mb FROM clipd
  GROUP BY 1, 2 HAVING date_trunc('day', dt) + INTERVAL 1 DAY <= {CLOSED}"""))
def stream_rollup(spark, sf):
    """Closed daily windows per device, the device looked up by a stream-static join."""
    named = device_asof(clip_stream(spark, sf), fx.devices(spark))
    out = drained(jobs.rollup(named, "1 day", "1 day", ["device"]), "daily")
    return rounded(out, "minutes", "mb").select(F.col("start").cast("timestamp_ntz").alias("start"), "device", "clips", "minutes", "mb")


@query("stream_rollup_quarter_hour", with_ctes("clips", f"""SELECT time_bucket(INTERVAL 15 MINUTE, dt) AS start, serial, count(*) AS clips, round(sum(duration_s / 60), 6) AS minutes, round(sum(file_size), 6) AS mb FROM clips
  GROUP BY 1, 2 HAVING time_bucket(INTERVAL 15 MINUTE, dt) + INTERVAL 15 MINUTE <= {CLOSED}"""))
def stream_rollup_quarter_hour(spark, sf):
    out = drained(jobs.rollup(clip_stream(spark, sf), "15 minutes", "1 day", ["serial"]), "quarter")
    return rounded(out, "minutes", "mb").select(F.col("start").cast("timestamp_ntz").alias("start"), "serial", "clips", "minutes", "mb")


@query("stream_sessions", with_ctes("clips", f"""WITH g AS (SELECT serial, dt, CASE WHEN dt - lag(dt) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS cut FROM clips WINDOW w AS (PARTITION BY serial ORDER BY dt)),
  s AS (SELECT serial, dt, sum(cut) OVER (PARTITION BY serial ORDER BY dt) AS session FROM g)
  SELECT serial, count(*) AS clips, min(dt) AS first, max(dt) AS last FROM s GROUP BY serial, session HAVING max(dt) + INTERVAL 30 MINUTE <= {CLOSED}"""))
def stream_sessions(spark, sf):
    out = drained(jobs.sessions(clip_stream(spark, sf), "30 minutes", "1 day", ["serial"]), "sessions")
    return out.select("serial", "clips", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"))


@query("stream_occupancy", with_ctes("clips caldays", """SELECT load_seq, filename, coalesce(status, 'UNKNOWN') AS status FROM clips c LEFT JOIN caldays d ON d.date = CAST(c.dt AS DATE)"""))
def stream_occupancy(spark, sf):
    days = calendar_expand(fx.calendar(spark))
    return drained(jobs.with_occupancy(clip_stream(spark, sf), days), "occupied").select("load_seq", "filename", "status")

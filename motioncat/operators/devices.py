"""Device dimension with validity dates: lookup, overlap check, distinct names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motioncat.session import small_side

ALWAYS = "TIMESTAMP_NTZ'0001-01-01 00:00:00'"
NEVER = "TIMESTAMP_NTZ'9999-12-31 00:00:00'"


def device_segments(devices: DataFrame, end_of_day: bool = False) -> DataFrame:
    """One row per serial and stretch of time with the device in force.

    The dimension is cut at every start and end; each stretch goes to the covering entry
    of lowest ``ord``, else to the serial's first entry. Stretches do not overlap, so a
    lookup finds one row per clip without a later aggregation. An end date stands for its
    midnight unless ``end_of_day`` is set.
    """
    last = "make_interval(0, 0, 0, 1)" if end_of_day else "make_interval(0, 0, 0, 0, 0, 0, 0.000001)"
    spans = devices.selectExpr(
        "serial",
        "ord",
        "device",
        f"coalesce(CAST(start_date AS TIMESTAMP_NTZ), {ALWAYS}) AS since",
        f"coalesce(CAST(end_date AS TIMESTAMP_NTZ) + {last}, {NEVER}) AS until",
    )
    cuts = spans.selectExpr("serial", f"explode(array({ALWAYS}, since, until)) AS seg_start").distinct()
    following = F.lead("seg_start", 1).over(Window.partitionBy("serial").orderBy("seg_start"))
    segments = cuts.select("serial", "seg_start", F.coalesce(following, F.expr(NEVER)).alias("seg_end"))
    entry = spans.alias("e")
    covering = (
        segments.alias("s")
        .join(
            entry,
            (F.col("s.serial") == F.col("e.serial"))
            & (F.col("e.since") <= F.col("s.seg_start"))
            & (F.col("s.seg_start") < F.col("e.until")),
        )
        .groupBy("s.serial", "s.seg_start")
        .agg(F.min_by("e.device", "e.ord").alias("covering"))
    )
    first = spans.groupBy("serial").agg(F.min_by("device", "ord").alias("first_device"))
    return (
        segments.join(covering, ["serial", "seg_start"], "left")
        .join(first, "serial")
        .select("serial", "seg_start", "seg_end", F.coalesce("covering", "first_device").alias("device"))
    )


def device_asof(clips: DataFrame, devices: DataFrame, ts: Column | None = None, end_of_day: bool = False) -> DataFrame:
    """Add ``device`` to clips: entry in force at ``ts`` (default ``dt``), else first entry, else serial."""
    when = F.col("dt") if ts is None else ts
    seg = small_side(device_segments(devices, end_of_day)).select(
        F.col("serial").alias("_serial"), "seg_start", "seg_end", F.col("device").alias("_device")
    )
    found = clips.join(
        seg,
        (F.col("serial") == F.col("_serial")) & (when >= F.col("seg_start")) & (when < F.col("seg_end")),
        "left",
    )
    return found.withColumn("device", F.coalesce("_device", "serial")).drop(
        "_serial", "seg_start", "seg_end", "_device"
    )


def device_overlaps(devices: DataFrame) -> DataFrame:
    """Entries whose end date reaches into the next entry of the same serial (open starts first)."""
    by_start = Window.partitionBy("serial").orderBy(F.col("start_date").asc_nulls_first(), "ord")
    return (
        devices.select(
            "serial",
            "device",
            "end_date",
            F.lead("device").over(by_start).alias("next_device"),
            F.lead("start_date").over(by_start).alias("next_start"),
        )
        .filter(F.col("end_date") >= F.col("next_start"))
    )


def validate_devices(devices: DataFrame) -> None:
    """Raise when a serial has overlapping validity dates."""
    clash = device_overlaps(devices).select("serial").limit(1).collect()
    if clash:
        raise ValueError(f"Overlapping date ranges for serial {clash[0].serial}")


def distinct_devices(devices: DataFrame) -> DataFrame:
    """Device names in order of first appearance."""
    return devices.groupBy("device").agg(F.min("ord").alias("first_ord")).orderBy("first_ord")


def devices_union(lists: DataFrame, column: str = "devices") -> DataFrame:
    """Every device that any of several selectors' lists names."""
    return lists.select(F.explode(column).alias("device")).distinct()

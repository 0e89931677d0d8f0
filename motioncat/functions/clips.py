"""Scalar expressions on clip columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ----
FALLBACK_TIME = "1900-01-01 00:00:00"
MAX_CONTAINER_SECONDS = 86400


def seconds_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_serial(path: Column) -> Column:
    """Text before the first underscore of the file name."""
    return F.split(basename(path), "_").getItem(0)


def path_time(path: Column) -> Column:
    """Time in the second underscore part (14 digits), null where it does not parse."""
    digits = F.substring(F.get(F.split(basename(path), "_"), F.lit(1)), 1, 14)
    stamp = F.when(digits.rlike("^[0-9]{14}$"), digits)
    iso = F.regexp_replace(stamp, "^(....)(..)(..)(..)(..)(..)$", "$1-$2-$3 $4:$5:$6")
    return iso.try_cast("timestamp_ntz")


def resolve_time(path: Column, container_utc: Column, file_time: Column, zone: str) -> Column:
    """Name time, else container time moved from UTC to ``zone``, else file time, else 1900."""
    local = F.from_utc_timestamp(container_utc.cast("timestamp"), zone).cast("timestamp_ntz")
    return F.coalesce(path_time(path), local, file_time, F.lit(FALLBACK_TIME).cast("timestamp_ntz"))


def repair_duration(container_s: Column, frames: Column, fps: Column) -> Column:
    """Replace an unusable container duration by (frames - 1) / fps where that can be computed."""
    computed = F.when((frames > 0) & (fps > 0), (frames - 1).cast("double") / fps)
    infinite = F.abs(container_s) == F.lit(float("inf"))
    unusable = F.isnan(container_s) | infinite | (container_s <= 0)
    too_long = computed.isNotNull() & (container_s > MAX_CONTAINER_SECONDS)
    return F.when(unusable | too_long, F.coalesce(computed, container_s)).otherwise(container_s)


def hour_bin(ts: Column, bins_per_hour: int) -> Column:
    """Hour of day as a decimal, moved to the middle of its bin."""
    minutes = F.minute(ts) + F.second(ts) / F.lit(60.0)
    index = F.floor(minutes / F.lit(60.0 / bins_per_hour)).cast("double")
    return F.hour(ts) + index / F.lit(float(bins_per_hour)) + F.lit(1.0 / (2 * bins_per_hour))


def decimal_hour_label(hours: Column) -> Column:
    """13.125 becomes 13:07:30, each part truncated."""
    h = F.floor(hours)
    minutes = (hours - h) * 60
    m = F.floor(minutes)
    s = F.floor((minutes - m) * 60)
    return F.format_string("%02d:%02d:%02d", h, m, s)

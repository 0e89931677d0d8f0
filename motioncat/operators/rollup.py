"""Daily and hourly rollups, kept in long form until the last step."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motioncat.functions.clips import hour_bin

METRICS = ("activity", "duration", "filesize")


def _measure(metric: str) -> Column:
    if metric == "activity":
        return F.count("*")
    if metric == "duration":
        return F.sum(F.col("duration_s") / 60)
    if metric == "filesize":
        return F.sum("file_size")
    raise ValueError(f"metric {metric!r} is none of {METRICS}")


def rollup_long(clips: DataFrame, metric: str, time_key: Column, name: str) -> DataFrame:
    """(time key, device, value), combined before the shuffle."""
    return clips.groupBy(time_key.alias(name), "device").agg(_measure(metric).alias("value"))


def to_wide(long: DataFrame, name: str, devices: list[str]) -> DataFrame:
    """One column per device in alphabetical order; the list is given, so no extra job finds it."""
    return long.groupBy(name).pivot("device", sorted(devices)).agg(F.first("value")).fillna(0)


def daily(clips: DataFrame, metric: str, devices: list[str]) -> DataFrame:
    return to_wide(rollup_long(clips, metric, F.to_date("dt"), "date"), "date", devices)


def hourly(clips: DataFrame, metric: str, devices: list[str], bins_per_hour: int = 4) -> DataFrame:
    return to_wide(rollup_long(clips, metric, hour_bin(F.col("dt"), bins_per_hour), "hour"), "hour", devices)


def densify_dates(wide: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Every date from first to last (per key), zero where there was no row."""
    keys = keys or []
    bounds = wide.groupBy(*keys).agg(F.min("date").alias("_lo"), F.max("date").alias("_hi")).filter("_lo IS NOT NULL")
    days = bounds.select(*keys, F.explode(F.expr("sequence(_lo, _hi, INTERVAL 1 DAY)")).alias("date"))
    return days.join(wide, [*keys, "date"], "left").fillna(0)


def row_total(wide: DataFrame, known_devices: list[str]) -> DataFrame:
    """Sum over the columns of known devices; zero becomes null, a gap in the line."""
    present = [F.col(f"`{d}`") for d in known_devices if d in wide.columns]
    total = reduce(lambda a, b: a + b, present) if present else F.lit(0)
    return wide.withColumn("total", F.nullif(total, F.lit(0)))


def cumulative_daily(clips: DataFrame, metric: str, devices: list[str]) -> DataFrame:
    """Running sum per device over the dates that have clips; missing dates then show 0."""
    return cumulative(daily(clips, metric, devices), devices)


def cumulative(wide: DataFrame, devices: list[str]) -> DataFrame:
    """Running sums of a daily table; dates that it lacks show 0."""
    long = wide.unpivot("date", [f"`{d}`" for d in sorted(devices)], "device", "value")
    upto = Window.partitionBy("device").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    summed = long.select("date", "device", F.sum("value").over(upto).alias("value"))
    return densify_dates(to_wide(summed, "date", devices))


def forecast_counts(
    counts: DataFrame, keys: list[str], days_ahead: int, max_days: int, manual_daily: float | None = None, bridge: bool = False
) -> DataFrame:
    """Actual daily counts with running totals, then ``days_ahead`` projected days per key.

    ``counts`` has (keys, date, value). Projection: mean and population deviation of the
    last ``max_days`` days; totals widen with the square root of the days ahead. With ``bridge``
    the projected series of a key starts with its last actual day, whose bounds are its values.
    """
    dense = densify_dates(counts, keys)
    upto = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    value = F.col("value").cast("double")
    actual = dense.select(
        *keys, "date", F.lit("actual").alias("kind"), value.alias("count"), F.sum(value).over(upto).alias("cumulative")
    )
    last = dense.groupBy(*keys).agg(F.max("date").alias("last_date"), F.sum(value).alias("total"))
    recent = dense.join(last, keys).filter(F.datediff("last_date", "date") < max_days)
    stats = recent.groupBy(*keys, "last_date", "total").agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("dev")
    )
    if manual_daily is not None:
        stats = stats.withColumn("mean", F.lit(float(manual_daily))).withColumn("dev", F.lit(manual_daily * 0.2))
    step = F.col("step").cast("double")
    reach = F.col("dev") * F.sqrt(step)
    ahead = stats.select("*", F.explode(F.sequence(F.lit(1), F.lit(days_ahead))).alias("step"))
    center = F.col("total") + F.col("mean") * step
    projected = ahead.select(
        *keys,
        F.date_add("last_date", F.col("step")).alias("date"),
        F.lit("projected").alias("kind"),
        F.col("mean").alias("count"),
        F.greatest(F.lit(0.0), F.col("mean") - F.col("dev")).alias("count_lower"),
        (F.col("mean") + F.col("dev")).alias("count_upper"),
        center.alias("cumulative"),
        F.greatest(F.lit(0.0), center - reach).alias("cumulative_lower"),
        (center + reach).alias("cumulative_upper"),
    )
    if bridge:
        both = actual.join(last.select(*keys, F.col("last_date").alias("date")), [*keys, "date"], "left_semi")
        bounds = {f"{c}_{end}": F.col(c) for c in ("count", "cumulative") for end in ("lower", "upper")}
        projected = projected.unionByName(both.withColumns({"kind": F.lit("projected"), **bounds}))
    return actual.unionByName(projected, allowMissingColumns=True)

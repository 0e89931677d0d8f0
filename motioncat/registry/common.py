"""Shared starting points of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motioncat import fixtures as fx
from motioncat.operators.devices import device_asof


def clipd(spark: SparkSession, sf: str) -> DataFrame:
    """Clips with their device of the day."""
    return device_asof(fx.clips(spark, sf), fx.devices(spark))


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(f"`{n}`").cast("double"), digits) for n in names})


def sql_day(metric: str) -> str:
    """SQL twin of the wide daily rollup."""
    return sql_wide(metric, "CAST(dt AS DATE)", "date")


def sql_wide(metric: str, key: str, name: str, source: str = "clipd") -> str:
    cols = []
    for d in sorted(fx.PIVOT_DEVICES):
        hit = f"device = '{d}'"
        if metric == "activity":
            cols.append(f"CAST(count(*) FILTER (WHERE {hit}) AS BIGINT) AS \"{d}\"")
        else:
            value = "duration_s / 60" if metric == "duration" else "file_size"
            cols.append(f"round(coalesce(sum({value}) FILTER (WHERE {hit}), 0), 6) AS \"{d}\"")
    return f"SELECT {key} AS {name}, {', '.join(cols)} FROM {source} GROUP BY 1"

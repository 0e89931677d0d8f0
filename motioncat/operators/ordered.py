"""Running values over keys of any size.

A plain window holds one key in one task. Here rows are range-partitioned on
(keys, order), so a hot key spans many partitions; each partition computes its own
running values and adds what the earlier partitions of the same key carry over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motioncat.session import materialize


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column],
) -> DataFrame:
    """Add inclusive running sums along ``order`` within ``keys``.

    ``order`` must be unique within ``keys``. The row-to-partition assignment is frozen
    by writing it out, so a recomputed task cannot shift rows between partitions.
    """
    for name, value in sums.items():
        df = df.withColumn(f"_v_{name}", value)
    part = materialize(
        df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges"
    )
    within = (
        Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = part.groupBy(*keys, "_part").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    carried = carried.select(
        *keys, "_part", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums]
    )
    out = part.select("*", *[F.sum(f"_v_{n}").over(within).alias(f"_l_{n}") for n in sums])
    out = out.join(carried, [*keys, "_part"])
    out = out.select("*", *[(F.col(f"_l_{n}") + F.col(f"_c_{n}")).alias(n) for n in sums])
    return out.drop("_part", *[f"_{p}_{n}" for n in sums for p in "vlc"])


def sessions(df: DataFrame, keys: list[str], order: str, max_gap: Column | float, name: str = "session") -> DataFrame:
    """Number the runs of rows of a key, from 0, whose steps in ``order`` do not exceed ``max_gap``.

    A scan over range partitions: each partition marks its own gaps; its first row of a key looks
    at the greatest value that earlier partitions of the key carry over, and the number of gaps
    in these is added to its own.
    """
    df = df.withColumns({"_key": F.struct(*keys), "_at": F.col(order)})  # structs with a null field are equal
    part = materialize(df.repartitionByRange("_key", "_at").withColumn("_part", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("_key", "_part").orderBy("_at")
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    edges = part.groupBy("_key", "_part").agg(F.max("_at").alias("_high"))
    edges = edges.select("_key", "_part", F.max("_high").over(earlier).alias("_carried"))
    seen = part.join(edges, ["_key", "_part"])
    step = F.col("_at") - F.coalesce(F.lag("_at").over(within), "_carried")
    cut = seen.withColumn("_cut", F.coalesce((step > max_gap).cast("long"), F.lit(0).cast("long"))).drop("_carried")
    cut = materialize(cut.withColumn("_own", F.sum("_cut").over(within.rowsBetween(Window.unboundedPreceding, 0))), "cuts")
    totals = cut.groupBy("_key", "_part").agg(F.sum("_cut").alias("_cuts"))
    totals = totals.select("_key", "_part", F.coalesce(F.sum("_cuts").over(earlier), F.lit(0)).alias("_before"))
    out = cut.join(totals, ["_key", "_part"]).withColumn(name, F.col("_own") + F.col("_before"))
    return out.drop("_key", "_at", "_part", "_cut", "_own", "_before")

"""Comparison of two runs by name and the pick of the best one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values ----
SIGNIFICANT, MODERATE = 0.01, 0.005


def compare_runs(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Changes from baseline to candidate for runs both have, with a verdict on quality."""
    a, b = baseline.alias("a"), candidate.alias("b")
    joined = a.join(b, F.col("a.name") == F.col("b.name"))
    change = lambda c: F.col(f"b.{c}") - F.col(f"a.{c}")
    gain = change("avg_quality")
    verdict = F.when(gain > SIGNIFICANT, "significant").when(gain > MODERATE, "moderate").otherwise("none")
    return joined.select(
        F.col("a.name").alias("name"), change("num_clusters").alias("cluster_change"), gain.alias("quality_change"),
        change("min_quality").alias("precision_change"),
        F.when(F.col("a.fps") > 0, F.col("b.fps") / F.col("a.fps")).otherwise(0.0).alias("speedup"), verdict.alias("verdict"),
    )


def fastest_run(runs: DataFrame) -> DataFrame:
    best = runs.agg(F.min_by(F.struct("name", "num_clusters", "fps"), F.struct(-F.col("fps"), F.col("name"))).alias("b"))
    return best.filter("b IS NOT NULL").select(
        F.lit("fastest").alias("kind"), F.col("b.name").alias("name"), F.col("b.num_clusters").alias("num_clusters"), F.col("b.fps").alias("score")
    )

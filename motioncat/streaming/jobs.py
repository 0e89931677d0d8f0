"""Structured Streaming forms of the ingest, rollup, session and occupancy jobs.

Every job takes a stream of clips with a ``ts`` timestamp. Windows leave the state once
the watermark passes their end, so state is bounded by the delay, not by the stream.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def deduplicated(clips: DataFrame, delay: str) -> DataFrame:
    """First arrival of each (filename, dt) within ``delay``."""
    return clips.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["filename", "dt"])


def rollup(clips: DataFrame, window: str, delay: str, keys: list[str]) -> DataFrame:
    """Clips, minutes and megabytes per window and key; rows later than ``delay`` are dropped."""
    w = F.window("ts", window)
    return clips.withWatermark("ts", delay).groupBy(w, *keys).agg(
        F.count("*").alias("clips"), F.sum(F.col("duration_s") / 60).alias("minutes"), F.sum("file_size").alias("mb")
    ).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "clips", "minutes", "mb")


def sessions(clips: DataFrame, gap: str, delay: str, keys: list[str]) -> DataFrame:
    """Runs of clips without a gap above ``gap`` per key."""
    s = F.session_window("ts", gap)
    return clips.withWatermark("ts", delay).groupBy(s, *keys).agg(
        F.count("*").alias("clips"), F.min("ts").alias("first"), F.max("ts").alias("last")
    ).select(*keys, "clips", "first", "last")


def with_occupancy(clips: DataFrame, days: DataFrame) -> DataFrame:
    """Stream joined with the expanded calendar (date, status); UNKNOWN outside it."""
    dated = clips.withColumn("date", F.to_date("ts"))
    return dated.join(days, "date", "left").withColumn("status", F.coalesce("status", F.lit("UNKNOWN")))


def _append_once(path: str):
    """Batch writer keyed by batch id: a repeated batch replaces its own rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataStreamWriter:
    """Writer into Parquet, exactly once; ``availableNow`` drains what is there and stops."""
    return (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .foreachBatch(_append_once(path)).trigger(availableNow=True)
    )


def drain(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run the stream over all available input and return the table it wrote."""
    spark: SparkSession = stream.sparkSession
    run = to_table(stream, path, checkpoint).start()
    run.awaitTermination()
    try:
        return spark.read.schema(stream.schema).option("basePath", path).parquet(f"{path}/batch=*")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], stream.schema)  # no batch had rows

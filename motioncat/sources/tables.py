"""Small dimension files: devices and the occupancy calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motioncat.operators.ordered import running


def read_devices(spark: SparkSession, path: str) -> DataFrame:
    """Device CSV in file order (``ord`` from 1); an empty or unreadable date is open.

    Part files count in the order of their names, as ``write_devices`` leaves them.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    day = lambda c: (
        F.when(F.trim(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.trim(c)).try_cast("date") if c in raw.columns else F.lit(None).cast("date")
    )
    placed = raw.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row")
    )
    numbered = running(placed, [], ["_file", "_block", "_row"], {"ord": F.lit(1)})
    return numbered.select(
        "ord", F.col("Serial").alias("serial"), F.col("Device").alias("device"), day("start_date").alias("start_date"), day("end_date").alias("end_date")
    )


def write_devices(devices: DataFrame, path: str, files: int | None = None) -> None:
    """Device CSV by ``ord``; ``files`` part files, or as many as Spark sees fit."""
    ordered = devices.orderBy("ord") if files is None else devices.repartitionByRange(files, "ord").sortWithinPartitions("ord")
    out = ordered.select(F.col("serial").alias("Serial"), F.col("device").alias("Device"), "start_date", "end_date")
    out.write.mode("overwrite").option("header", True).csv(path)


def write_occupancy_csv(days: DataFrame, path: str) -> None:
    """``date,occupancy_status`` sorted by date."""
    out = days.select("date", F.col("status").alias("occupancy_status"))
    out.orderBy("date").write.mode("overwrite").option("header", True).csv(path)


def read_occupancy_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("date date, occupancy_status string").option("header", True).csv(path)

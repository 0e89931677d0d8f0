"""Tag tables kept bucketed by their merge key, so that merging them moves no row.

A store is a Parquet table with one row per tag: (filename, frame_number, hash) is unique, ``hash``
is the 16-byte identity of the tag, and rows are bucketed by these three columns and sorted by them
inside a bucket. Merges of stores are left anti joins of a side with the key columns of the sides
that win over it: buckets meet bucket by bucket, and only winners' payload is read on. Stores that
merge must have the same number of buckets (other numbers are right too, but shuffle).
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motioncat.functions.boxes import tag_hash
from motioncat.operators.tags import FRAME
from motioncat.session import scratch_path, small_side

KEY = [*FRAME, "hash"]
SIDES_AT_ONCE = 6
BUCKET_ROWS = 500_000


def _name(path: str) -> str:
    return "tag_store_" + hashlib.md5(path.rstrip("/").encode()).hexdigest()


def _save(rows: DataFrame, path: str, buckets: int) -> DataFrame:
    spark = rows.sparkSession
    name = _name(path)
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")  # forgets the name of an external table; files stay until overwritten
    rows.write.bucketBy(buckets, *KEY).sortBy(*KEY).mode("overwrite").option("path", path).saveAsTable(name)
    return spark.table(name)


def write_store(tags: DataFrame, path: str, buckets: int = 200) -> DataFrame:
    """Write tags as a store and return it; of equal tags the one with the greatest ``ord`` is kept.

    A tag whose file or frame is null has no place in a store and is refused by an error at run time.
    """
    placed = F.col("filename").isNotNull() & F.col("frame_number").isNotNull()
    checked = F.when(placed, F.unhex(tag_hash())).otherwise(F.raise_error(F.lit("a tag needs a file and a frame")).cast("binary"))
    keyed = tags.drop("hash").withColumn("hash", checked)
    rest = [c for c in keyed.columns if c not in KEY]
    # rows move once, to their bucket, in which equal tags meet
    last = keyed.repartition(buckets, *KEY).groupBy(*KEY).agg(F.max_by(F.struct(*rest), "ord").alias("_row"))
    rows = last.select(*KEY, *[F.col(f"_row.{c}").alias(c) for c in rest])
    return _save(rows, path, buckets)


def buckets_for(rows: int) -> int:
    """Number of buckets for stores of about ``rows`` tags, a power of two: a bucket holds ``BUCKET_ROWS`` at most."""
    return 8 << max(0, math.ceil(math.log2(max(1, rows) / (8 * BUCKET_ROWS))))


def open_store(spark: SparkSession, path: str, buckets: int, schema: str) -> DataFrame:
    """A store written by another session; ``schema`` and ``buckets`` are those it was written with."""
    name = _name(path)
    keys = ", ".join(KEY)
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    spark.sql(f"CREATE TABLE `{name}` ({schema}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def merge_stores(stores: list[DataFrame], later_wins: bool = True, buckets: int = 200) -> DataFrame:
    """Union of stores by key with ``side``, the number of the store a tag is from.

    More than ``SIDES_AT_ONCE`` stores are merged in groups, whose results are stores of ``buckets`` buckets.
    """
    return _merge([s.withColumn("side", F.lit(i)) for i, s in enumerate(stores)], later_wins, buckets)


def _merge(sides: list[DataFrame], later_wins: bool, buckets: int) -> DataFrame:
    if len(sides) > SIDES_AT_ONCE:
        groups = [sides[i : i + SIDES_AT_ONCE] for i in range(0, len(sides), SIDES_AT_ONCE)]
        spark = sides[0].sparkSession
        merged = [_save(_merge(g, later_wins, buckets), scratch_path(spark, "tags"), buckets) for g in groups]
        return _merge(merged, later_wins, buckets)
    won = []
    for i, side in enumerate(sides):
        winners = sides[i + 1 :] if later_wins else sides[:i]
        won.append(reduce(lambda left, w: left.join(w.select(*KEY), KEY, "left_anti"), winners, side))
    return reduce(DataFrame.unionByName, won)


def attach_store(existing: DataFrame, incoming: DataFrame, clips: DataFrame, mode: str = "ADD") -> DataFrame:
    """Put a store of incoming tags on the clips of a catalog, keeping (ADD) or dropping (REPLACE) old tags of matched clips.

    Names of clips are broadcast after a check of their size; beyond it the file name decides by shuffle.
    """
    names = clips.select("filename").distinct()
    matched = incoming.join(small_side(names), "filename", "left_semi")
    if mode.upper() == "REPLACE":
        replaced = matched.select("filename").distinct()
        existing = existing.join(small_side(replaced), "filename", "left_anti")
    elif mode.upper() != "ADD":
        raise ValueError(f"mode must be ADD or REPLACE, not {mode!r}")
    return _merge([existing, matched.select(*existing.columns)], False, 0)

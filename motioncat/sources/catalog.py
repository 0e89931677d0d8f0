"""Clip catalog: metadata CSV, file listing, cached table, playlist."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motioncat.operators.catalog import dedup_clips, playlist_lines
from motioncat.operators.ordered import running

# ---- fixed values: header and formats of the metadata file ----
CSV_COLUMNS = {
    "Date Time": ("dt", "timestamp_ntz"),
    "Duration": ("duration_s", "double"),
    "Device": ("device", "string"),
    "Serial": ("serial", "string"),
    "Filename": ("filename", "string"),
    "Full Path": ("full_path", "string"),
    "File Size": ("file_size", "double"),
    "Width": ("width", "int"),
    "Height": ("height", "int"),
    "Frame Count": ("frame_count", "bigint"),
    "FPS": ("fps", "double"),
    "Video Codec": ("video_codec", "string"),
}
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
TIME_PATTERN = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"
VIDEO_EXTENSIONS = ("mp4", "mov")
CSV_NAMES = [name for name, _ in CSV_COLUMNS.values()]


def write_catalog_csv(clips: DataFrame, path: str) -> None:
    """Write the 12 columns in fixed order, sorted by time."""
    out = clips.select(*CSV_NAMES).orderBy("dt", "filename")
    shown = [
        (F.date_format(n, TIME_FORMAT) if n == "dt" else F.col(n)).alias(title) for title, (n, _) in CSV_COLUMNS.items()
    ]
    out.select(*shown).write.mode("overwrite").option("header", True).csv(path)


def _parsed(title: str) -> Column:
    name, kind = CSV_COLUMNS[title]
    text = F.col(f"`{title}`")
    if kind == "string":
        return text.alias(name)
    if kind == "timestamp_ntz":
        return F.when(text.rlike(TIME_PATTERN), text).try_cast(kind).alias(name)
    return F.trim(text).try_cast(kind).alias(name)


def read_catalog_csv(spark: SparkSession, paths: list[str] | str) -> tuple[DataFrame, DataFrame, list[str]]:
    """(clips, rejected rows, missing files) of metadata files in load order.

    A row with a field that does not parse is left out; a missing file is reported and
    skipped. The first loaded row of a (filename, dt) stays.
    """
    schema = ", ".join(f"`{title}` string" for title in CSV_COLUMNS)
    rows, missing = None, []
    for i, path in enumerate([paths] if isinstance(paths, str) else paths):
        try:
            # a byte order mark before the header is stripped by the reader
            one = spark.read.schema(schema).option("header", True).csv(path)
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            missing.append(path)
            continue
        place = F.struct(
            F.lit(i).alias("file"), F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        )
        one = one.select("*", place.alias("_place"))
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        empty = spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in CSV_COLUMNS.values()))
        return empty, spark.createDataFrame([], schema), missing
    parsed = rows.select(*[_parsed(t) for t in CSV_COLUMNS], "_place", F.struct(*[f"`{t}`" for t in CSV_COLUMNS]).alias("_raw"))
    whole = F.lit(True)
    for name, kind in CSV_COLUMNS.values():
        if kind != "string":
            whole = whole & F.col(name).isNotNull()
    clips = dedup_clips(parsed.filter(whole).drop("_raw"), order="_place").drop("_place")
    return clips, parsed.filter(~whole).select("_raw.*"), missing


def scan_listing(spark: SparkSession, directories: list[str], extensions: tuple[str, ...] = VIDEO_EXTENSIONS) -> tuple[DataFrame, list[str]]:
    """(files, directories without usable files): path, size in MiB and time of the files directly inside.

    Only the listing is read: the file contents are pruned from the scan.
    """
    found, skipped = None, []
    either_case = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions]
    for directory in directories:
        try:
            files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(either_case) + "}").load(directory)
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            skipped.append(directory)
            continue
        files = files.select(
            F.col("path").alias("full_path"), (F.col("length") / (1024 * 1024)).alias("file_size"),
            F.col("modificationTime").cast("timestamp_ntz").alias("file_time"), F.lit(None).cast("timestamp_ntz").alias("container_utc"),
        )
        found = files if found is None else found.unionByName(files)
    if found is None:
        found = spark.createDataFrame([], "full_path string, file_size double, file_time timestamp_ntz, container_utc timestamp_ntz")
    return found, skipped


# ---- cached table ----

def write_catalog_table(clips: DataFrame, path: str) -> None:
    """Parquet partitioned by month, so that a date range reads only its months.

    Rows are brought together by month for few files, and adaptive execution splits a month
    that is too large for one task.
    """
    dated = clips.withColumn("date", F.to_date("dt")).withColumn("month", F.date_format("dt", "yyyy-MM"))
    dated.hint("rebalance", "month").write.mode("overwrite").partitionBy("month").parquet(path)


def read_catalog_table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.option("basePath", path).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def months_between(table: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Rows of the months a date range touches (partition pruning)."""
    if start is not None:
        table = table.filter(F.col("month") >= start[:7])
    if end is not None:
        table = table.filter(F.col("month") <= end[:7])
    return table


def resolve_catalog(spark: SparkSession, cache: str | None, scan=None, force: bool = False) -> DataFrame | None:
    """Cached catalog, or the result of ``scan()``, which then refreshes the cache.

    ``scan`` is None when a source directory is missing. Scans when forced or when there is
    no cache; None when neither is usable or nothing is found.
    """
    cached = read_catalog_table(spark, cache) if cache else None
    if scan is None and cached is None:
        return None
    if scan is not None and (force or cached is None):
        rows = dedup_clips(scan())
        if cache:
            write_catalog_table(rows, cache)
            rows = read_catalog_table(spark, cache)
        out = rows
    else:
        out = cached
    return None if out is None or out.isEmpty() else out


def write_playlist(clips: DataFrame, path: str) -> None:
    """Extended M3U text: the header, then the clips by time; part files are in order."""
    lines = playlist_lines(clips).select(F.lit(1).alias("_k"), "dt", "filename", "value")
    header = clips.sparkSession.range(1).select(
        F.lit(0).alias("_k"), F.lit(None).cast("timestamp_ntz").alias("dt"), F.lit("").alias("filename"), F.lit("#EXTM3U").alias("value")
    )
    header.unionByName(lines).orderBy("_k", "dt", "filename").select("value").write.mode("overwrite").text(path)


def read_playlist(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a playlist with their ``line`` number, from 1, over its part files in order."""
    placed = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row")
    )
    return running(placed, [], ["_file", "_block", "_row"], {"line": F.lit(1)}).select("line", "value")

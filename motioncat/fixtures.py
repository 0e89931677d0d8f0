"""Adapters that give the given tables the clip, tag and embedding shapes.

Every adapter exists twice: as a DataFrame and as a DuckDB common table expression of
the same name, so that a query and its check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---- fixed values: the small dimensions shared by both engines ----
DEVICES_SQL = """
SELECT * FROM (VALUES
  (1, 'S000', 'Backyard', CAST(NULL AS DATE), CAST(NULL AS DATE)),
  (2, 'S001', 'Garage', CAST(NULL AS DATE), DATE '2024-01-14'),
  (3, 'S002', 'Garage', DATE '2024-01-15', CAST(NULL AS DATE)),
  (4, 'S002', 'Balcony', CAST(NULL AS DATE), DATE '2024-01-14'),
  (5, 'S001', 'Balcony', DATE '2024-01-15', CAST(NULL AS DATE)),
  (6, 'S003', 'Front Door', CAST(NULL AS DATE), CAST(NULL AS DATE)),
  (7, 'S004', 'Walkway', CAST(NULL AS DATE), CAST(NULL AS DATE)),
  (8, 'S005', 'Backyard', CAST(NULL AS DATE), CAST(NULL AS DATE)),
  (9, 'S006', 'Gateway', DATE '2024-03-01', CAST(NULL AS DATE))
) AS t(ord, serial, device, start_date, end_date)
"""
CALENDAR_SQL = """
SELECT * FROM (VALUES
  (1, DATE '2024-01-01', DATE '2024-01-06', 'OCCUPIED'),
  (2, DATE '2024-01-06', DATE '2024-01-12', 'NOT_OCCUPIED'),
  (3, DATE '2024-01-13', DATE '2024-01-13', 'OCCUPIED'),
  (4, DATE '2024-01-16', DATE '2024-01-28', 'NOT_OCCUPIED')
) AS t(ord, start_date, end_date, status)
"""
ALL_DEVICES = ["Backyard", "Garage", "Balcony", "Front Door", "Walkway", "Gateway"]
PIVOT_DEVICES = ["Backyard", "Balcony", "Front Door", "Garage", "Gateway", "S007", "Walkway"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-spread a table that comes in fewer splits than there are cores, such as one small file.

    A table of many files is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def devices(spark: SparkSession) -> DataFrame:
    return spark.sql(DEVICES_SQL)


def calendar(spark: SparkSession) -> DataFrame:
    return spark.sql(CALENDAR_SQL)


def clips(spark: SparkSession, sf: str) -> DataFrame:
    name = "concat('S', lpad(CAST(user_id % 8 AS STRING), 3, '0'), '_', date_format(ts, 'yyyyMMddHHmmss'), '.mp4')"
    return table(spark, sf, "events").selectExpr(
        "event_id AS load_seq",
        "concat('S', lpad(CAST(user_id % 8 AS STRING), 3, '0')) AS serial",
        f"{name} AS filename",
        f"concat('/archive/', event_type, '/', {name}) AS full_path",
        "CAST(date_trunc('second', ts) AS TIMESTAMP_NTZ) AS dt",
        "value AS duration_s",
        "value * 0.5D AS file_size",
        "CASE event_type WHEN 'view' THEN 1920 WHEN 'click' THEN 2304 ELSE 1600 END AS width",
        "CASE event_type WHEN 'view' THEN 1080 WHEN 'click' THEN 1296 ELSE 1200 END AS height",
        "CAST(floor(value * 15) AS BIGINT) AS frame_count",
        "CASE event_id % 3 WHEN 0 THEN 15.0D WHEN 1 THEN 20.0D ELSE 30.0D END AS fps",
        "CASE event_id % 2 WHEN 0 THEN 'h264' ELSE 'hevc' END AS video_codec",
    )


def tags(spark: SparkSession, sf: str) -> DataFrame:
    """One row per detection; ``ord`` is the insertion order, unique over the table."""
    return spread(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey").selectExpr(
        "concat_ws('|', lpad(l_orderkey, 12, '0'), l_linenumber, lpad(l_partkey, 12, '0'),"
        " lpad(l_suppkey, 12, '0'), lpad(CAST(round(l_extendedprice * 100) AS BIGINT), 14, '0')) AS ord",
        "concat('V', CAST(l_suppkey AS STRING)) AS filename",
        "CAST((l_partkey % 40) * 5 AS INT) AS frame_number",
        "CASE WHEN l_linestatus = 'O' THEN 'TRACKED_OBJECT' ELSE 'DETECTED_OBJECT' END AS type",
        "CASE l_returnflag WHEN 'A' THEN 'person' WHEN 'N' THEN 'car' ELSE 'dog' END AS value",
        "l_discount * 10 AS confidence",
        "CAST(l_orderkey % 60 AS BIGINT) AS track_id",
        "CAST(l_quantity AS INT) * 4 AS x1",
        "CAST(l_partkey % 7 AS INT) * 10 AS y1",
        "CAST(l_quantity AS INT) * 4 + 40 + l_linenumber * 10 AS x2",
        "CAST(l_partkey % 7 AS INT) * 10 + 80 + l_linenumber * 10 AS y2",
    )


def people(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings: four jittered copies of every given vector."""
    return (
        spread(table(spark, sf, "embeddings"), "vec_id")
        .selectExpr("*", "explode(array(0, 1, 2, 3)) AS c")
        .selectExpr(
            "vec_id * 4 + c AS ord",
            "vec_id",
            "label",
            "concat('V', CAST(label AS STRING), '.mp4') AS video_filename",
            "CAST(vec_id AS STRING) AS track_id",
            "CAST((vec_id * 7 + c * 13) % 300 AS INT) AS frame_number",
            "0.2D + ((vec_id * 37 + c * 11) % 80) / 100.0D AS confidence",
            "0.2D + ((vec_id * 53 + c * 17) % 80) / 100.0D AS embedding_quality",
            "transform(embedding, (x, i) -> CAST(x AS DOUBLE) * (1 + 0.2D * c * ((i + vec_id + c) % 3 - 1))) AS embedding",
        )
    )


_NAME = (
    "concat('S', lpad(CAST(user_id % 8 AS VARCHAR), 3, '0'), '_', strftime(ts, '%Y%m%d%H%M%S'), '.mp4')"
)

CTES: dict[str, str] = {
    "devices": DEVICES_SQL,
    "calendar": CALENDAR_SQL,
    "clips": f"""
SELECT event_id AS load_seq, concat('S', lpad(CAST(user_id % 8 AS VARCHAR), 3, '0')) AS serial,
  {_NAME} AS filename, concat('/archive/', event_type, '/', {_NAME}) AS full_path,
  date_trunc('second', ts) AS dt, value AS duration_s, value * CAST(0.5 AS DOUBLE) AS file_size,
  CASE event_type WHEN 'view' THEN 1920 WHEN 'click' THEN 2304 ELSE 1600 END AS width,
  CASE event_type WHEN 'view' THEN 1080 WHEN 'click' THEN 1296 ELSE 1200 END AS height,
  CAST(floor(value * 15) AS BIGINT) AS frame_count,
  CAST(CASE event_id % 3 WHEN 0 THEN 15.0 WHEN 1 THEN 20.0 ELSE 30.0 END AS DOUBLE) AS fps,
  CASE event_id % 2 WHEN 0 THEN 'h264' ELSE 'hevc' END AS video_codec
FROM events""",
    "clipd": """
SELECT c.*, coalesce(
  (SELECT arg_min(d.device, d.ord) FROM devices d WHERE d.serial = c.serial
     AND (d.start_date IS NULL OR c.dt >= d.start_date) AND (d.end_date IS NULL OR c.dt <= d.end_date)),
  (SELECT arg_min(d.device, d.ord) FROM devices d WHERE d.serial = c.serial), c.serial) AS device
FROM clips c""",
    "caldays": """
SELECT date, arg_max(status, ord) AS status FROM (
  SELECT ord, status, CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS date FROM calendar)
GROUP BY date""",
    "tags": """
SELECT concat_ws('|', lpad(CAST(l_orderkey AS VARCHAR), 12, '0'), l_linenumber, lpad(CAST(l_partkey AS VARCHAR), 12, '0'),
    lpad(CAST(l_suppkey AS VARCHAR), 12, '0'), lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), 14, '0')) AS ord,
  concat('V', CAST(l_suppkey AS VARCHAR)) AS filename, CAST((l_partkey % 40) * 5 AS INT) AS frame_number,
  CASE WHEN l_linestatus = 'O' THEN 'TRACKED_OBJECT' ELSE 'DETECTED_OBJECT' END AS type,
  CASE l_returnflag WHEN 'A' THEN 'person' WHEN 'N' THEN 'car' ELSE 'dog' END AS value,
  l_discount * 10 AS confidence, CAST(l_orderkey % 60 AS BIGINT) AS track_id,
  CAST(l_quantity AS INT) * 4 AS x1, CAST(l_partkey % 7 AS INT) * 10 AS y1,
  CAST(l_quantity AS INT) * 4 + 40 + l_linenumber * 10 AS x2,
  CAST(l_partkey % 7 AS INT) * 10 + 80 + l_linenumber * 10 AS y2
FROM lineitem""",
    "people": """
SELECT e.vec_id * 4 + k.c AS ord, e.vec_id, e.label, concat('V', CAST(e.label AS VARCHAR), '.mp4') AS video_filename,
  CAST(e.vec_id AS VARCHAR) AS track_id, CAST((e.vec_id * 7 + k.c * 13) % 300 AS INT) AS frame_number,
  CAST(0.2 AS DOUBLE) + ((e.vec_id * 37 + k.c * 11) % 80) / CAST(100 AS DOUBLE) AS confidence,
  CAST(0.2 AS DOUBLE) + ((e.vec_id * 53 + k.c * 17) % 80) / CAST(100 AS DOUBLE) AS embedding_quality,
  list_transform(e.embedding, lambda x, i: CAST(x AS DOUBLE) * (1 + CAST(0.2 AS DOUBLE) * k.c * (((i - 1) + e.vec_id + k.c) % 3 - 1))) AS embedding
FROM embeddings e CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS c) k""",
}
_NEEDS = {"clipd": ("clips", "devices"), "caldays": ("calendar",)}


def with_ctes(names: str, sql: str, recursive: bool = False) -> str:
    """Prefix ``sql`` with the named common table expressions and those they need."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, ()):
            add(need)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        add(name)
    body = sql.strip()
    head = ", ".join(f"{n} AS ({CTES[n].strip()})" for n in wanted)
    word = "WITH RECURSIVE " if recursive else "WITH "
    if body.upper().startswith("WITH "):
        body = body[5:]
        return f"{word}{head}, {body}" if head else f"{word}{body}"
    return f"{word}{head} {body}" if head else body

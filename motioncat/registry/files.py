"""Sources and sinks: every query writes its input to the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from motioncat import fixtures as fx
from motioncat.fixtures import with_ctes
from motioncat.operators.catalog import dedup_clips
from motioncat.registry import query
from motioncat.registry.catalog import SQL_DEDUP, derived_devices, SQL_DERIVED
from motioncat.registry.clusters import BY_VEC, by_label
from motioncat.registry.common import clipd, rounded
from motioncat.registry.tags import HASH
from motioncat.session import scratch_path
from motioncat.sources import catalog as src
from motioncat.sources import documents as docs
from motioncat.sources import tables

CSV_SQL = "dt, duration_s, device, serial, filename, full_path, file_size, width, height, frame_count, fps, video_codec"


@query("scan_catalog_csv", with_ctes("clipd", f"SELECT {CSV_SQL} FROM ({SQL_DEDUP.format(src='(SELECT * FROM clipd WHERE load_seq % 97 <> 0)')})"))
def scan_catalog_csv(spark, sf):
    """Some rows are damaged on disk and must be left out; a missing file is reported, not fatal."""
    path = scratch_path(spark, "catalog-csv")
    clips = clipd(spark, sf)
    text = clips.select(*[
        (F.date_format("dt", src.TIME_FORMAT) if n == "dt" else F.col(n).cast("string")).alias(t) for t, (n, _) in src.CSV_COLUMNS.items()
    ], "load_seq")
    hurt = F.col("load_seq") % 97 == 0
    text = text.withColumn("Duration", F.when(hurt & (F.col("load_seq") % 2 == 0), "unknown").otherwise(F.col("Duration")))
    text = text.withColumn("Width", F.when(hurt & (F.col("load_seq") % 2 == 1), "12.5").otherwise(F.col("Width"))).drop("load_seq")
    text.write.option("header", True).csv(path)
    found, _, missing = src.read_catalog_csv(spark, [path, path + "-absent"])
    assert missing == [path + "-absent"]
    return found


@query("write_catalog_csv", with_ctes("clipd", f"SELECT {CSV_SQL} FROM ({SQL_DEDUP.format(src='clipd')})"))
def write_catalog_csv(spark, sf):
    path = scratch_path(spark, "catalog-out")
    src.write_catalog_csv(dedup_clips(clipd(spark, sf)), path)
    return src.read_catalog_csv(spark, path)[0]


@query("scan_listing", with_ctes("clips", "SELECT serial, count(DISTINCT serial) AS files, CAST(sum(length(filename) + 1) AS BIGINT) AS bytes FROM clips GROUP BY serial"))
def scan_listing(spark, sf):
    """One folder with one file per serial; they are listed with their sizes, and an absent folder is reported."""
    path = scratch_path(spark, "listing")
    clips = fx.clips(spark, sf).select("serial", "filename")
    clips.repartition("serial").write.partitionBy("serial").text(path)
    folders = [f"{path}/serial={r.serial}" for r in clips.select("serial").distinct().collect()]  # eight cameras
    files, skipped = src.scan_listing(spark, [*folders, path + "/serial=none"], extensions=("txt",))
    assert skipped == [path + "/serial=none"]
    serial = F.regexp_extract("full_path", "serial=([^/]+)/", 1)
    return files.groupBy(serial.alias("serial")).agg(F.count("*").alias("files"), F.sum(F.round(F.col("file_size") * 1024 * 1024).cast("bigint")).alias("bytes"))


@query("catalog_resolve_source", with_ctes("clips", f"SELECT load_seq, filename, dt FROM ({SQL_DEDUP.format(src='clips')})"))
def catalog_resolve_source(spark, sf):
    """First call scans and fills the cache, the second reads it."""
    cache = scratch_path(spark, "catalog-cache")
    src.resolve_catalog(spark, cache, scan=lambda: fx.clips(spark, sf))
    return src.resolve_catalog(spark, cache).select("load_seq", "filename", "dt")


@query("catalog_month_pruning", with_ctes("clips", f"SELECT load_seq, filename, dt FROM ({SQL_DEDUP.format(src='clips')}) WHERE dt >= TIMESTAMP '2024-01-10' AND dt < TIMESTAMP '2024-01-21'"))
def catalog_month_pruning(spark, sf):
    from motioncat.plans.selectors import Selector, select_clips

    cache = scratch_path(spark, "catalog-cache")
    src.write_catalog_table(dedup_clips(fx.clips(spark, sf)), cache)
    table = src.months_between(src.read_catalog_table(spark, cache), "2024-01-10", "2024-01-20")
    return select_clips(table, Selector(date_range=("2024-01-10", "2024-01-20")), day="date").select("load_seq", "filename", "dt")


TAG_ROW = "filename, frame_number, hash, type, value, round(confidence, 6) AS confidence, track_id, is_new_track, x1, y1, x2, y2"
SQL_TAG_ROWS = f"""SELECT {TAG_ROW}, '2024-02-01T00:00:00' AS timestamp FROM (
  SELECT *, ord LIKE '%7' AS is_new_track, {HASH} AS hash FROM tags QUALIFY row_number() OVER (PARTITION BY filename, frame_number, hash ORDER BY ord DESC) = 1)"""


def marked_tags(spark, sf):
    return fx.tags(spark, sf).withColumn("is_new_track", F.col("ord").like("%7"))


@query("scan_tags_json", with_ctes("tags", SQL_TAG_ROWS))
def scan_tags_json(spark, sf):
    """Of equal tags of a frame the one inserted last comes back, with every field."""
    path = scratch_path(spark, "tags-json")
    docs.write_tags_json(marked_tags(spark, sf), path, "2024-02-01T00:00:00", {"model": "any", "task": "Track"})
    return rounded(docs.read_tags_json(spark, path), "confidence")


@query("write_tags_json", with_ctes("tags", f"""WITH r AS ({SQL_TAG_ROWS}) SELECT filename, frame_number, hash, count(*) AS copies, bool_and(timestamp = '2024-02-01T00:00:00') AS stamped,
  max(type) AS type, max(value) AS value, max(confidence) AS confidence, max(track_id) AS track_id, bool_or(is_new_track) AS is_new_track FROM r GROUP BY 1, 2, 3"""))
def write_tags_json(spark, sf):
    """Each tag comes back exactly once, with its payload and the time of its file."""
    path = scratch_path(spark, "tags-json")
    docs.write_tags_json(marked_tags(spark, sf), path, "2024-02-01T00:00:00")
    back = rounded(docs.read_tags_json(spark, path), "confidence")
    return back.groupBy("filename", "frame_number", "hash").agg(
        F.count("*").alias("copies"), F.bool_and(F.col("timestamp") == "2024-02-01T00:00:00").alias("stamped"),
        *[F.max(c).alias(c) for c in ("type", "value", "confidence", "track_id")], F.bool_or("is_new_track").alias("is_new_track"),
    )


PEOPLE_SQL = "SELECT video_filename, track_id, frame_number, confidence, embedding_quality, CAST(len(embedding) AS INT) AS embedding_dim, round(list_sum(embedding), 6) AS total FROM people"


@query("scan_embeddings", with_ctes("people", PEOPLE_SQL))
def scan_embeddings(spark, sf):
    """A broken document lies among the good ones and is skipped."""
    path = scratch_path(spark, "embeddings-json")
    docs.write_embeddings_json(fx.people(spark, sf), path)
    broken = fx.table(spark, sf, "embeddings").select(F.concat(F.lit('{"embeddings": [{'), F.col("vec_id").cast("string")).alias("value"))
    broken.write.mode("append").text(path + "/broken")
    back = docs.read_embeddings_json(spark, path + "/{part-*,broken/part-*}")
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6)
    return back.select("video_filename", "track_id", "frame_number", "confidence", "embedding_quality", "embedding_dim", total.alias("total"))


@query("write_embeddings", with_ctes("people", PEOPLE_SQL))
def write_embeddings(spark, sf):
    """The columnar form of the same table."""
    path = scratch_path(spark, "embeddings-table")
    docs.write_embeddings(fx.people(spark, sf), path)
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6)
    return docs.read_embeddings(spark, path).select(
        "video_filename", "track_id", "frame_number", "confidence", "embedding_quality", "embedding_dim", total.alias("total")
    )


@query("scan_clusters", with_ctes("people", f"""{BY_VEC} SELECT 'standard' AS clustering_type, cluster AS cluster_id, cluster_size, round(avg_similarity, 6) AS avg_similarity, round(min_similarity, 6) AS min_similarity, round(quality_score, 6) AS quality_score FROM cq
  UNION ALL SELECT 'conservative', cluster, cluster_size, 0.95, 0.90, 0.95 FROM cq"""))
def scan_clusters(spark, sf):
    """Both layouts side by side; the conservative one has no similarities and gets its defaults."""
    clusters = by_label(spark, sf, "vec_id")
    members = fx.people(spark, sf).withColumnRenamed("vec_id", "cluster")
    path = scratch_path(spark, "clusters-json")
    docs.write_clusters_json(clusters, members, path + "/standard")
    docs.write_clusters_json(clusters, members, path + "/conservative", kind="conservative")
    return rounded(docs.read_clusters_json(spark, path + "/*")[0], "avg_similarity", "min_similarity", "quality_score")


@query("write_clusters", with_ctes("people", "SELECT vec_id AS cluster_id, video_filename, track_id, frame_number, confidence, embedding_quality FROM people"))
def write_clusters(spark, sf):
    members = fx.people(spark, sf).withColumnRenamed("vec_id", "cluster")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("cluster_size"))
    path = scratch_path(spark, "clusters-json")
    docs.write_clusters_json(sizes, members, path, kind="conservative")
    return docs.read_clusters_json(spark, path)[1].drop("clustering_type")


@query("scan_devices", f"WITH {SQL_DERIVED} SELECT serial, device, CASE WHEN ord % 13 = 0 THEN NULL ELSE start_date END AS start_date, end_date, row_number() OVER (ORDER BY ord) AS ord FROM dd")
def scan_devices(spark, sf):
    """Some start dates are unreadable and must become open; the order must hold over several part files."""
    path = scratch_path(spark, "devices-csv")
    start = F.when(F.col("ord") % 13 == 0, "31/12/2024").otherwise(F.col("start_date").cast("string"))
    tables.write_devices(derived_devices(spark, sf).withColumn("start_date", start), path, files=4)
    return tables.read_devices(spark, path)

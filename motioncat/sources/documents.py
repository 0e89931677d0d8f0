"""Nested JSON documents: tags, embeddings and clusters.

Writers emit many documents of bounded size, each valid on its own, instead of one that
holds everything; readers take any number of documents and flatten them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motioncat.functions.boxes import tag_hash
from motioncat.session import small_side

# ---- fixed values ----
TAG_STRUCT = (
    "struct<type: string, value: string, confidence: string, bounding_box: struct<x1: int, y1: int, x2: int, y2: int>,"
    " track_id: bigint, is_new_track: boolean>"
)
TAG_DOC = f"timestamp string, tag_processing_config map<string, string>, tags map<string, map<string, map<string, {TAG_STRUCT}>>>"
PERSON_COLUMNS = (
    "track_id string, frame_number int, video_filename string, embedding array<double>, embedding_type string,"
    " confidence double, embedding_quality double, timestamp string, embedding_dim int"
)
PERSON_STRUCT = f"struct<{PERSON_COLUMNS}>"
EMBEDDING_DOC = f"metadata struct<total_embeddings: bigint, embedding_dim: int>, embeddings array<{PERSON_STRUCT}>, _broken string"
MEMBER_STRUCT = "struct<track_id: string, frame_number: int, video_filename: string, confidence: double, embedding_quality: double>"
CLUSTER_STRUCT = (
    "struct<cluster_id: bigint, cluster_size: bigint, quality_score: double, avg_similarity: double, min_similarity: double,"
    f" embeddings: array<{MEMBER_STRUCT}>>"
)
CLUSTER_DOC = f"metadata struct<clustering_type: string>, clusters array<{CLUSTER_STRUCT}>"
CONSERVATIVE_DEFAULTS = {"avg_similarity": 0.95, "min_similarity": 0.90, "quality_score": 0.95}
DOC_ROWS = 5000


def _documents(rows: DataFrame, keys: list[str], spread: Column) -> DataFrame:
    """Add ``_doc``: rows of one key split into as many documents as its size needs; rows without key are left out.

    Only keys of more than one document are looked up, which are few and broadcast, so that no row moves for this.
    """
    counts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / DOC_ROWS).alias("_docs")).filter("_docs > 1").dropna(subset=keys)
    split = rows.dropna(subset=keys).join(small_side(counts), keys, "left")
    return split.withColumn("_doc", F.pmod(F.xxhash64(spread), F.coalesce("_docs", F.lit(1).cast("long")))).drop("_docs")


# ---- tags ----

def write_tags_json(tags: DataFrame, path: str, timestamp: str, config: dict[str, str] | None = None) -> None:
    """Documents ``{timestamp, tag_processing_config, tags: {file: {frame: {hash: tag}}}}``, in files packed by gzip."""
    made = "hash" not in tags.columns
    key = tag_hash() if made else F.col("hash").cast("string")
    box = F.struct("x1", "y1", "x2", "y2")
    tag = F.struct(
        "type", "value", F.col("confidence").cast("string").alias("confidence"), box.alias("bounding_box"), "track_id",
        (F.col("is_new_track") if "is_new_track" in tags.columns else F.lit(None).cast("boolean")).alias("is_new_track"),
    )
    order = F.col("ord") if "ord" in tags.columns else tag
    flat = tags.select("filename", F.col("frame_number").cast("string").alias("frame"), F.unhex(key).alias("hash") if made else key.alias("hash"), tag.alias("tag"), order.alias("order"))
    # A row's document follows from its identity, so rows move once, and equal tags meet in their document.
    docs = _documents(flat, ["filename"], F.struct("frame", "hash")).repartition("filename", "_doc")
    # equal tags of one frame are one entry: the one that was inserted last, at the place of the first
    docs = docs.groupBy("filename", "_doc", "frame", "hash").agg(F.max_by("tag", "order").alias("tag"), F.min("order").alias("order"))
    docs = docs.withColumn("hash", F.lower(F.hex("hash"))) if made else docs
    placed = F.transform(F.sort_array(F.collect_list(F.struct("order", "hash", "tag"))), lambda t: F.struct(t["hash"], t["tag"]))
    per_frame = docs.groupBy("filename", "_doc", "frame").agg(F.map_from_entries(placed).alias("m"))
    per_doc = per_frame.groupBy("filename", "_doc").agg(F.map_from_entries(F.collect_list(F.struct("frame", "m"))).alias("m"))
    settings = F.lit(None).cast("map<string,string>") if not config else F.create_map(*[F.lit(x) for kv in config.items() for x in kv])
    per_doc.select(
        F.lit(timestamp).alias("timestamp"), settings.alias("tag_processing_config"), F.create_map("filename", "m").alias("tags")
    ).write.mode("overwrite").option("compression", "gzip").json(path)


def read_tags_json(spark: SparkSession, path: str, multi_line: bool = False, placed: bool = False) -> DataFrame:
    """Flat tags of all documents; nothing for a missing path. ``multi_line`` reads one indented document per file.

    With ``placed`` there is also ``place``, the position of a tag among those of its frame in the document.
    """
    try:
        docs = spark.read.schema(TAG_DOC).option("multiLine", multi_line).json(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        docs = spark.createDataFrame([], TAG_DOC)
    frames = docs.select("timestamp", F.explode("tags").alias("filename", "frames"))
    hashes = frames.select("timestamp", "filename", F.explode("frames").alias("frame", "hashes"))
    return hashes.select("timestamp", "filename", F.col("frame").try_cast("int").alias("frame_number"), F.posexplode("hashes").alias("place", "hash", "tag")).select(
        "timestamp", "filename", "frame_number", "hash", *(["place"] if placed else []), "tag.type", "tag.value", F.col("tag.confidence").try_cast("double").alias("confidence"),
        "tag.track_id", "tag.is_new_track", "tag.bounding_box.x1", "tag.bounding_box.y1", "tag.bounding_box.x2", "tag.bounding_box.y2",
    )


# ---- embeddings ----

def write_embeddings_json(people: DataFrame, path: str, kind: str = "clip", timestamp: str = "") -> None:
    """Documents ``{metadata, embeddings: [...]}``, one or more per video."""
    item = F.struct(
        F.col("track_id").cast("string").alias("track_id"), "frame_number", "video_filename", "embedding", F.lit(kind).alias("embedding_type"),
        "confidence", "embedding_quality", F.lit(timestamp).alias("timestamp"), F.size("embedding").alias("embedding_dim"),
    )
    docs = _documents(people.select("video_filename", item.alias("item")), ["video_filename"], F.struct("item.track_id", "item.frame_number"))
    packed = docs.groupBy("video_filename", "_doc").agg(F.sort_array(F.collect_list("item")).alias("embeddings"))
    meta = F.struct(F.size("embeddings").cast("bigint").alias("total_embeddings"), F.get("embeddings", F.lit(0))["embedding_dim"].alias("embedding_dim"))
    packed.select(meta.alias("metadata"), "embeddings").write.mode("overwrite").json(path)


def read_embeddings_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Embeddings of all readable documents; broken ones are skipped."""
    docs = spark.read.schema(EMBEDDING_DOC).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("multiLine", multi_line).json(path)
    return docs.filter("_broken IS NULL").select(F.explode("embeddings").alias("e")).select("e.*")


def write_embeddings(people: DataFrame, path: str, kind: str = "clip", timestamp: str = "") -> None:
    """The columnar form of the embeddings: Parquet with the columns of the JSON form.

    Rows are range-partitioned and sorted by video and frame, so that a reader that asks for some
    videos skips the other row groups, and a video of any size spans files.
    """
    rows = people.select(
        F.col("track_id").cast("string").alias("track_id"), F.col("frame_number").cast("int").alias("frame_number"), "video_filename",
        F.col("embedding").cast("array<double>").alias("embedding"), F.lit(kind).alias("embedding_type"),
        F.col("confidence").cast("double").alias("confidence"), F.col("embedding_quality").cast("double").alias("embedding_quality"),
        F.lit(timestamp).alias("timestamp"), F.size("embedding").alias("embedding_dim"),
    )
    order = ["video_filename", "frame_number", "track_id"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def read_embeddings(spark: SparkSession, path: str, videos: list[str] | None = None, min_quality: float | None = None) -> DataFrame:
    """Embeddings of a columnar table; the criteria reach the scan."""
    rows = spark.read.schema(PERSON_COLUMNS).parquet(path)
    rows = rows if videos is None else rows.filter(F.col("video_filename").isin(videos))
    return rows if min_quality is None else rows.filter(F.col("embedding_quality") >= min_quality)


# ---- clusters ----

def write_clusters_json(clusters: DataFrame, members: DataFrame, path: str, kind: str = "standard") -> None:
    """Documents ``{metadata, clusters: [...]}``; a very large cluster continues in further documents.

    ``clusters`` has one row per ``cluster``; ``members`` has (cluster, member columns).
    """
    item = F.struct(F.col("track_id").cast("string").alias("track_id"), "frame_number", "video_filename", "confidence", "embedding_quality")
    parts = _documents(members.select("cluster", item.alias("item")), ["cluster"], F.col("item"))
    packed = parts.groupBy("cluster", "_doc").agg(F.sort_array(F.collect_list("item")).alias("embeddings"))
    numbers = ["avg_similarity", "min_similarity", "quality_score"]
    if kind == "conservative":
        clusters = clusters.drop(*numbers)
    kept = [c for c in numbers if c in clusters.columns]
    entry = F.struct(F.col("cluster").alias("cluster_id"), "cluster_size", *kept, "embeddings")
    packed.join(clusters.select("cluster", "cluster_size", *kept), "cluster").select(
        F.struct(F.lit(kind).alias("clustering_type")).alias("metadata"), F.array(entry).alias("clusters")
    ).write.mode("overwrite").json(path)


def read_clusters_json(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(clusters, members); conservative clusters get their default similarities and score."""
    docs = spark.read.schema(CLUSTER_DOC).option("multiLine", multi_line).json(path)
    kind = F.coalesce("metadata.clustering_type", F.lit("standard"))
    rows = docs.select(kind.alias("clustering_type"), F.explode("clusters").alias("c"))

    def filled(name: str) -> Column:
        default = F.lit(CONSERVATIVE_DEFAULTS[name])
        return F.when(F.col("clustering_type") == "conservative", default).otherwise(F.col(f"c.{name}")).alias(name)

    clusters = rows.select("clustering_type", "c.cluster_id", "c.cluster_size", *[filled(n) for n in CONSERVATIVE_DEFAULTS]).distinct()
    members = rows.select("clustering_type", "c.cluster_id", F.explode("c.embeddings").alias("m")).select("clustering_type", "cluster_id", "m.*")
    return clusters, members

"""JSON documents of labels, persons (mega-clusters) and profiles.

As with tags, a writer leaves documents of bounded size, each valid on its own, and readers take
any number of them; the totals in ``metadata`` are those of the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motioncat.sources.documents import DOC_ROWS

# ---- fixed values: fields of the documents and what a missing one means ----
LABEL = "struct<cluster_id bigint, label string, confidence double, notes string, verified boolean, timestamp string>"
LABEL_DOC = f"metadata struct<timestamp string, total_labels bigint, total_clusters bigint>, labels array<{LABEL}>"
MEGA = (
    "struct<mega_id string, person_name string, cluster_ids array<bigint>, confidence double, notes string,"
    " created_timestamp string, modified_timestamp string, total_clusters bigint>"
)
MEGA_DOC = f"metadata struct<timestamp string, total_mega_clusters bigint, total_clustered bigint, total_unclustered bigint>, mega_clusters array<{MEGA}>"
PROFILE = (
    "struct<person_name string, mega_cluster_id string, representative_embedding array<double>, embedding_mean array<double>,"
    " embedding_std array<double>, similarity_threshold double, confidence_threshold double, total_training_samples bigint, last_updated string>"
)
PROFILE_DOC = f"metadata struct<timestamp string, total_profiles bigint>, profiles map<string, {PROFILE}>"
CONFIDENCE, PROFILE_CONFIDENCE = 1.0, 0.8


def _filled(rows: DataFrame, name: str, kind: str, default=None) -> Column:
    """Column ``name`` as ``kind``, or the default where there is none."""
    value = F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)
    return (value if default is None else F.coalesce(value, F.lit(default).cast(kind))).alias(name)


def _dealt(rows: DataFrame, total: int, key: str, size: int = DOC_ROWS) -> DataFrame:
    return rows.withColumn("_doc", F.pmod(F.xxhash64(key), F.lit(-(-max(total, 1) // size))))


def write_labels_json(labels: DataFrame, path: str, timestamp: str, total_clusters: int = 0) -> None:
    """Documents ``{metadata, labels: [...]}`` of labels with (cluster_id, label) and what else they carry."""
    total = labels.count()
    item = F.struct(
        "cluster_id", "label", _filled(labels, "confidence", "double", CONFIDENCE), _filled(labels, "notes", "string", ""),
        _filled(labels, "verified", "boolean", False), _filled(labels, "timestamp", "string", timestamp),
    )
    meta = F.struct(F.lit(timestamp).alias("timestamp"), F.lit(total).alias("total_labels"), F.lit(total_clusters).alias("total_clusters"))
    packed = _dealt(labels, total, "cluster_id").groupBy("_doc").agg(F.sort_array(F.collect_list(item)).alias("labels"))
    packed.select(meta.alias("metadata"), "labels").write.mode("overwrite").json(path)


def read_labels_json(spark: SparkSession, path: str, timestamp: str = "", multi_line: bool = False) -> DataFrame:
    """Labels of all documents, one a cluster; of several the one with the latest time. ``timestamp`` stands in for a missing one."""
    rows = spark.read.schema(LABEL_DOC).option("multiLine", multi_line).json(path).select(F.explode("labels").alias("l")).select("l.*")
    defaults = {"confidence": CONFIDENCE, "notes": "", "verified": False, "timestamp": timestamp}
    rows = rows.withColumns({n: F.coalesce(n, F.lit(v)) for n, v in defaults.items()})
    last = rows.groupBy("cluster_id").agg(F.max(F.struct("timestamp", "label", "confidence", "notes", "verified")).alias("l"))
    return last.select("cluster_id", "l.label", "l.confidence", "l.notes", "l.verified", "l.timestamp")


def write_megas_json(members: DataFrame, path: str, timestamp: str, total_clusters: int | None = None) -> None:
    """Documents ``{metadata, mega_clusters: [...]}`` of rows (mega_id, cluster_id) and, if there, person_name and notes.

    A person of very many clusters continues in further documents under the same id.
    """
    sizes = members.groupBy("mega_id").agg(F.count("*").alias("total_clusters"))
    t = sizes.agg(F.count("*").alias("megas"), F.coalesce(F.sum("total_clusters"), F.lit(0)).alias("members")).first()
    meta = F.struct(
        F.lit(timestamp).alias("timestamp"), F.lit(t.megas).alias("total_mega_clusters"), F.lit(t.members).alias("total_clustered"),
        F.lit(max((total_clusters or t.members) - t.members, 0)).alias("total_unclustered"),
    )
    rows = members.select(
        F.col("mega_id").cast("string").alias("mega_id"), F.col("cluster_id").cast("bigint").alias("cluster_id"),
        F.coalesce(_filled(members, "person_name", "string"), F.col("mega_id").cast("string")).alias("person_name"), _filled(members, "notes", "string", ""),
    )
    sizes = sizes.withColumn("mega_id", F.col("mega_id").cast("string"))
    part = F.pmod(F.xxhash64("cluster_id"), F.ceil(F.col("total_clusters") / DOC_ROWS))
    parts = rows.join(sizes, "mega_id").withColumn("_part", part).groupBy("mega_id", "_part").agg(
        F.min("person_name").alias("person_name"), F.min("notes").alias("notes"), F.max("total_clusters").alias("total_clusters"),
        F.sort_array(F.collect_list("cluster_id")).alias("cluster_ids"),
    )
    item = F.struct(
        "mega_id", "person_name", "cluster_ids", F.lit(CONFIDENCE).alias("confidence"), "notes",
        F.lit(timestamp).alias("created_timestamp"), F.lit(timestamp).alias("modified_timestamp"), "total_clusters",
    )
    parts.select(meta.alias("metadata"), F.array(item).alias("mega_clusters")).write.mode("overwrite").json(path)


def read_megas_json(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(persons, members): one row a mega-cluster, and (cluster_id, mega_id) of each member, once."""
    rows = spark.read.schema(MEGA_DOC).option("multiLine", multi_line).json(path).select(F.explode("mega_clusters").alias("m")).select("m.*")
    megas = rows.groupBy("mega_id").agg(
        F.min("person_name").alias("person_name"), F.max(F.coalesce("confidence", F.lit(CONFIDENCE))).alias("confidence"),
        F.min(F.coalesce("notes", F.lit(""))).alias("notes"), F.min("created_timestamp").alias("created_timestamp"),
        F.max("modified_timestamp").alias("modified_timestamp"),
    )
    return megas, rows.select(F.explode("cluster_ids").alias("cluster_id"), "mega_id").distinct()


def write_profiles_json(profiles: DataFrame, path: str, timestamp: str, person: str = "person") -> None:
    """Documents ``{metadata, profiles: {name: profile}}`` of profiles as ``person_profiles`` returns them, one person each."""
    total = profiles.count()
    body = F.struct(
        F.col(person).cast("string").alias("person_name"), F.coalesce(_filled(profiles, "mega_cluster_id", "string"), F.col(person).cast("string")).alias("mega_cluster_id"),
        F.col("profile").alias("representative_embedding"), F.col("profile").alias("embedding_mean"), F.col("std").alias("embedding_std"),
        F.col("threshold").alias("similarity_threshold"), _filled(profiles, "confidence_threshold", "double", PROFILE_CONFIDENCE),
        F.col("samples").alias("total_training_samples"), F.lit(timestamp).alias("last_updated"),
    )
    meta = F.struct(F.lit(timestamp).alias("timestamp"), F.lit(total).alias("total_profiles"))
    profiles.select(meta.alias("metadata"), F.create_map(F.col(person).cast("string"), body).alias("profiles")).write.mode("overwrite").json(path)


def read_profiles_json(spark: SparkSession, path: str, person: str = "person", multi_line: bool = False) -> DataFrame:
    """Profiles for matching and auto-labelling: (person, profile, std, samples, threshold, confidence_threshold, last_updated)."""
    rows = spark.read.schema(PROFILE_DOC).option("multiLine", multi_line).json(path).select(F.explode("profiles").alias("name", "p"))
    return rows.select(
        F.col("name").alias(person), F.col("p.representative_embedding").alias("profile"), F.col("p.embedding_std").alias("std"),
        F.coalesce("p.total_training_samples", F.lit(0).cast("bigint")).alias("samples"), F.col("p.similarity_threshold").alias("threshold"),
        F.coalesce("p.confidence_threshold", F.lit(PROFILE_CONFIDENCE)).alias("confidence_threshold"), F.coalesce("p.last_updated", F.lit("")).alias("last_updated"),
    )

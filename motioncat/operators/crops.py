"""Matching embeddings to the crop files they came from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motioncat.functions.boxes import parse_crop_name


def match_crops(people: DataFrame, files: DataFrame) -> DataFrame:
    """Add the best ``crop`` of each embedding and its ``rank``.

    Rank 1: same track under the track pattern, 2: same number under the detection pattern,
    3: detection named by the frame. Each rank is an equality, so a video with many crops
    in a frame never meets them all.
    """
    tokens = parse_crop_name(F.col("crop"))
    parsed = files.select("crop", tokens["video"].alias("video"), tokens["frame_number"].alias("frame"), tokens["kind"].alias("kind"), tokens["track_number"].alias("num"))
    digits = F.regexp_extract_all("track_id", F.lit(r"(\d+)"), F.lit(1))
    number = F.coalesce(F.try_element_at(digits, F.lit(-1)).cast("bigint"), F.lit(0).cast("bigint"))
    keyed = people.select("ord", F.replace("video_filename", F.lit(".mp4"), F.lit("")).alias("video"), F.col("frame_number").alias("frame"), number.alias("track"))
    wanted = keyed.select(
        "ord", "video", "frame",
        F.explode(F.array(
            F.struct(F.lit(1).alias("rank"), F.lit("track").alias("kind"), F.col("track").alias("num")),
            F.struct(F.lit(2).alias("rank"), F.lit("detect").alias("kind"), F.col("track").alias("num")),
            F.struct(F.lit(3).alias("rank"), F.lit("detect").alias("kind"), F.col("frame").cast("bigint").alias("num")),
        )).alias("w"),
    ).select("ord", "video", "frame", "w.rank", "w.kind", "w.num")
    # several files may parse to the same tokens; one is enough
    unique = parsed.groupBy("video", "frame", "kind", "num").agg(F.min("crop").alias("crop"))
    found = wanted.join(unique, ["video", "frame", "kind", "num"])
    best = found.groupBy("ord").agg(F.min(F.struct("rank", "crop")).alias("b"))
    return people.join(best, "ord", "left").select(people["*"], F.col("b.crop").alias("crop"), F.col("b.rank").alias("rank"))

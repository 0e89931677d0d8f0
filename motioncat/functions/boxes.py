"""Expressions on bounding boxes, tag identity and crop file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ["x1", "y1", "x2", "y2"]


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union; 0 for disjoint boxes and for an empty union."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    area = lambda r: (r["x2"] - r["x1"]).cast("double") * (r["y2"] - r["y1"])
    inter = w.cast("double") * h
    union = area(a) + area(b) - inter
    return F.when((w < 0) | (h < 0) | (union <= 0), F.lit(0.0)).otherwise(inter / union)


def named(prefix: str) -> dict[str, Column]:
    """Box columns of a joined side, e.g. ``named('a.')``."""
    return {c: F.col(f"{prefix}{c}") for c in BOX}


def of_struct(s: Column) -> dict[str, Column]:
    return {c: s[c] for c in BOX}


def tag_hash() -> Column:
    """Identity of a tag: file, frame, value and box."""
    return F.md5(F.concat_ws("|", "filename", "frame_number", "value", "x1", "x2", "y1", "y2"))


def global_track_id(run: str) -> Column:
    """Track id unique over runs, files and values."""
    return F.md5(F.concat_ws("|", F.lit(run), F.col("filename"), F.col("value"), F.col("track_id").cast("string")))


def geometry() -> dict[str, Column]:
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return {
        "width": w,
        "height": h,
        "area": w * h,
        "center_x": F.floor((F.col("x1") + F.col("x2")) / 2),
        "center_y": F.floor((F.col("y1") + F.col("y2")) / 2),
    }


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def crop_name(video: Column, frame: Column, track: Column) -> Column:
    """``{video}_frame-{06d}_track-{id}.jpg``; ids starting with ``det_`` become ``detect-{rest}``."""
    safe = F.regexp_replace(track, r"[/\\]", "_")
    part = F.when(safe.startswith("det_"), F.concat(F.lit("detect-"), F.substring(safe, 5, 1000000))).otherwise(
        F.concat(F.lit("track-"), safe)
    )
    return F.concat(without_extension(video), F.format_string("_frame-%06d_", frame), part, F.lit(".jpg"))


def parse_crop_name(name: Column) -> dict[str, Column]:
    """Video, frame and track tokens of a crop file name; the track is the last run of digits."""
    ident = F.regexp_extract(name, r"_(?:track|detect)-(.*)\.jpg$", 1)
    digits = F.regexp_extract_all(ident, F.lit(r"(\d+)"), F.lit(1))
    return {
        "video": F.regexp_extract(name, r"^(.*)_frame-\d+_", 1),
        "frame_number": F.regexp_extract(name, r"_frame-(\d+)_", 1).cast("int"),
        "kind": F.regexp_extract(name, r"_(track|detect)-", 1),
        "ident": ident,
        "track_number": F.try_element_at(digits, F.lit(-1)).cast("bigint"),
    }

"""Runs of many stories: a configuration, and the files that each story leaves."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motioncat.operators import rollup
from motioncat.operators.catalog import catalog_stats
from motioncat.operators.tags import tag_database
from motioncat.plans.story import Story
from motioncat.session import forget, materialize
from motioncat.sources.catalog import read_catalog_csv, write_catalog_csv, write_playlist
from motioncat.sources.documents import read_tags_json

METRICS = ("activity", "duration", "filesize")


@dataclass(frozen=True)
class Analysis:
    """What a run needs: archives (each as the configuration gives it), tag files in order, stories, and where results go."""

    archives: list[dict[str, Any]]
    output: str
    tag_files: list[str] = field(default_factory=list)
    stories: list[Story] = field(default_factory=list)
    enabled: bool = True

    @classmethod
    def from_dict(cls, spec: dict[str, Any], known_devices: list[str] | None = None) -> Analysis:
        for name in ("video_database_list", "output_directory"):
            if name not in spec:
                raise ValueError(f"the configuration lacks {name}")
        tag_files = spec.get("tag_database_files") or []
        if not isinstance(tag_files, list):
            raise ValueError("tag_database_files must be a list of paths")
        stories = [Story.from_dict(s, known_devices) for s in spec.get("stories") or []]
        return cls(list(spec["video_database_list"]), spec["output_directory"], tag_files, stories, bool(spec.get("process_stories", True)))

    @classmethod
    def from_yaml(cls, text: str, known_devices: list[str] | None = None) -> Analysis:
        """A YAML text in which ``!join [a, b]`` stands for the parts as one path."""
        import yaml

        class Loader(yaml.SafeLoader):
            pass

        def join(loader: yaml.SafeLoader, node: yaml.Node) -> str:
            parts = loader.construct_sequence(node, deep=True) if isinstance(node, yaml.SequenceNode) else [loader.construct_scalar(node)]
            first, *rest = (str(p) for p in parts)
            for part in rest:
                first = part if part.startswith("/") else f"{first.rstrip('/')}/{part}"
            return first

        Loader.add_constructor("!join", join)
        return cls.from_dict(yaml.load(text, Loader=Loader), known_devices)


def load_clips(analysis: Analysis, spark: SparkSession) -> tuple[DataFrame, list[str]]:
    """(clips, missing metadata files) of the archives in order; the first loaded row of a clip stays.

    An archive is known by its ``video_metadata_file``; one that has only directories is listed and
    probed elsewhere (``scan_listing``, ``resolve_catalog``) and refused here.
    """
    bare = [a for a in analysis.archives if not a.get("video_metadata_file")]
    if bare:
        raise ValueError(f"archives without video_metadata_file: {bare}")
    clips, _, missing = read_catalog_csv(spark, [a["video_metadata_file"] for a in analysis.archives])
    if len(missing) == len(analysis.archives):
        raise ValueError("Failed to load video database")
    return clips.withColumn("load_seq", F.lit(0).cast("bigint")), missing  # clips are unique now, so their order decides nothing


def load_tags(analysis: Analysis, clips: DataFrame, above: float = 0.8) -> DataFrame | None:
    """Tag files merged in order (the later wins), overlaps removed, for the clips of the catalog; None without tag files.

    Insertion order, which decides between overlapping tags, is the file's number and the place in the frame.
    """
    sides = []
    for i, path in enumerate(analysis.tag_files):
        order = F.format_string("%06d-%010d-%s", F.lit(i), "place", "hash")
        sides.append(read_tags_json(clips.sparkSession, path, placed=True).withColumn("ord", order).drop("hash", "place", "timestamp"))
    return tag_database(sides, clips, above) if sides else None


def run_analysis(
    analysis: Analysis, spark: SparkSession, calendar: DataFrame | None = None, devices: list[str] | None = None, above: float = 0.8
) -> dict[str, str]:
    """A whole run from its configuration: archives and tag files are loaded once and written, then every story follows."""
    if not (analysis.enabled and analysis.stories):
        return {}
    found, _ = load_clips(analysis, spark)
    clips = materialize(found, "catalog")
    loaded = load_tags(analysis, clips, above)
    tags = None if loaded is None else materialize(loaded, "tags")
    return run_stories(analysis, clips, calendar, tags, devices)


def write_story(story: Story, clips: DataFrame, path: str, calendar: DataFrame | None = None, tags: DataFrame | None = None, devices: list[str] | None = None) -> None:
    """Below ``path``: metadata CSV, playlist, totals, and with ``devices`` the daily frame of every metric."""
    chosen = materialize(story.select(clips, calendar, ordered=False), "story")
    write_catalog_csv(chosen, f"{path}/metadata")
    write_playlist(chosen, f"{path}/playlist")
    catalog_stats(chosen, tags).write.mode("overwrite").json(f"{path}/statistics")
    for metric in METRICS if devices else ():
        rollup.daily(chosen, metric, devices).orderBy("date").write.mode("overwrite").option("header", True).csv(f"{path}/daily-{metric}")
    forget(chosen)


def run_stories(analysis: Analysis, clips: DataFrame, calendar: DataFrame | None = None, tags: DataFrame | None = None, devices: list[str] | None = None) -> dict[str, str]:
    """Write every story of an enabled run; the folder of each by its name."""
    folders = {s.name: f"{analysis.output.rstrip('/')}/{s.name}" for s in analysis.stories} if analysis.enabled else {}
    for story in analysis.stories if analysis.enabled else []:
        write_story(story, clips, folders[story.name], calendar, tags, devices)
    return folders

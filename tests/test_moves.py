"""Rows of tags move as seldom, and as narrow, as the work allows."""

import pytest
from test_tag_store import SCHEMA, side

from motioncat.operators import tags as ops
from motioncat.operators import tracks
from motioncat.session import scratch_path
from motioncat.sources import documents
from motioncat.sources import tag_store as ts


@pytest.fixture
def tags(spark):
    return spark.createDataFrame(side(1), SCHEMA)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merge_of_a_database_is_written_once(spark, tags, monkeypatch):
    names = []
    original = ops.materialize
    monkeypatch.setattr(ops, "materialize", lambda df, name: names.append(name) or original(df, name))
    clips = tags.select("filename").distinct()
    found = ops.tag_database([tags, tags], clips)
    assert names[0] == "merged-tags"
    assert found.count() > 0 and "hash" in found.columns


def test_overlaps_outside_the_catalog_are_not_looked_for(spark, tags, monkeypatch):
    """The same tags as by removing all overlaps first; lengths of tracks count tags of all clips."""
    seen, fold = [], ops._fold_small
    monkeypatch.setattr(ops, "_fold_small", lambda boxes, above: seen.append(boxes.select("filename").distinct()) or fold(boxes, above))
    clips = tags.select("filename").distinct().orderBy("filename").limit(1)
    got = ops.tag_database([tags, tags.limit(5)], clips)
    want = ops.collect_clip_tags(ops.nms_dedup(ops.merge_tags(tags, tags.limit(5)).drop("hash"), 0.8).withColumn("hash", ops.tag_hash()), clips)
    assert tags.select("filename").distinct().count() > 1 and seen[0].count() == 1
    assert sorted(map(str, got.select(sorted(want.columns)).collect())) == sorted(map(str, want.select(sorted(want.columns)).collect()))
    assert got.columns == want.columns and got.count() > 0


def test_track_lengths_move_no_tag(tags):
    assert "SortMergeJoin" not in plan(ops.with_track_length(tags)) and "hashpartitioning(_k" not in plan(ops.with_track_length(tags))


def test_uncrowded_tags_move_once(tags):
    one = ops._fold_small(ops._distinct_boxes(ops.with_track_length(tags.withColumn("_alone", ops.F.lit(None).cast("string"))).repartition(*ops.GROUP)), 0.8)
    assert plan(one).count("Exchange hashpartitioning(filename") == 1


def test_track_merge_broadcasts_no_table_that_grows(tags, monkeypatch):
    """Frames and chunks pack so well on disk that Spark would broadcast millions of them; and tags move once to their frame."""
    plans, original = {}, tracks.materialize
    monkeypatch.setattr(tracks, "materialize", lambda df, name: plans.setdefault(name, plan(df)) and original(df, name))
    assert tracks.merge_candidates(tags, 0.5).count() >= 0
    for name in ("track-chunks", "track-moves"):
        assert "SortMergeJoin" in plans[name] and "BroadcastHashJoin" not in plans[name], plans[name]
    assert plans["track-chunks"].count("Exchange hashpartitioning(filename") == 3  # tags and frames to their frame, points to their chunk


def test_documents_are_numbered_without_moving_rows(spark, tags, monkeypatch):
    """Only files of more than one document are looked up; rows without file are left out, as before."""
    monkeypatch.setattr(documents, "DOC_ROWS", 3)
    rows = tags.unionByName(tags.limit(2).withColumn("filename", ops.F.lit(None).cast("string")))
    found = documents._documents(rows, ["filename"], ops.F.col("ord"))
    text = plan(found)
    assert "SortMergeJoin" not in text and "Exchange hashpartitioning(filename" not in text
    sizes = {r["filename"]: r["n"] for r in tags.groupBy("filename").agg(ops.F.count("*").alias("n")).collect()}
    got = found.groupBy("filename").agg(ops.F.count("*").alias("n"), ops.F.max("_doc").alias("last")).collect()
    assert {r["filename"]: r["n"] for r in got} == sizes
    assert all(r["last"] < -(-r["n"] // 3) for r in got) and max(r["last"] for r in got) > 0


def test_json_files_are_packed_and_come_back(spark, tags):
    path = scratch_path(spark, "tags-json")
    documents.write_tags_json(tags, path, "now")
    assert any(f.endswith(".json.gz") for f in spark.read.text(path).inputFiles())
    back = documents.read_tags_json(spark, path)
    wanted = {(r.filename, r.frame_number, r.hash) for r in ops.merge_tags(tags).select("filename", "frame_number", "hash").collect()}
    assert {(r.filename, r.frame_number, r.hash) for r in back.collect()} == wanted and back.count() == len(wanted)


def test_buckets_grow_with_the_tags():
    assert ts.buckets_for(600_000) == 8
    for rows in (1, 36_000_000, 216_000_000):
        assert ts.buckets_for(rows) * ts.BUCKET_ROWS >= rows


def test_points_of_tracks_carry_no_insertion_order(spark, tags, monkeypatch):
    kept = {}
    original = tracks.materialize
    monkeypatch.setattr(tracks, "materialize", lambda df, name: kept.setdefault(name, df) and original(df, name))
    tracks.merge_candidates(tags, 0.5)
    assert "ord" not in kept["track-chunks"].schema["points"].dataType.elementType.names

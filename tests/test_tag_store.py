"""Tag stores: merges like dictionaries of dictionaries, and no exchange between stores."""

import random

import pytest
from pyspark.sql import functions as F

from motioncat.session import scratch_path
from motioncat.sources import tag_store as ts

SCHEMA = "ord string, filename string, frame_number int, type string, value string, confidence double, track_id long, x1 int, y1 int, x2 int, y2 int"


def side(seed, n=150):
    """A third of the tags is in one frame; keys repeat within a side and between sides."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        file, frame = ("hot.mp4", 1) if i % 3 == 0 else (f"f{rng.randrange(3)}.mp4", rng.randrange(3))
        x = rng.randrange(8)
        rows.append((f"{seed}-{i:04d}", file, frame, "T", rng.choice(["person", None]), rng.random(), rng.choice([None, 1]), x, 0, x + 9, 9))
    return rows


def as_dict(rows):
    return {(r[1], r[2], r[4], r[7]): r[0] for r in rows}  # a later tag of the same identity replaces the earlier


def found(df):
    rows = df.collect()
    got = {(r.filename, r.frame_number, r.value, r.x1): r.ord for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("sides", [1, 2, 3, 8])
def test_merge_like_dictionaries(spark, sides):
    data = [side(i) for i in range(sides)]
    stores = [ts.write_store(spark.createDataFrame(d, SCHEMA), scratch_path(spark, "tags"), 4) for d in data]
    last, first = {}, {}
    for d in data:
        last |= as_dict(d)
        first = as_dict(d) | first
    assert found(ts.merge_stores(stores, buckets=4)) == last
    merged = ts.merge_stores(stores, later_wins=False, buckets=4)
    assert found(merged) == first
    assert {(r.side, r.ord.split("-")[0]) for r in merged.collect()} <= {(i, str(i)) for i in range(sides)}


def test_no_row_moves_between_stores(spark):
    stores = [ts.write_store(spark.createDataFrame(side(i), SCHEMA), scratch_path(spark, "tags"), 4) for i in range(3)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = ts.merge_stores(stores)
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert found(merged) == as_dict(side(0)) | as_dict(side(1)) | as_dict(side(2))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("mode", ["ADD", "REPLACE"])
def test_attach(spark, mode):
    old, new = side(1), side(2)
    stores = [ts.write_store(spark.createDataFrame(d, SCHEMA), scratch_path(spark, "tags"), 4) for d in (old, new)]
    clips = spark.createDataFrame([("hot.mp4", 1), ("hot.mp4", 2), ("f1.mp4", 3), ("none.mp4", 4)], "filename string, n int")
    matched = {k: v for k, v in as_dict(new).items() if k[0] in ("hot.mp4", "f1.mp4")}
    kept = {k: v for k, v in as_dict(old).items() if mode == "ADD" or k[0] not in {m[0] for m in matched}}
    assert found(ts.attach_store(*stores, clips, mode)) == matched | kept
    with pytest.raises(ValueError):
        ts.attach_store(*stores, clips, "MOVE")


def test_open_store_again(spark):
    path = scratch_path(spark, "tags")
    written = ts.write_store(spark.createDataFrame(side(4), SCHEMA), path, 4)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in written.schema)
    again = ts.open_store(spark, path, 4, schema)
    assert found(again) == as_dict(side(4))
    assert found(ts.merge_stores([again, again])) == as_dict(side(4))
    assert found(ts.write_store(spark.createDataFrame(side(7), SCHEMA), path, 4)) == as_dict(side(7))


def test_empty_sides_and_unplaced_tags(spark):
    none = ts.write_store(spark.createDataFrame([], SCHEMA), scratch_path(spark, "tags"), 4)
    some = ts.write_store(spark.createDataFrame(side(5), SCHEMA), scratch_path(spark, "tags"), 4)
    assert found(ts.merge_stores([none, some, none])) == as_dict(side(5))
    lost = spark.createDataFrame(side(6), SCHEMA).withColumn("filename", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="a tag needs a file and a frame"):
        ts.write_store(lost, scratch_path(spark, "tags"), 4)

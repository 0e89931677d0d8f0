from datetime import datetime

import pytest

from motioncat.plans.run import Analysis, load_clips, load_tags, run_analysis
from motioncat.session import scratch_path
from motioncat.sources.catalog import read_catalog_csv, write_catalog_csv
from motioncat.sources.documents import read_tags_json, write_tags_json

TEXT = """
root: &root /data
video_database_list:
  - video_metadata_file: !join [*root, archive/, a.csv]
output_directory: !join [*root, out]
tag_database_files: [t1.json, t2.json]
stories:
  - name: mornings
    selectors: {devices: [Backyard], time_range: {start: "05:00:00", end: "12:00:00"}}
    occupancy_status: OCCUPIED
"""


def test_configuration():
    pytest.importorskip("yaml")
    run = Analysis.from_yaml(TEXT)
    assert run.archives == [{"video_metadata_file": "/data/archive/a.csv"}] and run.output == "/data/out"
    assert run.tag_files == ["t1.json", "t2.json"] and [s.name for s in run.stories] == ["mornings"] and run.enabled


def test_configuration_faults():
    with pytest.raises(ValueError, match="output_directory"):
        Analysis.from_dict({"video_database_list": []})
    with pytest.raises(ValueError, match="list"):
        Analysis.from_dict({"video_database_list": [], "output_directory": "x", "tag_database_files": "t.json"})


CLIPS = "dt timestamp_ntz, duration_s double, device string, serial string, filename string, full_path string, file_size double, width int, height int, frame_count long, fps double, video_codec string, load_seq long"
TAGS = "filename string, frame_number int, type string, value string, confidence double, track_id long, x1 int, y1 int, x2 int, y2 int, ord long"


def clip(i, device="Backyard", hour=6, size=1.0):
    return (datetime(2024, 1, 1 + i, hour), 10.0, device, "S0", f"c{i}.mp4", f"/a/c{i}.mp4", size, 10, 10, 150, 15.0, "h264", i)


def test_run_from_archives_and_tag_files(spark):
    root = scratch_path(spark, "run")
    write_catalog_csv(spark.createDataFrame([clip(0), clip(1), clip(2, "Garage")], CLIPS), f"{root}/a")
    write_catalog_csv(spark.createDataFrame([clip(1, size=9.0), clip(3), clip(4, hour=20)], CLIPS), f"{root}/b")
    near = [("c1.mp4", 5, "T", "person", 0.5, t, 0, 0, 100, 100 + k, k) for k, t in enumerate([1, 2, 2])]
    write_tags_json(spark.createDataFrame([*near, ("c9.mp4", 5, "T", "person", 0.5, 1, 0, 0, 9, 9, 9)], TAGS), f"{root}/t1", "x")
    write_tags_json(spark.createDataFrame([near[0][:4] + (0.9,) + near[0][5:], ("c3.mp4", 0, "T", "car", 0.7, 3, 0, 0, 9, 9, 1)], TAGS), f"{root}/t2", "x")
    run = Analysis.from_dict({
        "video_database_list": [{"video_metadata_file": f"{root}/{n}"} for n in ("a", "gone", "b")], "tag_database_files": [f"{root}/t1", f"{root}/none", f"{root}/t2"],
        "output_directory": f"{root}/out", "stories": [{"name": "mornings", "selectors": {"devices": ["Backyard"], "time_range": {"start": "05:00:00", "end": "12:00:00"}}}]})
    clips, missing = load_clips(run, spark)
    assert missing == [f"{root}/gone"] and {(r.filename, r.file_size) for r in clips.collect()} == {(f"c{i}.mp4", 1.0) for i in range(5)}
    assert sorted((r.filename, r.track_id, r.value) for r in load_tags(run, clips).collect()) == [("c1.mp4", 2, "person"), ("c3.mp4", 3, "car")]
    folder = run_analysis(run, spark)["mornings"]
    totals = spark.read.json(f"{folder}/statistics").first()
    assert (totals.num_videos, totals.num_tags, totals.num_tagged_videos) == (3, 2, 2)
    assert {r.filename for r in read_catalog_csv(spark, f"{folder}/metadata")[0].collect()} == {"c0.mp4", "c1.mp4", "c3.mp4"}


def test_runs_that_cannot_load(spark):
    with pytest.raises(ValueError, match="Failed to load"):
        load_clips(Analysis([{"video_metadata_file": scratch_path(spark, "none")}], "x"), spark)
    with pytest.raises(ValueError, match="without video_metadata_file"):
        load_clips(Analysis([{"video_directories": ["/v"]}], "x"), spark)
    assert run_analysis(Analysis([], "x"), spark) == {}


def test_tags_keep_their_order_in_a_document(spark):
    rows = [("f.mp4", 1, "T", "person", 0.5, 1, x, 0, x + 9, 9, k) for k, x in enumerate([7, 3, 9, 1, 3])]
    path = scratch_path(spark, "tags")
    write_tags_json(spark.createDataFrame(rows, TAGS).repartition(4), path, "x")
    assert [r.x1 for r in read_tags_json(spark, path, placed=True).orderBy("place").collect()] == [7, 3, 9, 1]

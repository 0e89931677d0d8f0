"""Cases that once went wrong: part-file order, gapped dates, boxes without area, equal tags of a frame."""

import datetime

import pytest
from motioncat.operators import occupancy as occ
from motioncat.operators.tags import nms_dedup
from motioncat.sources.documents import read_tags_json, write_tags_json
from motioncat.sources.tables import read_devices, write_devices

DEVICE = "ord int, serial string, device string, start_date date, end_date date"
TAG = "ord int, filename string, frame_number int, type string, value string, confidence double, track_id long, x1 int, y1 int, x2 int, y2 int"


def test_devices_keep_their_order_over_part_files(spark, tmp_path):
    rows = [(i, f"S{i:03d}", f"D{i}" * (i % 7 + 1), None, None) for i in range(1, 41)]
    write_devices(spark.createDataFrame(rows, DEVICE), f"{tmp_path}/d", files=5)
    back = read_devices(spark, f"{tmp_path}/d").collect()
    assert [(r["ord"], r["serial"]) for r in sorted(back, key=lambda r: r["ord"])] == [(r[0], r[1]) for r in rows]


@pytest.mark.parametrize("method", ["simple", "cross_validation"])
@pytest.mark.parametrize("gap", [1, 5])
def test_training_on_gapped_dates(spark, method, gap):
    first = datetime.date(2024, 1, 1)
    days = [(first + datetime.timedelta(days=gap * i), 100 * (i % 2) + i, i % 2) for i in range(20)]
    fit = occ.train_occupancy(spark.createDataFrame(days, "date date, a int, label int"), ["a"], method)
    assert fit["accuracy"] == 1.0 and fit["skipped"] == {}


def test_tree_depth_is_a_choice(spark):
    first = datetime.date(2024, 1, 1)
    days = [(first + datetime.timedelta(days=i), i, (i // 2) % 2) for i in range(64)]
    frame = spark.createDataFrame(days, "date date, a int, label int")
    deep, flat = (occ.train_occupancy(frame, ["a"], test_size=0.1, max_depth=d)["model"].stages[-1].depth for d in (None, 2))
    assert deep > 4 and flat <= 2


def test_boxes_without_area_stay(spark):
    rows = [(i, "V", 0, "T", "person", 1.0, 1, 5, 5, 5, 9) for i in (1, 2)] + [(i, "V", 0, "T", "person", 1.0, 1, 0, 0, 9, 9) for i in (3, 4)]
    kept = [r["ord"] for r in nms_dedup(spark.createDataFrame(rows, TAG)).collect()]
    assert sorted(kept) == [1, 2, 3]
    assert nms_dedup(spark.createDataFrame(rows, TAG), above=1.0).count() == 4


def test_last_of_equal_tags_is_written(spark, tmp_path):
    rows = [(1, "V", 0, "Z", "person", 0.9, 7, 0, 0, 9, 9), (2, "V", 0, "A", "person", 0.1, 3, 0, 0, 9, 9)]
    write_tags_json(spark.createDataFrame(rows, TAG), f"{tmp_path}/t", "now")
    back = read_tags_json(spark, f"{tmp_path}/t").collect()
    assert [(r["type"], r["confidence"], r["track_id"]) for r in back] == [("A", 0.1, 3)]


def test_scratch_is_bounded_and_deleted(spark):
    import glob

    from motioncat.operators.graph import connected_components
    from motioncat.session import RUN, cleanup, shared_folder

    cleanup(spark)
    chain = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    assert {r["component"] for r in connected_components(chain).collect()} == {0}
    assert len(glob.glob(f"{shared_folder(spark)}/motioncat/run-{RUN}/*")) == 1
    cleanup(spark)
    assert glob.glob(f"{shared_folder(spark)}/motioncat/run-{RUN}*") == []


def test_edges_shrink_while_components_are_found(spark, monkeypatch):
    """Each turn keeps the edges between fewer nodes; all turns together write little more than the first."""
    import numpy as np

    from motioncat.operators import graph
    from motioncat.session import materialize

    written = []

    def counted(df, name):
        out = materialize(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(graph, "materialize", counted)
    rng = np.random.default_rng(5)
    pairs = {(int(a), 1000 + int(b)) for a, b in zip(rng.integers(0, 50, 1500), rng.integers(0, 1000, 1500))} | {(9000 + i, 9001 + i) for i in range(300)}
    got = {r["id"]: r["component"] for r in graph.connected_components(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()}
    edges = [n for name, n in written if name == "edges"]
    assert sum(edges) < 2.5 * edges[0], edges
    label = {x: x for p in pairs for x in p}
    for _ in range(len(label)):
        before = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    assert got == label

"""Labels, persons and profiles as documents: round trips, missing fields, empty tables."""

import json


from motioncat.operators import labels as lb
from motioncat.session import scratch_path
from motioncat.sources import labels as files


def test_labels_over_several_documents(spark, monkeypatch):
    monkeypatch.setattr(files, "DOC_ROWS", 10)
    path = scratch_path(spark, "labels")
    labels = spark.range(35).selectExpr("id AS cluster_id", "concat('P', id % 4) AS label", "IF(id % 2 = 0, 'n', NULL) AS notes", "id % 3 = 0 AS verified")
    monkeypatch.setattr(files._dealt, "__defaults__", (10,))
    files.write_labels_json(labels, path, "t1", 40)
    docs = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert len(docs) > 1 and all(d["metadata"] == {"timestamp": "t1", "total_labels": 35, "total_clusters": 40} for d in docs)
    got = {r.cluster_id: (r.label, r.confidence, r.notes, r.verified, r.timestamp) for r in files.read_labels_json(spark, path).collect()}
    assert got == {i: (f"P{i % 4}", 1.0, "n" if i % 2 == 0 else "", i % 3 == 0, "t1") for i in range(35)}


def test_missing_fields_and_repeated_clusters(spark):
    path = scratch_path(spark, "labels")
    rows = [{"labels": [{"cluster_id": 1, "label": "a"}, {"cluster_id": 2, "label": "old", "timestamp": "1"}]}, {"labels": [{"cluster_id": 2, "label": "new", "timestamp": "2"}]}]
    spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").write.text(path)
    got = {r.cluster_id: (r.label, r.confidence, r.notes, r.verified, r.timestamp) for r in files.read_labels_json(spark, path, "0").collect()}
    assert got == {1: ("a", 1.0, "", False, "0"), 2: ("new", 1.0, "", False, "2")}


def test_one_person_over_several_documents(spark, monkeypatch):
    monkeypatch.setattr(files, "DOC_ROWS", 7)
    members = spark.range(50).selectExpr("id AS cluster_id", "IF(id < 40, 'big', concat('m', id)) AS mega_id")
    path = scratch_path(spark, "megas")
    files.write_megas_json(members, path, "t", 60)
    docs = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert sum(d["mega_clusters"][0]["mega_id"] == "big" for d in docs) > 3
    assert docs[0]["metadata"] == {"timestamp": "t", "total_mega_clusters": 11, "total_clustered": 50, "total_unclustered": 10}
    megas, back = files.read_megas_json(spark, path)
    assert megas.count() == 11 and {r.person_name for r in megas.collect()} == {"big", *(f"m{i}" for i in range(40, 50))}
    assert {(r.cluster_id, r.mega_id) for r in back.collect()} == {(r.cluster_id, r.mega_id) for r in members.collect()}


def test_profiles_match_the_same_after_a_round_trip(spark):
    rows = spark.createDataFrame([(i, f"P{i % 2}", [1.0 + i % 2, 0.1 * i, 2.0 - i % 2]) for i in range(8)], "ord long, person string, embedding array<double>")
    profiles = lb.person_profiles(rows)
    path = scratch_path(spark, "profiles")
    files.write_profiles_json(profiles, path, "t")
    back = files.read_profiles_json(spark, path)
    want = {(r.ord, r.person, round(r.similarity, 9)) for r in lb.profile_matches(rows, profiles).collect()}
    assert want and {(r.ord, r.person, round(r.similarity, 9)) for r in lb.profile_matches(rows, back).collect()} == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "cluster_id long, label string, mega_id string")
    files.write_labels_json(none, (a := scratch_path(spark, "l")), "t")
    files.write_megas_json(none.drop("label"), (b := scratch_path(spark, "m")), "t")
    assert files.read_labels_json(spark, a).count() == 0
    assert [d.count() for d in files.read_megas_json(spark, b)] == [0, 0]

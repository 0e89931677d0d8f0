"""All parameter sets on groups so clear that each set's clusters are known."""

from motioncat.operators import clustering as cl

SIZES = [2, 3, 4, 5, 6, 2, 3, 4, 5, 6, 7, 8]


def test_every_parameter_set(spark):
    rows, n = [], 0
    for group, size in enumerate(SIZES):
        for _ in range(size):
            rows.append((n, group, f"V{group}", str(n), n, 0.9, 0.9, [1.0 if i == group else 0.0 for i in range(16)]))
            n += 1
    people = spark.createDataFrame(rows, "ord long, label int, video_filename string, track_id string, frame_number int, confidence double, embedding_quality double, embedding array<double>")
    found = {r["name"]: r for r in cl.tuning_summary(people).collect()}
    assert set(found) == {s[0] for s in cl.PARAMETER_SETS}
    for name, _, _, _, _, samples, least in cl.PARAMETER_SETS:
        kept = [s for s in SIZES if s >= max(samples, least)]
        row = found[name]
        assert (row["num_clusters"], row["largest_cluster"], row["smallest_cluster"]) == (len(kept), max(kept), min(kept)), name
        assert abs(row["avg_cluster_size"] - sum(kept) / len(kept)) < 1e-9
        for column in ("avg_quality", "min_quality", "max_quality"):
            assert abs(row[column] - (0.4 + 0.3 + 0.2 * 0.9 + 0.1 * 0.9)) < 1e-6, (name, column)
    best = {r["kind"]: r for r in cl.best_runs(cl.tuning_summary(people, cl.PARAMETER_SETS[:3])).collect()}
    assert set(best) == {"high_precision", "balanced"} and all(r["num_clusters"] == len(SIZES) for r in best.values())

"""The pipeline's near-duplicate stage neither sorts whole documents nor cuts a text up more often than needed."""

from motioncat.llm import jaccard, simhash


def test_documents_are_joined_without_sorting_them(spark, monkeypatch):
    plans = {}
    real = simhash.materialize

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().sparkPlan().toString()
        return real(df, name)

    monkeypatch.setattr(simhash, "materialize", seen)
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "end"])), (2, " ".join([*words, "end"])), (3, "other words"), (4, None), (None, " ".join(words)), (5, "")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    last = kept._jdf.queryExecution().sparkPlan().toString()
    for plan in (plans["marked"], last):
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert "MapInArrow" not in plans["marked"]
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, " ".join(words)), (1, " ".join(words)), (3, "other words"), (4, "")]


def test_sketches_keep_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 7), (None, None, None)], "doc_id long, text string, n_chars long")
    found = {r["doc_id"]: r for r in jaccard.with_sketches(docs, "text", "p", "b").collect()}
    for key, text in ((1, "a b c d e f"), (None, "")):
        own = jaccard.shingle_set(text)
        assert (found[key]["p"], found[key]["b"]) == (jaccard.set_print(own), jaccard.bands(own).tolist())
    assert (found[1]["n_chars"], found[None]["text"]) == (7, None)

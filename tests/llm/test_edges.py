"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import corpus_pipeline
import pytest
from motioncat.llm import bpe_tree, embed_dedup, html_extract, packing, pii, quality, simhash, token_counts, topk, toxicity
from motioncat.llm.pii_model import train

LONG = "word " * 30000
DOCS = [
    (1, "A plain text of some words here.", "x"), (1, "A plain text of some words here.", "x"), (2, None, None), (3, "", "y"), (None, "no id here at all", "z"),
    (4, LONG, "l"), (5, "mail me at jo@example.com or +1 (212) 555-1234", None), (6, "   \n\n ", "w"), (7, "a" * 20000, "w"), (None, None, None), (8, "é日本 \U0001f600 \x00 ok", "u"),
]
SCHEMA = "doc_id long, text string, source string"
CLASH = {"ids": "1", "key": "2", "tail": "3", "spans": "4", "fingerprint": "5", "component": "6", "part": "7", "length": "8", "grade": "9", "_first": "10", "component_id": "11", "start": "12"}


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(DOCS, SCHEMA).withColumns({k: F.lit(v) for k, v in CLASH.items()})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 1), (3, None, None), (99, 1, 0), (1, 1, 0), (4, 1, 0), (7, 1, 0), (8, 1, None), (6, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def tagger():
    import numpy as np

    return train(np.zeros((4, 96), np.int64), np.zeros((4, 96), np.int64), epochs=1)


def operators(labels, tagger):
    return {
        "token_counts": lambda d: token_counts.count_tokens(d),
        "bpe": lambda d: bpe_tree.decode_texts(bpe_tree.encode_texts(d)),
        "packing": lambda d: packing.pack_documents(d),
        "simhash": lambda d: simhash.near_duplicates(d),
        "keep_first": lambda d: simhash.keep_first(d),
        "pii": lambda d: pii.find_personal_data(d, tagger=tagger),
        "redact": lambda d: pii.redact_personal_data(d, tagger=tagger),
        "quality": lambda d: quality.rate_quality(d, quality.fit_quality(d, quality.grades(labels))),
        "toxicity": lambda d: toxicity.rate_toxicity(d, toxicity.fit_toxicity(d, toxicity.severities(labels))),
        "html": lambda d: html_extract.extract(d, key="doc_id", html="text"),
    }


@pytest.mark.parametrize("name", ["bpe", "simhash", "pii", "redact", "quality", "toxicity", "html"])
def test_one_row_each(docs, labels, tagger, name):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in operators(labels, tagger)[name](docs).collect()) == sorted((d[0] is None, d[0] or 0) for d in DOCS)


@pytest.mark.parametrize("name", ["token_counts", "bpe", "packing", "simhash", "keep_first", "pii", "redact", "quality", "toxicity", "html"])
def test_empty_table(docs, labels, tagger, name):
    assert operators(labels, tagger)[name](docs.limit(0)).collect() == []


def test_null_text_counts_as_empty(docs):
    rows = {r["doc_id"]: r for r in bpe_tree.decode_texts(bpe_tree.encode_texts(docs)).collect()}
    assert rows[2]["ids"] == rows[3]["ids"] == [] and bytes(rows[2]["decoded"]) == b""
    assert bytes(rows[8]["decoded"]).decode() == DOCS[-1][1]
    prints = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert prints[2]["fingerprint"] == prints[3]["fingerprint"] == prints[6]["fingerprint"] == 0
    assert prints[3]["component_id"] == 2


def test_packing_holds_every_row(docs):
    rows = packing.pack_documents(docs).collect()
    assert sum(r["start"] == 0 for r in rows) == len(DOCS)
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_tokens_are_all_attributed(docs):
    coded = {r["doc_id"]: len(r["ids"]) for r in bpe_tree.encode_texts(docs.filter("doc_id > 1")).collect()}
    counted = token_counts.count_tokens(docs.filter("doc_id > 1")).groupBy("doc_id").sum("n_tokens").collect()
    assert dict(map(tuple, counted)) == coded


def test_keep_first_keeps_null_ids_and_columns(docs):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, 4, 5, 7, 8, None, None]


def test_keep_first_decides_by_row(spark):
    one, two, three = ("red green blue white black grey", "the quick brown fox jumps over", "some other words that stand alone")
    copies = [(1, one), (2, one), (2, two), (3, two), (3, three), (4, three), (5, "first of two"), (6, "first of two"), (5, "second of two"), (7, "second of two")]
    kept = simhash.keep_first(spark.createDataFrame(copies, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == [(1, one), (2, two), (3, three), (5, "first of two"), (5, "second of two")]


def test_keep_first_drops_copies_without_id(spark):
    """Rows without id are compared too: of each group one of them stays."""
    one, two, three = ("red green blue white black grey", "the quick brown fox jumps over", "some other words that stand alone")
    long = [f"w{i}" for i in range(200)]
    near = [*long[:100], "other", *long[101:]]
    rows = [(1, one), (None, one), (None, one), (None, two), (None, two), (None, three), (None, None), (None, " "), (3, " ".join(near)), (4, " ".join(long)), (5, " ".join(near))]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str((r.doc_id, (r.text or "").strip())) for r in kept) == sorted(map(str, [(1, one), (None, one), (None, two), (None, three), (None, ""), (3, " ".join(near))]))
    bare = simhash.keep_first(spark.createDataFrame([(None, " ".join(long)), (None, " ".join(near)), (None, three)], "doc_id long, text string")).collect()
    assert len(bare) == 2 and three in {r.text for r in bare}


def test_redaction_takes_effect(docs, tagger):
    rows = {r["doc_id"]: r for r in pii.redact_personal_data(docs, tagger=tagger).collect()}
    assert rows[5]["text"] == "mail me at <email> or <phone>" and rows[2]["text"] is None and rows[4]["text"] == LONG
    assert rows[5]["ids"] == "1" and rows[5]["spans"] == "4"


def test_one_grade_keeps_all(docs, labels):
    only = quality.fit_quality(docs, labels.filter("quality = 1").selectExpr("doc_id", "2 AS grade"))
    assert quality.keep_good(docs, only).count() == len(DOCS)
    none = toxicity.fit_toxicity(docs, labels.limit(0).selectExpr("doc_id", "1 AS grade"))
    rated = toxicity.rate_toxicity(docs, none).collect()
    assert len(rated) == len(DOCS) and not any(r["toxic"] for r in rated)


VECTORS = [
    (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.99, 0.05, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [float("nan"), 1.0, 0.0]), (7, [float("inf"), 1.0, 0.0]),
    (None, [1.0, 0.0, 0.0]), (8, [0.0, 1.0, 0.0]), (9, [2.0, 0.0]), (1, [1.0, 0.0, 0.0]), (10, [None, 1.0, 0.0]), (None, None), (11, []), (12, [5.0, 0.0]),
]


@pytest.fixture(scope="module")
def vectors(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("key", "code", "unit", "n_links", "kept", "ring", "query")})


def test_embedding_edges(vectors):
    rows = embed_dedup.near_duplicates(vectors).collect()
    assert len(rows) == len(VECTORS)
    by_id = {r["vec_id"]: r for r in rows if r["vec_id"] is not None}
    assert by_id[3]["component_id"] == 1 and by_id[3]["n_links"] == 4 and not by_id[3]["kept"]
    assert by_id[1]["n_links"] == 4 and by_id[1]["kept"]
    assert all(by_id[i]["n_links"] == 0 and by_id[i]["kept"] for i in (4, 5, 6, 7, 8, 10, 11))
    assert by_id[12]["component_id"] == 9 and by_id[9]["n_links"] == 1
    assert embed_dedup.near_duplicates(vectors.limit(0)).collect() == []


def test_top_k_edges(vectors):
    rows = topk.top_k(vectors, vectors.filter("vec_id in (1, 4, 9) or vec_id is null"), k=3).collect()
    of_nine = [(r["rank"], r["vec_id"], r["score"]) for r in rows if r["query_id"] == 9]
    assert of_nine == [(1, 12, 512 * 1280)]
    of_one = sorted((r["rank"], r["vec_id"]) for r in rows if r["query_id"] == 1)
    assert of_one == [(1, 2), (1, 2), (2, 3), (2, 3), (3, 5), (3, 5)]  # ties of 5 and 8 go to the smaller id; two query rows
    assert {r["query_id"] for r in rows} == {1, 9}
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).collect() == []


def test_pages_edges(spark):
    pages = [(1, None), (2, ""), (3, "<p>One&amp;two</p><p>three &lt; four</p>"), (4, "<div>" * 3000 + "deep"), (5, "<!-- <p>no</p>"), (None, "just text"), (6, "<script>x</script>")]
    rows = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, html string")).collect()}
    assert rows[1] == rows[2] == rows[6] == "" and rows[3] == "One&two three < four" and len(rows) == len(pages)


def test_pipeline_stages(spark, docs, labels, tmp_path, monkeypatch):
    monkeypatch.setattr(pii, "WRITTEN_WINDOWS", 60)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    current = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, str(tmp_path))
        assert current.columns == docs.columns, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []

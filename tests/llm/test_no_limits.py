"""Inputs that once met a cap, a switch or a crash: repeated ids above the sample bound, many lengths, very long runs, odd pages."""

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from motioncat.llm import bpe_tree, embed_dedup, packing, token_counts, topk
from motioncat.llm.bpe import TOKENIZER, library_encoder, vocabulary
from motioncat.llm.common import lowest_hashes
from motioncat.llm.html_dom import features, lines_of, parse

LIBRARY = tokenizers.Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
RUNS = [" " * 1_000_000, "\n" * 1_000_000, " \n" * 300_000 + "x", "word <|endoftext|> é日" * 15_000]


def page_text(html):
    page = parse(html)
    return " ".join(lines_of(page, np.ones(len(page.blocks), bool)))


@pytest.mark.parametrize("text", RUNS, ids=["spaces", "lines", "both", "added"])
def test_long_runs_encode_like_the_library(text):
    assert library_encoder(added=True)(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_long_runs_in_token_counts_and_packing(spark):
    docs = spark.createDataFrame(list(enumerate(RUNS[:2])), "doc_id long, text string")
    counted = {r.doc_id: r.n for r in token_counts.count_tokens(docs).groupBy("doc_id").agg({"n_tokens": "sum"}).toDF("doc_id", "n").collect()}
    packed = {r.doc_id: r.n for r in packing.pack_documents(docs).groupBy("doc_id").agg({"length": "sum"}).toDF("doc_id", "n").collect()}
    want = {k: len(library_encoder()(t)) for k, t in enumerate(RUNS[:2])}
    assert counted == want and packed == {k: n + 1 for k, n in want.items()}


@pytest.mark.parametrize("word", ["-" * 100_000, "a" * 300_000, "ab" * 100_000])
def test_long_words_in_the_tree(word):
    assert np.frombuffer(bpe_tree.TreeEncoder(vocabulary()).text(word), "<u4").tolist() == library_encoder()(word).tolist()


def test_sample_with_few_keys(spark):
    rows = spark.range(2000).selectExpr("id % 5 AS k", "id")
    assert lowest_hashes(rows, "k", 64).count() == 64
    assert lowest_hashes(rows.selectExpr("CAST(NULL AS LONG) AS k", "id"), "k", 64).count() == 64


def test_search_with_few_ids(spark, monkeypatch):
    monkeypatch.setattr(topk, "SAMPLE_ROWS", 64)
    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i % 5, rng.standard_normal(4).round(3).tolist()) for i in range(400)], "vec_id long, embedding array<double>")
    found = topk.top_k(vectors, vectors.filter("vec_id = 0").limit(3), k=5).collect()
    assert len(found) == 15 and all(r.vec_id != 0 for r in found)


def test_seventy_lengths(spark, monkeypatch):
    monkeypatch.setattr(topk, "INDEXED_LENGTHS", 3)
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(1 + i % 70).round(2).tolist()) for i in range(280)]
    rows += [(1000 + i, rows[i][1]) for i in range(0, 280, 7)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=3).collect())
    whole = {k: np.floor(256 * np.array(v)) for k, v in rows}
    want = []
    for q in (k for k in whole if k % 50 == 0):
        scores = sorted(((-int(whole[q] @ w), k) for k, w in whole.items() if k != q and len(w) == len(whole[q])))[:3]
        want += [(q, n + 1, k, -s) for n, (s, k) in enumerate(scores)]
    assert got == sorted(want)
    units = {k: np.array(v) / np.linalg.norm(v) for k, v in rows}
    links = {k: sum(k != o and len(u) == len(w) and u @ w >= 0.9 for o, w in units.items()) for k, u in units.items()}
    assert {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(vectors).collect()} == links


@pytest.mark.parametrize("html,text", [
    ("<p>A</p><svg/><p>B</p>", "A B"),
    ("<p>A</p><math/>B", "A B"),
    ("<p>A</p><svg><path/><g/></svg><p>B</p>", "A B"),
    ("<html><head><title>T</title><meta charset=x><p>A</p><p>B</p>", "A B"),
    ("<head><title>T</title><script>x()</script>plain words", "plain words"),
    ("<head><link href=x> \n <style>p{}</style><div>A</div></head><p>B", "A B"),
])
def test_pages_lose_no_text(html, text):
    assert page_text(html) == text


def test_long_class_lists_and_many_siblings():
    page = parse(f'<div class="{"utility " * 200}" id="sidebar"><p>x</p></div>')
    assert page.blocks[1].tokens[-1] == "sidebar" and len(page.blocks[1].tokens) == 202
    page = parse("<body>" + "<p>a</p>" * 100 + "<div>b</div>" * 400 + "</body>")
    found = features(page, {})
    assert found[2, 6] == pytest.approx(0.2) and found[-1, 6] == pytest.approx(0.8)


def test_search_plans_are_bounded(spark):
    """Queries that visit every ring travel packed, one row for a ring and a slice of them, in frames of bounded size."""
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(i, i, None, [float(x) for x in rng.integers(-300, 300, 64)]) for i in range(130)]
    queries = spark.createDataFrame(rows, "query_id long, query_row long, kth double, query array<double>").coalesce(1)
    plan = topk._plan(queries, lambda part: tuple(x.ravel() for x in np.indices((len(part), 500)))).collect()
    assert len(plan) == 500 * 3 and {r["ring"] for r in plan} == set(range(500)) and {r["kind"] for r in plan} == {"int16"}
    assert sum(len(r["query"]) for r in plan) == 130 * 500 * 64 * 2
    sent = {(r["ring"], q): v for r in plan for q, v in zip(np.frombuffer(r["query_id"], np.int64).tolist(), np.frombuffer(r["query"], r["kind"]).reshape(-1, 64).tolist())}
    assert len(sent) == 130 * 500 and all(sent[ring, i] == rows[i][3] for ring in (0, 499) for i in range(130))


def test_second_search_hands_on_what_beats_the_first(spark, monkeypatch):
    """Vectors without structure in many rings: the same rows as by brute force, and few candidates after the first search."""
    import numpy as np

    rng = np.random.default_rng(6)
    v = rng.normal(size=(3000, 16))
    v[100:140] = v[100]
    monkeypatch.setattr(topk, "SEED_ROWS", 512)
    monkeypatch.setattr(topk, "PART_ROWS", 16)
    found, real = [], topk._search
    monkeypatch.setattr(topk, "_search", lambda *a: found.append(topk.materialize(real(*a), "found")) or found[-1])
    vectors = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5).collect())
    e, want = np.floor(v * 256), []
    for q in range(0, 3000, 50):
        s = (e @ e[q]).astype(int)
        best = sorted((i for i in range(3000) if i != q), key=lambda i: (-s[i], i))[:5]
        want += [(q, n, i, s[i]) for n, i in enumerate(best, 1)]
    assert got == want
    assert found[-1].count() < 60 * 20
    plans = []
    monkeypatch.setattr(topk, "_search", lambda plan, filed, *a: plans.append(real(plan, filed, *a)) or plans[-1])
    topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)
    for plan in plans:  # vectors are not broadcast: what is comes from small tables made by the driver
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("strategy=broadcast") == 2 or text.count("LocalRelation") >= 2, text

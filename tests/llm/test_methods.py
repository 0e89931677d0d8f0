"""Each operator against brute force, an exact round trip or held-out accuracy."""

import re
import zlib
from collections import Counter
from random import Random

import corpus_pipeline
import numpy as np
import public_tokenizers
import tiktoken
import tokenizers
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from motioncat.llm import bpe_tree, embed_dedup, html_extract, jaccard, ordinal, packing, pii, quality, simhash, token_counts, topk, toxicity
from motioncat.llm.bpe import library_encoder, vocabulary
from motioncat.llm.common import links_to_labels
from motioncat.llm.html_dom import decode, features, lines_of
from motioncat.llm.pii_model import Tagger
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
LIBRARY = tiktoken.Encoding("all", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary().ranks, special_tokens={})
MIXED = st.text(alphabet="ab eThoni.,\n\t'st1é日  \x1c_-@", max_size=400)


@settings(max_examples=150, deadline=None)
@given(MIXED, st.sampled_from([2, 8, 32]))
def test_tree_encodes_like_the_library(text, leaf):
    ids = np.frombuffer(bpe_tree.TreeEncoder(vocabulary(), leaf).text(text), np.uintc).tolist()
    assert ids == LIBRARY.encode_ordinary(text)
    assert bpe_tree.decode_ids(ids, vocabulary(), leaf=3) == text.encode()


def test_tree_encodes_long_words():
    rng = Random(4)
    for word in ["a" * 9999, "ab" * 5000, "".join(rng.choice("thoning") for _ in range(20000)), "日本" * 3000]:
        tree = bpe_tree.TreeEncoder(vocabulary())
        assert np.frombuffer(tree.text(word), np.uintc).tolist() == LIBRARY.encode_ordinary(word)
        assert tree._merged_by_heap(word.encode()[:400]) == tree._merged_by_scan(word.encode()[:400])


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 500), max_size=20))
def test_patterns_place_every_length(histogram):
    patterns = packing.shortest_pack_first(histogram, 32)
    placed = Counter()
    for count, pattern in patterns:
        assert sum(n * times for n, times in pattern) <= 32
        for n, times in pattern:
            placed[n] += count * times
    assert placed == Counter(histogram)
    assert len(patterns) <= 3 * len(histogram) + 1


def test_packing_against_the_tokenizer(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = packing.pack_documents(docs.repartition(5), with_ids=True).collect()
    whole, packs = {}, {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        whole.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(bytes(r["ids"]), "<u4")))
        packs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for key, text in texts.items():
        assert np.concatenate([p for _, p in sorted(whole[key], key=lambda p: p[0])]).tolist() == [*LIBRARY.encode_ordinary(text), 0]
    for pieces in packs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(packs) == list(range(len(packs)))
    padding = sum(0 if (n := sum(p[1] for p in pieces)) & (n - 1) == 0 else 1024 - n for pieces in packs.values())
    assert padding <= 0.02 * sum(r["length"] for r in rows)


def test_packing_knows_added_tokens(spark):
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x \n\n<|endoftext|>\n y  <|endoftext|>  z", "<|endoftext| <|ENDOFTEXT|>", "it's \x1c\x85 \u3000é 日本", "", "w <|endoftext|> " * 900]
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_ids=True).collect()
    for i, text in enumerate(texts):
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        pieces = sorted((r["start"], bytes(r["ids"])) for r in rows if r["doc_id"] == i)
        assert np.frombuffer(b"".join(p for _, p in pieces), "<u4").tolist() == ids
        assert {r["doc_tokens"] for r in rows if r["doc_id"] == i} == {len(ids)}


def test_token_attribution_by_characters():
    rng = Random(8)
    encode, sizes = library_encoder(), vocabulary().sizes
    for _ in range(200):
        text = "".join(rng.choice("ab é日\n\n.th") for _ in range(rng.randint(1, 60)))
        ids = encode(text)
        starts, ends = token_counts.token_spans(text, ids, sizes)
        edges = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 5)))
        low, high = np.array(edges[:-1:2]), np.array(edges[1::2])[: len(edges[:-1:2])]
        for rule in token_counts.RULES:
            home, _ = token_counts.attribute(starts, ends, low, high, rule)
            for s, e, got in zip(starts, ends, home):
                owner = [next((k for k in range(len(low)) if low[k] <= c < high[k]), -1) for c in range(s, e)]
                if rule == "start":
                    assert got == owner[0]
                else:
                    most = max(Counter(owner).values())
                    assert got in [k for k, n in Counter(owner).items() if n == most]
    assert [tuple(map(list, token_counts.cut_at(t, "\n"))) for t in ("", "a\n", "a\n\nb")] == [([], []), ([0], [2]), ([0, 2, 3], [2, 3, 4])]


def _plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [sum(xxhash.xxh64_intdigest(g, 42) >> i & 1 for g in grams) for i in range(64)]
    return sum(1 << i for i, c in enumerate(counts) if 2 * c > len(grams))


def test_simhash_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    prints = {k: _plain_fingerprint(t) for k, t in texts.items()}
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert {k: r["fingerprint"] % (1 << 64) for k, r in rows.items()} == prints
    ids = sorted(prints)
    bits = np.array([prints[k] for k in ids], np.uint64)
    a, b = np.nonzero(np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 2)
    label = links_to_labels(len(ids), a, b)
    assert {k: rows[k]["component_id"] for k in ids} == {k: ids[label[i]] for i, k in enumerate(ids)}


def test_gray_index_splits_crowded_blocks(spark):
    rng = np.random.default_rng(1)
    prints = np.unique(np.concatenate([rng.integers(0, 1 << 40, 60), (7 << 50) ^ (1 << rng.integers(0, 60, 150)) ^ (1 << rng.integers(0, 60, 150))]))
    frame = spark.createDataFrame([(int(p),) for p in prints], "fingerprint long")
    links = [(r["a"], r["b"]) for r in simhash.near_fingerprints(frame, part_rows=16).collect()]
    place = {int(p): i for i, p in enumerate(prints)}
    got = links_to_labels(len(prints), np.array([place[a] for a, _ in links], int), np.array([place[b] for _, b in links], int))
    a, b = np.nonzero(np.bitwise_count(prints[:, None].view(np.uint64) ^ prints[None, :].view(np.uint64)) <= 2)
    assert (got == links_to_labels(len(prints), a, b)).all()
    assert len(links) < 40 * len(prints)


def _vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")


def test_embedding_links_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "PART_ROWS", 64)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 24))
    rows = np.concatenate([base[rng.integers(0, 60, 500)] + rng.standard_normal((500, 24)) * 0.3, np.repeat(base[:1], 80, axis=0)])
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(_vectors(spark, rows)).collect()}
    links = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert (links <= near.sum(axis=1)).all() and links.sum() >= 0.95 * near.sum()
    label = links_to_labels(len(rows), *np.nonzero(near))
    assert np.mean([got[i]["component_id"] == label[i] for i in range(len(rows))]) >= 0.95
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in range(len(rows)))


def test_top_k_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(topk, "PART_ROWS", 50)
    monkeypatch.setattr(topk, "SEED_ROWS", 20)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    rng = np.random.default_rng(3)
    rows = np.concatenate([rng.standard_normal((8, 6))[rng.integers(0, 8, 300)] + rng.standard_normal((300, 6)) * 0.1, np.ones((30, 6)), rng.standard_normal((20, 6)) * 50])
    frame = _vectors(spark, rows)
    found = topk.top_k(frame, frame.filter("vec_id % 5 = 0"), k=4).collect()
    whole = np.floor(rows * 256)
    for q in range(0, len(rows), 5):
        scores = whole @ whole[q]
        want = sorted((i for i in range(len(rows)) if i != q), key=lambda i: (-scores[i], i))[:4]
        assert [(r["vec_id"], r["score"]) for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])] == [(i, int(scores[i])) for i in want]


def _plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"\D", "", m[0])
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="0123456789.@+-() ab\n", max_size=80))
def test_base_spans_are_the_patterns(text):
    assert pii.base_spans(text) == _plain_spans(text)


def test_base_spans_are_linear():
    for text in ("1" * 300000, "a" * 300000, "a.b@" * 50000, "1 " * 100000, "+1" * 100000, "1." * 100000):
        pii.base_spans(text)
        pii.windows(text)


def test_reconciled_spans_do_not_overlap():
    spans = [(5.0, "phone", 0, 10), (4.0, "card", 8, 20), (4.0, "card", 21, 30), (9.0, "ip", 40, 50)]
    assert pii.reconcile(spans, [("email", 45, 60)]) == [("phone", 0, 10), ("card", 21, 30)]
    assert pii.redacted("ab 12 cd", [("ip", 3, 5), ("card", 4, 7)]) == "ab <ip>d"


def test_tagger_gradients_and_held_out_spans():
    rng = np.random.default_rng(0)
    small = Tagger.new(rng, 4, 5)
    x, y = rng.integers(0, 10, (3, 7)), rng.integers(0, 9, (3, 7))
    _, grads = small.gradients(x, y)
    for p, g in zip(small.parts(), grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        p[at] = old + 1e-2
        up = small.gradients(x, y)[0]
        p[at] = old - 1e-2
        down = small.gradients(x, y)[0]
        p[at] = old
        assert abs((up - down) / 2e-2 - g[at]) < 2e-3 * max(1.0, abs(g[at]))
    tagger = pii.fit_tagger(("the onhe ation wh erthe sted anin",))
    held, hit, total, wrong = Random(99), 0, 0, 0
    for _ in range(300):
        text, spans = pii._written_window(held, "ther ea ndst inhe or tible anre thion ed of")
        found = pii.tagged_spans([text], [[]], tagger)[0]
        hit, total, wrong = hit + len(set(found) & set(spans)), total + len(spans), wrong + len(set(found) - set(spans))
    assert hit >= 0.9 * total and wrong <= 0.1 * total


def test_added_spans_at_every_offset():
    """Spelled-out addresses in either case are found wherever they stand in a window or a stretch."""
    tagger = pii.fit_tagger(("the onhe ation wh erthe sted anin",))
    filler = "word other thing near " * 12
    long = "marolistjokaelanberomikast [at] jorostelanbelimi [dot] com"
    for form in ("jane.roe [AT] hosten [DOT] com", "JANEMI (AT) HOSTEN (DOT) ORG", "karoel [at] stmian [dot] net", long):
        for pad in range(0, 2 * pii.STRIDE, 3):
            for tail in (filler, "", " 7 " + filler):
                text = (filler[:pad].rstrip() + " " + form + " " + tail).strip()
                at = text.index(form)
                found = pii.tagged_spans([text], [pii.base_spans(text)], tagger)[0]
                assert ("email", at, at + len(form)) in found, text


def test_covered_places_are_overlaps():
    rng = Random(8)
    for _ in range(300):
        spans = [("ip", s, s + rng.randint(1, 9)) for s in (rng.randrange(30) for _ in range(rng.randrange(5)))]
        covered = pii._Covered(spans)
        for s in range(30):
            e = s + rng.randint(1, 9)
            assert covered(s, e) == any(a < e and s < b for _, a, b in spans)


def test_pages_held_out():
    sentences = ["Thand ern inther of the.", "Onre bletion and, th eres hathe in.", "A word or two.", "Heation ndth shthe ing, and the ouble of erst it was, then."]
    model = html_extract.fit_pages((f"<p>{' '.join(sentences)}</p>",))
    rng, scores = Random(123), []
    for _ in range(80):
        page, _, lines = html_extract.training_page(rng, sentences)
        kept = decode(page, model.trees.logits(features(page, model.odds)))
        for block, k in zip(page.blocks[1:], kept[1:]):
            assert not k or kept[block.parent]
        got, want = Counter(" ".join(lines_of(page, kept)).split()), Counter(" ".join(lines).split())
        scores.append(2 * sum((got & want).values()) / max(1, sum(got.values()) + sum(want.values())))
    assert np.mean(scores) >= 0.85


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    import html

    def article(page):
        inner = page[page.index("<article>") + 9 : page.index("</article>")].replace("<br>", " ")
        lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", part)).split()) for part in re.split(r"</?(?:p|h1)>", inner))
        return " ".join(line for line in lines if line)

    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert np.mean([got[k] == want[k] for k in want]) >= 0.98


def test_ordinal_grades_and_thresholds():
    rng = Random(5)
    rows, grades = [], []
    for _ in range(900):
        grade = rng.randrange(3)
        words = [rng.choice("abcdefgh") * 5 for _ in range(30)] + ["awful"] * (2 - grade) + ["fine"] * grade
        rows.append(toxicity.vector(" ".join(words + [f"x{rng.randrange(9999)}"])))
        grades.append(grade)
    model = ordinal.fit_ordinal(rows[:600], np.array(grades[:600]), l1=2.0)
    assert model.thresholds[0] < model.thresholds[1]
    weight = model.table()
    p = model.probabilities(np.array([sum(weight.get(b, 0.0) * v for b, v in zip(*r)) for r in rows[600:]]))
    assert (p.argmax(axis=1) == np.array(grades[600:])).mean() > 0.9 and np.allclose(p.sum(axis=1), 1)


def test_quality_and_toxicity_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    first, rest = labels.filter("doc_id % 3 > 0"), labels.filter("doc_id % 3 = 0")
    held = docs.join(rest.select("doc_id"), "doc_id")
    good = quality.rate_quality(held, quality.fit_quality(docs, quality.grades(first))).select("doc_id", "kept").join(rest, "doc_id").toPandas()
    assert good[good.quality == 1].kept.mean() > 0.97 and good[good.quality == 0].kept.mean() < 0.2
    bad = toxicity.rate_toxicity(held, toxicity.fit_toxicity(docs, toxicity.severities(first))).select("doc_id", F.col("toxic").alias("found")).join(rest, "doc_id").toPandas()
    assert bad[bad.toxic == 1].found.mean() > 0.75 and bad[bad.toxic == 0].found.mean() < 0.01


def _near_sets(texts):
    sets = []
    for t in texts:
        words = re.findall(rb"[^\x20\x09-\x0D]+", t.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
        sets.append({b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or (sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8)]
    a, b = np.array(pairs, int).reshape(-1, 2).T
    return links_to_labels(len(sets), a, b)


def test_near_duplicate_stage_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id")
    rows = docs.collect()
    label = _near_sets([r["text"] for r in rows])
    kept = corpus_pipeline.drop_copies(spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in kept) == [r["doc_id"] for i, r in enumerate(rows) if label[i] == i]


def test_near_duplicates_of_edited_texts(spark, monkeypatch):
    rng = Random(5)
    texts = []
    for _ in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([4, 9, 40, 300]))]
        for _ in range(rng.randint(1, 12)):
            own = list(words)
            for _ in range(rng.randint(0, 1 + len(words) // 20)):
                own[rng.randrange(len(own))] = f"w{rng.randrange(5000)}"
            texts.append(" ".join(own))
    label = _near_sets(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [jaccard.shingle_set(t) for t in texts]
    assert len(np.unique(label)) < len(texts) - 20
    firsts = {jaccard.set_print(s): i for i, s in reversed(list(enumerate(sets)))}
    one = sorted(firsts.values())
    found = jaccard.near_labels([sets[i] for i in one])
    assert [label[i] for i in one] == [label[one[k]] for k in found]
    assert len(set(found)) == len(set(label))
    placed = spark.createDataFrame([(0, jaccard.set_print(sets[i]), texts[i]) for i in one], "coarse long, print long, text string")
    links = [(firsts[r["a"]], firsts[r["b"]]) for r in jaccard.near_sets(placed, part_chars=20000).collect()]
    a, b = np.array(links).T
    assert (links_to_labels(len(texts), a, b)[one] == label[one]).all()
    assert sorted(r["doc_id"] for r in simhash.keep_first(docs).collect()) == np.unique(label).tolist()


def test_pipeline_stage_goes_through_fingerprints(spark, monkeypatch):
    """Copies that share no band value meet by their fingerprints."""
    words = [f"w{i}" for i in range(400)]
    near = words[:200] + ["other"] + words[201:]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[::-1])), (4, None), (5, "")], "doc_id long, text string")
    bits = bin((simhash.fingerprint(" ".join(words), jaccard.SHINGLE) ^ simhash.fingerprint(" ".join(near), jaccard.SHINGLE)) & (2**64 - 1)).count("1")
    monkeypatch.setattr(simhash.near_duplicates, "__defaults__", ("doc_id", "text", max(2, bits), simhash.SHINGLE))
    monkeypatch.setattr(jaccard, "bands", lambda found: np.zeros(0, np.int64))
    assert sorted(r["doc_id"] for r in simhash.keep_first(docs).collect()) == [1, 3, 4]

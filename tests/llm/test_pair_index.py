"""Encoding by the pair occurrence index against the tokenizers library."""

from random import Random

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from motioncat.llm import pair_index

LIBRARY = tokenizers.Tokenizer.from_file(public_tokenizers.path(pair_index.TOKENIZER))
ODD = [*"ab eThoni.,\n\t'st1é日  \x1c\x1f\x85\xa0　_-@ΣİǅǺ̊가ᅡ٣½<|>\x00", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'ll", "'S", "\U0001f600"]


def check(texts, encoder=None):
    encoder = encoder or pair_index.IndexEncoder()
    for text, coded in zip(texts, encoder.texts(texts)):
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(coded, "<u4").tolist() == ids, text[:200]
        assert pair_index.decode_ids(coded, encoder.vocab).decode() == LIBRARY.decode(ids, skip_special_tokens=False)


def test_odd_characters():
    rng = Random(1)
    check(["".join(rng.choice(ODD) for _ in range(rng.randint(0, 80))) for _ in range(3000)])
    spans = [(1, 0x250), (0x250, 0xD7FF), (0xE000, 0x10FFFF)]
    check(["".join(chr(rng.randint(*rng.choice(spans))) for _ in range(30)) for _ in range(3000)])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_any_texts(texts):
    check(texts)


@pytest.mark.parametrize("text", ["a" * 99_999, "ab" * 50_000, "日本" * 3000, " " * 1_000_000, "x-" * 100_000, "\n" * 100_000, "Word " * 50_000], ids=len)
def test_long_texts(text):
    check([text])


def test_words_of_one_slice_do_not_touch():
    vocab = pair_index.word_vocabulary()
    words = [b"aaa", b"a", b"aaaaaaa", b"th", b"e", b"the", "é".encode()]
    assert pair_index.merge_words(words, vocab) == [pair_index.merge_words([w], vocab)[0] for w in words]
    assert pair_index.merge_words([], vocab) == []


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(pair_index, "CACHED_CHUNKS", 3)
    encoder = pair_index.IndexEncoder()
    for _ in range(3):
        check(["some words here", "and some others there", "x" * 100], encoder)


def test_rows_and_columns(spark):
    rows = [(1, "A text."), (1, "A text."), (None, "no key"), (2, None), (3, ""), (4, "\x00 <|endoftext|>é")]
    docs = spark.createDataFrame([(k, t, "c", "d") for k, t in rows], "doc_id long, text string, ids string, key string")
    coded = pair_index.encode_texts(docs, decode=True).collect()
    want = [(k, LIBRARY.encode(t or "", add_special_tokens=False).ids) for k, t in rows]
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in coded), key=repr) == sorted(want, key=repr)
    again = pair_index.decode_texts(pair_index.encode_texts(docs)).collect()
    assert sorted((r.decoded for r in again)) == sorted(r.decoded for r in coded) == sorted(LIBRARY.decode(ids, skip_special_tokens=False) for _, ids in want)
    assert pair_index.encode_texts(docs.limit(0)).collect() == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pair_index.encode_texts(docs, decode=True).collect():
        ids = LIBRARY.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.decoded == LIBRARY.decode(ids, skip_special_tokens=False)

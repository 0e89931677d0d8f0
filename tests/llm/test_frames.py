"""Fill-in-middle over frames against a plain version, with frames of every size."""

import hashlib
import re
from random import Random

import pytest
from motioncat.llm import frames

ROWS = [(k, "".join(Random(k).choice(["a", "Zb", "é", "日", " ", "\n", "<", "P>", "<P", "word", "1", "\U0001f600"]) for _ in range([0, 1, 5, 50, 400][k % 5]))) for k in range(300)]
ROWS += [(1000, "a" * 50000), (1001, "日" * 9000), (1002, None), (1003, "x y" * 40000), (1004, "see <S> here"), (None, "no key at all"), (7, "again"), (7, "again"), (1005, "\x00 é"), (1006, " " * 1_000_000)]


def plainly(key, text):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digits = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"


@pytest.mark.parametrize("size", [7, 64, frames.FRAME_BYTES])
def test_against_plain_version(spark, size):
    rows = ROWS if size > 60 else ROWS[:-1]
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], "doc_id long, text string, frames string, form string").repartition(3)
    moved = frames.fill_in_middle(frames.store_frames(docs, size=size))
    made = frames.restore_texts(moved, ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"), with_text=True).collect()
    got = sorted(((r.doc_id, r.restored, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made), key=repr)
    assert got == sorted(((k, t or "", *plainly(k, t or "")) for k, t in rows), key=repr)
    for r in made:
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(r.restored.encode()).hexdigest()
    assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_selection_reads_cut_frames_only():
    text = "".join(Random(2).choice(["word", " ", "é", "1"]) for _ in range(5000))
    held = frames.Frames(size=100)
    held.append(text.encode())
    held.close()
    read = []
    plain, held.plain = held.plain, lambda k: read.append(k) or plain(k)
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    total = frames.Place(held.chars, held.bytes)
    assert (held.units, held.chars, held.bytes) == (len(units), len(text), len(text.encode()))
    for k in (0, 1, 777, len(units) - 1, len(units)):
        read.clear()
        head = "".join(units[:k])
        assert held.place(k, total, len(units)) == (len(head), len(head.encode()))
        assert len(read) <= 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert frames.restore_texts(frames.fill_in_middle(frames.store_frames(docs))).collect() == []

"""Personal data: fixed patterns, and a character tagger that adds what they miss.

The patterns (``base``): email, ip, card (12 to 19 digits, Luhn), phone (9 to 15 digits after
a plus sign); leftmost, without overlap within a kind, and dropped without retry if a check on
the match fails. They are searched in linear time, however long a run of digits or letters.

The tagger: a bidirectional LSTM over characters with CRF transitions, trained in numpy from
labelled spans: windows of the documents with their base spans, and the same windows with
spans of known place written into them, in base form and in forms that the patterns do not
know (spelled-out addresses, phone numbers without a plus sign, cards with other separators),
as well as with look-alikes that are no personal data. At most ``TRAIN_WINDOWS`` windows are used.

Every labelled span holds a digit or an at sign, spelled out or not and in either case, so a text
is read in full for those, and the tagger sees overlapping windows over every stretch around one.
Windows are decoded one by one. A span that touches the inner edge of its window is left to a
window that sees it whole; where it overlaps no base span, one more window is laid over that edge,
so that the ends of a stretch are read like its middle (spans of up to ``WINDOW`` - ``BESIDE``
characters). Spans are reconciled over the whole text: one that overlaps a base span is dropped,
and of the others the set without overlap that has the greatest total margin stays.

Nulls: a null text counts as empty and has no spans. Repeated rows each get their row. A table
without any trigger is tagged by a tagger trained on invented windows alone. Other columns do
not matter.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motioncat.llm.common import byte_slices, lowest_hashes, materialize
from motioncat.llm.pii_model import KINDS, WINDOW, Tagger, classes, tags_of, train

TRAIN_WINDOWS = 400
WRITTEN_WINDOWS = 1200
CONTEXT = 32
STRIDE = 48
BESIDE = 16
MARGIN = 0.3
SLICE_BYTES = 2_000_000
WINDOWS_AT_ONCE = 1024
Span = tuple[str, int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[\[({ ][aA][tT][\])} ]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind and place."""
    found: list[Span] = []
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            found.append(("email", start, domain.end()))
            after = domain.end()
        at = text.find("@", max(at + 1, after))
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() <= 37 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def windows(text: str) -> list[tuple[int, int]]:
    """Overlapping (start, end) windows over every stretch of a text that has a digit or an at sign."""
    out: list[tuple[int, int]] = []
    low = high = -1
    stretches = []
    for m in _TRIGGER.finditer(text):
        if low >= 0 and m.start() <= high + CONTEXT:
            high = m.end()
        else:
            if low >= 0:
                stretches.append((low, high))
            low, high = m.span()
    if low >= 0:
        stretches.append((low, high))
    for low, high in stretches:
        start, stop = max(0, low - CONTEXT), min(len(text), high + CONTEXT)
        while True:
            out.append((start, min(start + WINDOW, len(text))))
            if start + WINDOW >= stop:
                break
            start += STRIDE
    return out


def reconcile(spans: list[tuple[float, str, int, int]], base: list[Span]) -> list[Span]:
    """The heaviest set of spans without overlap, beside the base spans."""
    covered = _Covered(base)
    best_of: dict[Span, float] = {}
    for weight, kind, s, e in spans:
        if not covered(s, e):
            best_of[kind, s, e] = max(weight, best_of.get((kind, s, e), 0.0))
    free = sorted(best_of, key=lambda x: (x[2], x[1], x[0]))
    ends = [x[2] for x in free]
    best = [0.0]
    chosen: list[int] = []
    for i, x in enumerate(free):
        prior = int(np.searchsorted(ends[:i], x[1], side="right"))
        with_it = best[prior] + best_of[x]
        chosen.append(prior if with_it > best[-1] else -1)
        best.append(max(best[-1], with_it))
    out, i = [], len(free)
    while i:
        if chosen[i - 1] >= 0:
            out.append(free[i - 1])
            i = chosen[i - 1]
        else:
            i -= 1
    return out[::-1]


def _plausible(kind: str, text: str, around: str) -> bool:
    """May ``text`` be of this kind? A piece of a longer word or number, as in a hash or key, is not."""
    if any(c.isalnum() for c in around):
        return False
    digits = len(_DIGIT.findall(text))
    if kind == "email":
        low = text.lower()
        return "@" in low or ("at" in low and ("dot" in low or "." in low))
    if kind == "ip":
        return 4 <= digits <= 12
    return 12 <= digits <= 19 if kind == "card" else 7 <= digits <= 15


def tagged_spans(texts: list[str], base: list[list[Span]], tagger: Tagger) -> list[list[Span]]:
    """Spans that the tagger adds to each text's base spans."""
    where = [(k, s, e) for k, t in enumerate(texts) for s, e in windows(t)]
    seen: list[list[tuple[float, str, int, int]]] = [[] for _ in texts]
    covered = [_Covered(b) for b in base]
    cut = _read_windows(where, texts, tagger, seen, covered)
    looked = {(k, s) for k, s, _ in where}
    more = sorted({(k, s, min(s + WINDOW, len(texts[k]))) for k, s in cut if (k, s) not in looked})
    _read_windows(more, texts, tagger, seen, covered)
    return [reconcile(s, b) for s, b in zip(seen, base)]


class _Covered:
    """Does a place of the text overlap one of some spans?"""

    def __init__(self, spans: list[Span]) -> None:
        taken = sorted((s, e) for _, s, e in spans)
        self.starts = [s for s, _ in taken]
        self.furthest = list(accumulate((e for _, e in taken), max))

    def __call__(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end) - 1
        return i >= 0 and self.furthest[i] > start


def _read_windows(where: list[tuple[int, int, int]], texts: list[str], tagger: Tagger, seen: list[list[tuple[float, str, int, int]]], covered: list[_Covered]) -> list[tuple[int, int]]:
    """Add what the tagger sees in windows to ``seen``; (text, start) of windows over the inner edges that cut a span."""
    over = []
    for at in range(0, len(where), WINDOWS_AT_ONCE):
        part = where[at : at + WINDOWS_AT_ONCE]
        shown = [texts[k][s:e] + ("\n" if e == len(texts[k]) else "") for k, s, e in part]  # the end of a text reads like the end of a line
        tags, margin = tagger.decode(np.stack([classes(t) for t in shown]))
        for row in np.nonzero(tags.any(axis=1))[0]:
            k, low, high = part[row]
            own = tags[row]
            begins = np.nonzero(own % 2 == 1)[0]
            for b in begins:
                inside, e = own[b] + 1, b + 1
                while e < WINDOW and own[e] == inside:
                    e += 1
                s, stop, kind = low + int(b), min(low + int(e), high), KINDS[(own[b] - 1) // 2]
                if covered[k](s, stop):
                    continue
                open_left, open_right = b == 0 and low > 0, stop == high and high < len(texts[k])
                if open_left:
                    over.append((k, max(0, stop + BESIDE - WINDOW)))
                if open_right or stop == low + WINDOW:
                    over.append((k, max(0, s - BESIDE)))
                sure = float(margin[row, b:e].mean())
                if not (open_left or open_right) and sure >= MARGIN and _plausible(kind, texts[k][s:stop], texts[k][max(0, s - 1) : s] + texts[k][stop : stop + 1]):
                    seen[k].append((sure * (stop - s), kind, s, stop))
    return over


# ---- training ----

def _number(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _card_number(rng: random.Random) -> str:
    head = rng.choice("3456") + _number(rng, rng.choice([13, 14, 14, 14, 14]))
    return next(head + d for d in "0123456789" if luhn(head + d))


def _name(rng: random.Random) -> str:
    return "".join(rng.choice(["an", "el", "ro", "mi", "ka", "st", "er", "jo", "li", "be"]) for _ in range(rng.randint(2, 4)))


def written(rng: random.Random) -> tuple[str | None, str]:
    """(kind or None, text) of one invented span or look-alike."""
    pick = rng.randrange(16)
    name, host, top = _name(rng), _name(rng), rng.choice(["com", "org", "net", "de", "co.uk"])
    if pick in (0, 1):
        return "email", f"{name}{rng.choice(['', '.', '_'])}{_number(rng, rng.randint(0, 3))}@{host}{rng.choice(['', '7', '.example'])}.{top}"
    if pick in (2, 3):
        o, c = rng.choice(["[]", "()", "{}", "  "])
        o, c = (" " + o, c + " ") if rng.random() < 0.5 and o != " " else (o, c)
        spelled = f"{name}{o}at{c}{host}{o}dot{c}{top.split('.')[0]}"
        case = rng.randrange(4)
        if case == 0:
            return "email", spelled.upper()
        return "email", spelled.replace(f"{o}at{c}", f"{o}AT{c}").replace(f"{o}dot{c}", f"{o}DOT{c}") if case == 1 else spelled
    if pick in (4, 5):
        return "ip", ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if pick == 6:
        return "ip", rng.choice(["[.]", "(.)", " . "]).join(str(rng.randint(0, 255)) for _ in range(4))
    if pick in (7, 8):
        card = _card_number(rng)
        sep = rng.choice(["", "", "", " ", "-", ".", "/"])
        return "card", sep.join(card[i : i + 4] for i in range(0, len(card), 4))
    a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
    if pick in (9, 10):
        return "phone", rng.choice(["+1 ", "+49 ", "+33 ", "+34-"]) + rng.choice([f"({a}) {b}-{c}", f"{a} {b} {c}", f"{a}-{b}-{c}"])
    if pick in (11, 12):
        return "phone", rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"001 {a} {b} {c}"])
    year = f"{rng.randint(1950, 2030)}"
    return None, rng.choice([
        f"{year}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{year}", year,
        f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}", f"{rng.randint(1, 999)},{_number(rng, 3)}.{_number(rng, 2)}",
        f"password={rng.getrandbits(80):020x}", f"token = \"{rng.getrandbits(120):030x}\"", f"AK{_name(rng).upper()}{_number(rng, 6)}",
        f"{rng.randint(1, 99)}%", f"{rng.randint(1, 12)}:{_number(rng, 2)}", f"@{name}", f"{name} at {host}", f"{rng.randint(1, 9999)}", f"http://{host}.{top}/{rng.randint(1, 999)}",
    ])


def _written_window(rng: random.Random, context: str) -> tuple[str, list[Span]]:
    words = context.split() or [_name(rng) for _ in range(14)]
    text, spans = "", []
    put = rng.choice([0, 1, 1, 1, 2])
    places = sorted(rng.sample(range(len(words) + 1), min(put, len(words) + 1)))
    for i in range(len(words) + 1):
        if i in places:
            kind, value = written(rng)
            text += rng.choice(["", "", "("]) if text else ""
            if kind and len(text) + len(value) <= WINDOW:
                spans.append((kind, len(text), len(text) + len(value)))
            elif kind:
                break
            text += value + rng.choice([" ", " ", ", ", ". ", "\n"])
        if i < len(words):
            text += words[i] + " "
    return text[:WINDOW], spans


@lru_cache(maxsize=4)
def fit_tagger(rows: tuple[str, ...]) -> Tagger:
    """Train on windows of real text: as they are, with their base spans, and rewritten."""
    rng = random.Random(11)
    shown = [(t, base_spans(t)) for t in rows]
    bare = [" ".join(w for w in t.split() if not _TRIGGER.search(w)) for t in rows]
    shown += [_written_window(rng, rng.choice(bare) if bare else "") for _ in range(WRITTEN_WINDOWS)]
    flat = []
    for text, spans in shown:
        whole: list[Span] = []
        for span in sorted(spans, key=lambda s: (s[1], s[1] - s[2])):
            if not whole or span[1] >= whole[-1][2]:
                whole.append(span)
        flat.append((classes(text), tags_of(whole)))
    return train(np.stack([f[0] for f in flat]), np.stack([f[1] for f in flat]))


def training_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = TRAIN_WINDOWS) -> tuple[str, ...]:
    """At most ``limit`` windows, one of a document that has any, of those whose ids hash lowest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts = []
            for _, _, raw in byte_slices(batch.column(1), SLICE_BYTES):
                for t in map(bytes.decode, raw):
                    m = _TRIGGER.search(t)
                    start = max(0, m.start() - CONTEXT) if m else 0
                    firsts.append(t[start : start + WINDOW] if m else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(firsts, pa.string())], names=["h", "window"])

    found = docs.select(F.col(key).cast("string").alias("h"), text).mapInArrow(run, "h string, window string")
    rows = lowest_hashes(materialize(found.filter("window is not null"), "windows"), "h", limit).collect()
    return tuple(sorted(r["window"] for r in rows))


# ---- operators ----

def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """(key, spans array<struct<kind,start,end,base>>) for every row, by place and kind; code points, end exclusive."""
    return _mapped(docs, [key], text, tagger, redact=False)


def redact_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in angle brackets; overlapping spans by the first's."""
    if tagger is None:
        tagger = fit_tagger(training_windows(docs, key, text))
    return _mapped(docs, [c for c in docs.columns if c != text], text, tagger, redact=True).select(*docs.columns)


def redacted(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _mapped(docs: DataFrame, carried: list[str], text: str, tagger: Tagger | None, redact: bool) -> DataFrame:
    if tagger is None:
        tagger = fit_tagger(training_windows(docs, carried[0], text))
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
        for batch in batches:
            given = batch.column(batch.num_columns - 1)
            for i, j, raw in byte_slices(given, SLICE_BYTES):
                texts = [t.decode() for t in raw]
                base = [base_spans(t) for t in texts]
                more = tagged_spans(texts, base, model)
                if redact:
                    out = pa.array([redacted(t, b + m) for t, b, m in zip(texts, base, more)], pa.string())
                    out = pc.if_else(given[i:j].is_valid(), out, pa.scalar(None, pa.string()))
                else:
                    rows = []
                    for b, m in zip(base, more):
                        every = [(s, KINDS.index(k), e, True) for k, s, e in b] + [(s, KINDS.index(k), e, False) for k, s, e in m]
                        rows.append([{"kind": KINDS[k], "start": s, "end": e, "base": own} for s, k, e, own in sorted(every)])
                    out = pa.array(rows, pa.list_(span))
                yield pa.RecordBatch.from_arrays([*(c[i:j] for c in batch.columns[:-1]), out], names=[f"c{n}" for n in range(batch.num_columns)])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried]
    fields.append(f"`{text}` string" if redact else "spans array<struct<kind:string,start:long,`end`:long,base:boolean>>")
    return docs.select(*carried, text).mapInArrow(run, ", ".join(fields))

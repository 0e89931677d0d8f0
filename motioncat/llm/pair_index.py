"""Word-end BPE by a pair occurrence index, and its decoding.

Encoding. The distinct new words of a slice of a partition are laid out one after another as
symbols, with a border between words. An index maps every pair of neighbours that has a rank to
all its positions in the slice. Active ranks are taken from a heap in ascending order; all
positions of a rank are merged, left to right, and each merge puts the pairs it makes with its
two neighbours on the lists of their ranks. An entry whose symbols have changed since is passed
over when its list is read. Since a token is made by one rank only, and no rank uses a token
that a later one makes (checked when the file is read), a pair that arises has a higher rank
than the one at work, so one ascending pass gives the merges that a word by itself would get.

Splitting. Added tokens are cut out first; then text is cut at white space, which the
vocabulary drops, and distinct chunks are normalized and split into words on their own: no
normal form, lower case or word reaches over white space. Chunks beyond ASCII go through the
library's own normalizer and splitter, whose Unicode tables decide.

Decoding joins the strings of the ids by single spaces, as the library does for a vocabulary
that names no decoder.

Nulls: a null text counts as empty; empty texts give no ids and decode to the empty string.
Repeated rows, and rows with a null key, each get their own result. Other columns are dropped,
so their names do not matter. An empty table gives no rows. A very long text is one row of
work; words of any length are merged in linear space.
"""

from __future__ import annotations

import json
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame

from motioncat.llm.common import byte_slices

TOKENIZER = "word_bpe_49k.json"
BORDER = (1 << 16) - 1
SLICE_BYTES = 4_000_000
CACHED_CHUNKS = 300_000
LONGEST_CACHED = 64
MANY_PLACES = 48
# The words of a lower-case ASCII chunk by the pattern in the file.
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
# Unicode's white space. str.split would also cut at the separators U+001C to U+001F.
NOT_SPACE = re.compile("[^\t-\r \x85\xa0  -     　]+")
SEPARATORS = re.compile("[\x1c-\x1f]")


class WordVocabulary:
    """Merges, symbols and added tokens of a tokenizer file with word ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as held:
            described = json.load(held)
        model, self.added = described["model"], {t["content"]: t["id"] for t in described["added_tokens"]}
        ids, end = model["vocab"], model["end_of_word_suffix"]
        if max(ids.values(), default=0) >= BORDER:
            raise ValueError("ids must fit 16 bits with one to spare")
        self.strings = [b""] * (1 + max([*ids.values(), *self.added.values()]))
        for token, i in [*ids.items(), *self.added.items()]:
            self.strings[i] = token.encode()
        self.gaps = b"" in self.strings
        self.ranks: dict[int, int] = {}
        self.merges: list[tuple[int, int, int]] = []
        made: dict[int, int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            left, right, whole = ids[a], ids[b], ids[a + b]
            if whole in made or max(made.get(left, -1), made.get(right, -1)) >= rank:
                raise ValueError("every token must be made by one merge, after its parts")
            made[whole] = rank
            self.ranks[left << 16 | right] = rank
            self.merges.append((left, right, whole))
        letters = byte_letters()
        pairs = np.array(self.merges, np.int64).reshape(-1, 3)[:, :2]
        self._partners = [(order, np.searchsorted(pairs[order, side], np.arange(BORDER + 2)), pairs[order, 1 - side]) for side in (0, 1) for order in [np.argsort(pairs[:, side], kind="stable")]]
        self._lookup = np.full(BORDER + 1, -1, np.int32)
        self.inner = np.array([ids[c] for c in letters], np.int32)
        self.last = np.array([ids[c + end] for c in letters], np.int32)
        self.first_ranks = np.full((256, 2, 256, 2), -1, np.int32)  # of pairs of bytes, each within a word or ending it
        single = {int(s[b]): (b, k) for k, s in enumerate((self.inner, self.last)) for b in range(256)}
        for rank, (a, b, _) in enumerate(self.merges):
            if a in single and b in single:
                self.first_ranks[(*single[a], *single[b])] = rank

    def ranks_after(self, token: int, others: np.ndarray) -> np.ndarray:
        """Ranks of the pairs of ``token`` and each of ``others`` after it; -1 for none."""
        return self._ranks(0, token, others)

    def ranks_before(self, token: int, others: np.ndarray) -> np.ndarray:
        """Ranks of the pairs of each of ``others`` and ``token`` after it; -1 for none."""
        return self._ranks(1, token, others)

    def _ranks(self, side: int, token: int, others: np.ndarray) -> np.ndarray:
        ranks, starts, partners = self._partners[side]
        held = slice(starts[token], starts[token + 1])
        self._lookup[partners[held]] = ranks[held]
        found = self._lookup[others]
        self._lookup[partners[held]] = -1
        return found


def byte_letters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]


@lru_cache(maxsize=2)
def word_vocabulary(path: str | None = None) -> WordVocabulary:
    return WordVocabulary(path or public_tokenizers.path(TOKENIZER))


class PairIndex:
    """Symbols of words laid out with borders between them, and the places of every pair that has a rank.

    ``symbol`` is -1 where a symbol has gone into its left neighbour; ``following`` and ``before``
    lead to the neighbours that are left. Long lists of places are merged by arrays, short ones
    one by one.
    """

    def __init__(self, words: list[bytes], vocab: WordVocabulary) -> None:
        self.vocab = vocab
        raw = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
        self.ends = np.cumsum([len(w) + 1 for w in words])  # places of the borders after each word
        self.border = np.zeros(len(raw), bool)
        self.border[0] = True
        self.border[self.ends] = True
        last = np.append(self.border[1:], True)
        self.symbol = np.where(self.border, BORDER, np.where(last, vocab.last[raw], vocab.inner[raw])).astype(np.int32)
        self.following = np.arange(1, len(raw) + 1, dtype=np.int32)
        self.before = np.arange(-1, len(raw) - 1, dtype=np.int32)
        self.arrays: defaultdict[int, list[np.ndarray]] = defaultdict(list)
        self.single: defaultdict[int, list[int]] = defaultdict(list)
        self.heap: list[int] = []
        ranks = vocab.first_ranks[raw[:-1], 0, raw[1:], last[1:].astype(np.int8)]
        ranks[self.border[:-1] | self.border[1:]] = -1
        self._note(np.arange(len(ranks), dtype=np.int32), ranks)

    def _note(self, places: np.ndarray, ranks: np.ndarray) -> None:
        """Add ``places`` to the lists of their pairs' ``ranks``; -1 stands for no rank."""
        there = np.flatnonzero(ranks >= 0)
        there = there[np.argsort(ranks[there], kind="stable")]
        active, starts = np.unique(ranks[there], return_index=True)
        for rank, found in zip(active.tolist(), np.split(places[there], starts[1:])):
            if rank not in self.arrays and rank not in self.single:
                heappush(self.heap, rank)
            self.arrays[rank].append(found)

    def merge_all(self) -> None:
        """Apply active ranks in ascending order until no list is left."""
        while self.heap:
            rank = heappop(self.heap)
            arrays, single = self.arrays.pop(rank, []), self.single.pop(rank, [])
            if len(single) + sum(map(len, arrays)) >= MANY_PLACES:
                self._merge_many(rank, np.unique(np.concatenate([*arrays, np.array(single, np.int32)])))
            else:
                self._merge_few(rank, [*single, *(p for a in arrays for p in a.tolist())])

    def _merge_many(self, rank: int, found: np.ndarray) -> None:
        left, right, whole = self.vocab.merges[rank]
        symbol, following, before = self.symbol, self.following, self.before
        found = found[symbol[found] == left]
        gone = following[found]
        there = symbol[gone] == right
        found, gone = found[there], gone[there]
        if left == right and len(found):  # of overlapping pairs every other one is merged, from the left
            nth = np.arange(len(found))
            first = np.concatenate([[True], found[1:] != gone[:-1]])
            chosen = (nth - np.maximum.accumulate(np.where(first, nth, 0))) % 2 == 0
            found, gone = found[chosen], gone[chosen]
        after = following[gone]
        symbol[found], symbol[gone] = whole, -1
        following[found], before[after] = after, found
        ahead = before[found]
        self._note(ahead, self.vocab.ranks_before(whole, symbol[ahead]))
        self._note(found, self.vocab.ranks_after(whole, symbol[after]))

    def _merge_few(self, rank: int, found: list[int]) -> None:
        left, right, whole = self.vocab.merges[rank]
        symbol, following, before = map(memoryview, (self.symbol, self.following, self.before))
        rank_of, arrays, single = self.vocab.ranks.get, self.arrays, self.single
        if left == right:
            found.sort()
        for at in found:
            if symbol[at] != left:
                continue
            gone = following[at]
            if symbol[gone] != right:
                continue
            after, ahead = following[gone], before[at]
            symbol[at], symbol[gone] = whole, -1
            following[at], before[after] = after, at
            for place, pair in ((ahead, symbol[ahead] << 16 | whole), (at, whole << 16 | symbol[after])):
                new = rank_of(pair)
                if new is not None:
                    if new not in single and new not in arrays:
                        heappush(self.heap, new)
                    single[new].append(place)

    def ids(self) -> list[bytes]:
        """What is left of every word, as little-endian 32-bit bytes."""
        kept = (self.symbol >= 0) & ~self.border
        bounds = 4 * np.concatenate([[0], np.cumsum(kept)[self.ends]])
        ids = self.symbol[kept].astype("<u4").tobytes()
        return [ids[i:j] for i, j in zip(bounds.tolist(), bounds[1:].tolist())]


def merge_words(words: list[bytes], vocab: WordVocabulary) -> list[bytes]:
    """Ids of every word (UTF-8, not empty) as little-endian 32-bit bytes, by one pair occurrence index over all of them."""
    if not words:
        return []
    index = PairIndex(words, vocab)
    index.merge_all()
    return index.ids()


class IndexEncoder:
    """Encodes slices of texts; chunks of earlier slices are remembered, up to a bound."""

    def __init__(self, path: str | None = None) -> None:
        self.vocab = word_vocabulary(path)
        library = tokenizers.Tokenizer.from_file(path or public_tokenizers.path(TOKENIZER))
        self.normal, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.bytes_of = {c: b for b, c in enumerate(byte_letters())}
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(self.vocab.added, key=len, reverse=True))) + ")") if self.vocab.added else None
        self.known: dict[str, bytes] = {}
        self.merged: dict[bytes | int, bytes] = {}

    def _words(self, chunk: str) -> list[bytes]:
        if chunk.isascii():
            return [w.encode() for w in ASCII_WORDS.findall(chunk.lower())]
        return [bytes(map(self.bytes_of.__getitem__, w)) for w, _ in self.cut(self.normal(chunk))]

    def _parts(self, chunk: str) -> list[bytes | int]:
        """Words, and ids of added tokens, of a chunk."""
        if self.added is None or "<|" not in chunk and not self.added.search(chunk):
            return self._words(chunk)
        out: list[bytes | int] = []
        for k, piece in enumerate(self.added.split(chunk)):
            out.extend([self.vocab.added[piece]] if k % 2 else self._words(piece))
        return out

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian 32-bit bytes."""
        chunked = [NOT_SPACE.findall(t) if SEPARATORS.search(t) else t.split() for t in texts]
        for cache in (self.known, self.merged):
            if len(cache) > CACHED_CHUNKS:
                cache.clear()
        known, merged = self.known, self.merged
        fresh = list(dict.fromkeys(c for chunks in chunked for c in chunks if c not in known))
        parts = [self._parts(c) for c in fresh]
        words = list(dict.fromkeys(p for found in parts for p in found if p not in merged and isinstance(p, bytes)))
        merged.update(zip(words, merge_words(words, self.vocab)))
        merged.update((i, i.to_bytes(4, "little")) for i in self.vocab.added.values())
        known.update((c, b"".join([merged[p] for p in found])) for c, found in zip(fresh, parts))
        out = [b"".join([known[c] for c in chunks]) for chunks in chunked]
        for chunk in fresh:
            if len(chunk) > LONGEST_CACHED:
                del known[chunk]
        for word in words:
            if len(word) > LONGEST_CACHED:
                del merged[word]
        return out


def decode_ids(ids: bytes, vocab: WordVocabulary) -> bytes:
    """UTF-8 of the text that little-endian 32-bit ``ids`` decode to; ids without a token have no part in it."""
    found, strings = array("I", ids), vocab.strings
    if found and (max(found) >= len(strings) or vocab.gaps):
        return b" ".join([strings[i] for i in found if i < len(strings) and strings[i]])
    return b" ".join(map(strings.__getitem__, found))


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, decode: bool = False) -> DataFrame:
    """(key, ids binary[, decoded string]) for every row of ``docs``; ids are little-endian 32-bit numbers."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = IndexEncoder(path)
        for batch in batches:
            for i, j, texts in byte_slices(batch.column(1), SLICE_BYTES):
                ids = encoder.texts([t.decode() for t in texts])
                columns = [batch.column(0)[i:j], pa.array(ids, pa.binary())]
                if decode:
                    columns.append(pa.array([decode_ids(c, encoder.vocab) for c in ids], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["key", "ids", "decoded"][: len(columns)])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids binary{', decoded string' if decode else ''}")


def decode_texts(coded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, decoded string) for every row of ``coded``; null ids decode to the empty string."""
    kind = coded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = word_vocabulary(path)
        for batch in batches:
            for i, j, parts in byte_slices(batch.column(1), SLICE_BYTES):
                decoded = pa.array([decode_ids(c, vocab) for c in parts], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], decoded], names=["key", "decoded"])

    return coded.select(key, ids).mapInArrow(run, f"`{key}` {kind}, decoded string")

"""Byte-level BPE by monoid tree reduction.

Encoding. Every match of the vocabulary's pattern is a word. A word is cut in halves down to
leaves of a few bytes, whose merges are done directly by rank; on the way up, two neighbouring
token lists are joined: the last tokens of the left and the first of the right are encoded
together as one window, which doubles until the tokens outside have provably stabilised. The
proof is the pair rule of rank-ordered merging: a token list is the encoding of its bytes
exactly if every two neighbours are the encoding of their joint bytes. A window's tokens are
an encoding, and so are both outer lists, so only the two seams have to be looked at. Within a
long word, equal halves are encoded once, so that a word that repeats itself costs little more
than its length.

Texts are cut into chunks (a run of other characters with the space before it, or white space)
over which no match of the pattern reaches; chunks and words seen before are remembered.

Decoding concatenates token bytes up the same kind of tree.

Nulls: a null text counts as empty; empty texts give no ids. Repeated rows each get their own
result; other columns, whatever their names, are carried through or dropped as asked.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from motioncat.llm.bpe import CHUNKS, PATTERN, Vocabulary, vocabulary
from motioncat.llm.common import byte_slices, slices

LEAF_BYTES = 5
SCANNED_BYTES = 64
CACHED_PAIRS = 300_000
CACHED_WORDS = 500_000
LONGEST_CACHED = 64
SLICE_BYTES = 1_000_000


class TreeEncoder:
    """Encodes words (pattern matches) by tree reduction."""

    def __init__(self, vocab: Vocabulary, leaf: int = LEAF_BYTES) -> None:
        self.vocab, self.leaf = vocab, leaf
        self.seen: dict[str, bytes] = {}
        self.small: dict[bytes, list[int]] = {}
        self.pairs: dict[int, list[int]] = {}

    def word(self, data: bytes) -> list[int]:
        return self._tree(data, {})

    def _tree(self, data: bytes, halves: dict[bytes, list[int]]) -> list[int]:
        whole = self.vocab.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(data) <= self.leaf:
            return self._small(data)
        known = halves.get(data)
        if known is not None:
            return known
        half = len(data) // 2
        ids = self._join(self._tree(data[:half], halves), self._tree(data[half:], halves))
        if len(data) > LONGEST_CACHED:
            halves[data] = ids
        return ids

    def text(self, text: str) -> bytes:
        """Ids of a text as 32-bit bytes: every pattern match on its own; recent chunks and words are remembered."""
        chunks = CHUNKS.findall(text)
        seen = self.seen
        fresh = {c for c in chunks if c not in seen}
        if fresh:
            if len(seen) > CACHED_WORDS:
                seen.clear()
                fresh = set(chunks)
            for chunk in fresh:
                seen[chunk] = self._chunk(chunk)
        ids = b"".join([seen[c] for c in chunks])
        for chunk in fresh:
            if len(chunk) > LONGEST_CACHED:
                del seen[chunk]
        return ids

    def _chunk(self, chunk: str) -> bytes:
        found = [chunk] if chunk.isascii() and chunk[chunk[0] == " " :].isalpha() else PATTERN.findall(chunk)
        if len(found) == 1:
            return array("I", self.word(chunk.encode())).tobytes()
        coded = []
        for word in found:
            ids = self.seen.get(word)
            if ids is None:
                ids = array("I", self.word(word.encode())).tobytes()
                if len(word) <= LONGEST_CACHED:
                    self.seen[word] = ids
            coded.append(ids)
        return b"".join(coded)

    def _join(self, left: list[int], right: list[int]) -> list[int]:
        inner = self._pair(left[-1], right[0])
        if len(inner) == 2 and inner[0] == left[-1]:
            return left + right
        width, tokens = 1, self.vocab.tokens
        while True:
            if (width >= len(left) or self._stable(left[-width - 1], inner[0])) and (
                width >= len(right) or self._stable(inner[-1], right[width])
            ):
                return left[:-width] + inner + right[width:]
            width *= 2
            inner = self._small(b"".join([tokens[t] for t in left[-width:]]) + b"".join([tokens[t] for t in right[:width]]))

    def _pair(self, a: int, b: int) -> list[int]:
        """The encoding of the bytes of two tokens."""
        known = self.pairs.get(a << 32 | b)
        if known is None:
            if len(self.pairs) > CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[a << 32 | b] = self._small(self.vocab.tokens[a] + self.vocab.tokens[b])
        return known

    def _stable(self, a: int, b: int) -> bool:
        inner = self._pair(a, b)
        return len(inner) == 2 and inner[0] == a

    def _small(self, data: bytes) -> list[int]:
        if len(data) > SCANNED_BYTES:
            return self._merged_by_heap(data)
        known = self.small.get(data)
        if known is None:
            if len(self.small) > CACHED_PAIRS:
                self.small.clear()
            known = self.small[data] = self._merged_by_scan(data)
        return known

    def _merged_by_scan(self, data: bytes) -> list[int]:
        """Merge the least rank, leftmost first, until no neighbours form a token."""
        ranks = self.vocab.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        costs = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best = min((c for c in costs if c is not None), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            at = costs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del costs[at]
            if at < len(costs):
                costs[at] = ranks.get(parts[at] + parts[at + 1])
            if at:
                costs[at - 1] = ranks.get(parts[at - 1] + parts[at])

    def _merged_by_heap(self, data: bytes) -> list[int]:
        """The same merges for a long window, in n log n."""
        ranks, n = self.vocab.ranks, len(data)
        end = list(range(1, n + 1))  # end of the part that starts here; 0 if none does
        before = list(range(-1, n))
        heap: list[tuple[int, int, int]] = []

        def offer(start: int) -> None:
            middle = end[start]
            if middle < n:
                rank = ranks.get(data[start : end[middle]])
                if rank is not None:
                    heapq.heappush(heap, (rank, start, end[middle]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, start, stop = heapq.heappop(heap)
            middle = end[start]
            if not middle or middle >= n or end[middle] != stop:
                continue  # one of the two parts has changed since
            end[start], end[middle] = stop, 0
            if stop < n:
                before[stop] = start
            offer(start)
            if start:
                offer(before[start])
        out, at = [], 0
        while at < n:
            out.append(ranks[data[at : end[at]]])
            at = end[at]
        return out


def decode_ids(ids: Sequence[int], vocab: Vocabulary, leaf: int = 4096) -> bytes:
    """Bytes of ``ids``, by halves."""
    if len(ids) <= leaf:
        return b"".join(map(vocab.tokens.__getitem__, ids))
    half = len(ids) // 2
    return decode_ids(ids[:half], vocab, leaf) + decode_ids(ids[half:], vocab, leaf)


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, leaf: int = LEAF_BYTES, decode: bool = False) -> DataFrame:
    """(key, ids array<int>[, decoded binary]) for every row of ``docs``, by the ranks in ``path``; ``decode`` adds the decoded ids."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        encoder = TreeEncoder(vocab, leaf)
        for batch in batches:
            for i, j, texts in byte_slices(batch.column(1), SLICE_BYTES):
                coded = [encoder.text(t.decode()) for t in texts]
                ends = np.cumsum([0] + [len(c) // 4 for c in coded])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), np.int32)))
                columns = [batch.column(0)[i:j], ids]
                if decode:
                    columns.append(pa.array([decode_ids(array("I", c), vocab) for c in coded], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["key", "ids", "decoded"][: len(columns)])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>{', decoded binary' if decode else ''}")


def decode_texts(coded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, ids, decoded binary) for every row of ``coded``; null ids count as none."""
    kind = coded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            rows = batch.column(1)
            lengths = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
            for i, j in slices(lengths.tolist(), SLICE_BYTES):
                part = rows[i:j]
                decoded = [decode_ids(r or [], vocab) for r in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], part, pa.array(decoded, pa.binary())], names=["key", "ids", "decoded"])

    return coded.select(key, ids).mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded binary")

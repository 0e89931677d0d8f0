"""Packing of tokenised documents into sequences by shortest-pack-first over the length histogram.

A document's ids (those that the tokenizers library gives for its text without special tokens
around it, in which a literal ``<|endoftext|>`` is one id, then one end id) are cut into pieces of ``size`` ids and
one rest. The rests' lengths form a histogram of at most ``size`` bins. Lengths are placed
longest first; a length goes to the open patterns (kinds of packs) with the fewest ids so far,
which splits a pattern's count where only some of its packs get the new piece. The patterns,
not the documents, are all that this step sees, so its cost does not depend on the table.

The patterns go back to the pieces by rank: pattern p holds pieces number a to b of a length,
so a piece's rank among those of its length names its sequence and its place there. Ranks come
from counts for each written part and length; no length meets in one task.

A sequence is padded to ``size`` unless its ids number a power of two.

Nulls: a null text counts as empty and gives one piece, the end id. Repeated rows are packed
each for itself; an empty table gives no rows. Columns other than the key and the text are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motioncat.llm.bpe import library_encoder
from motioncat.llm.common import materialize, slices, texts_of

SIZE = 1024
END_ID = 0
SLICE_CHARS = 1_000_000


Pattern = tuple[tuple[int, int], ...]  # (length, times) from the start of a pack


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, Pattern]]:
    """(count, pattern) kinds of packs that hold ``histogram[n]`` pieces of every length n <= ``size``.

    Pieces that fit in no open pack are stacked on each other. A length adds two kinds of packs
    and splits one, at most, so there are no more than about three for each length.
    """
    open_packs: dict[int, list[tuple[int, Pattern]]] = {}
    fills: list[int] = []  # heap of the fills that have open packs
    done: list[tuple[int, Pattern]] = []

    def put(count: int, pattern: Pattern) -> None:
        fill = sum(n * times for n, times in pattern)
        if fill == size:
            done.append((count, pattern))
            return
        if not open_packs.get(fill):
            heapq.heappush(fills, fill)
        open_packs.setdefault(fill, []).append((count, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and fills and fills[0] + length <= size:
            packs = open_packs[fills[0]]
            count, pattern = packs.pop()
            used = min(count, left)
            if count > used:
                packs.append((count - used, pattern))
            if not packs:
                heapq.heappop(fills)
            left -= used
            if pattern[-1][0] == length:
                put(used, (*pattern[:-1], (length, pattern[-1][1] + 1)))
            else:
                put(used, (*pattern, (length, 1)))
        stacked = size // length
        if left // stacked:
            put(left // stacked, ((length, stacked),))
        if left % stacked:
            put(1, ((length, left % stacked),))
    return done + [p for packs in open_packs.values() for p in packs]


def cut_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces (key, start, length, ids_crc32, doc_tokens, part, nth[, ids]) of every document.

    ``nth`` numbers the pieces of one length within the task ``part``; it is of use once the
    rows are written. ``with_ids`` adds the ids as little-endian 32-bit bytes.
    """
    kind = docs.schema[key].dataType.simpleString()
    extra = ", ids binary" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, part = library_encoder(path, added=True), Counter(), TaskContext.get().partitionId()
        end = np.array([END_ID], "<u4")
        for batch in batches:
            texts = texts_of(batch.column(1))
            for i, j in slices(map(len, texts), SLICE_CHARS):
                row, start, length, crc, tokens, nth, ids = [], [], [], [], [], [], []
                for k in range(i, j):
                    all_ids = np.concatenate([encode(texts[k]), end])
                    raw, n = all_ids.tobytes(), len(all_ids)
                    for at in range(0, n, size):
                        held = min(size, n - at)
                        piece = raw[4 * at : 4 * (at + held)]
                        row.append(k)
                        start.append(at)
                        length.append(held)
                        crc.append(zlib.crc32(piece))
                        tokens.append(n)
                        nth.append(seen[held])
                        seen[held] += 1
                        ids.append(piece)
                columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, length, crc, tokens, [part] * len(row), nth))]
                names = ["key", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, part long, nth long{extra}"
    return docs.select(key, text).mapInArrow(run, schema)


def place_pieces(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` (written, with part, nth and length) with (sequence_id, offset)."""
    counts = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= size rows
    slots, first = [], 0
    taken: Counter[int] = Counter()
    for count, pattern in shortest_pack_first(histogram, size):
        offset = 0
        for length, times in pattern:
            slots.append((length, taken[length], taken[length] + count * times, times, first, offset))
            taken[length] += count * times
            offset += length * times
        first += count
    # A pattern has at most 44 different lengths of 1024, as they sum to no more: some 130,000 rows at the very most.
    table = pieces.sparkSession.createDataFrame(slots, "slot_length long, low long, high long, times long, first long, base long")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    inside = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    placed = ranked.join(F.broadcast(table), inside)
    nth = F.col("rank") - F.col("low")
    return placed.select(
        *[c for c in pieces.columns if c not in ("part", "nth")],
        (F.col("first") + F.floor(nth / F.col("times"))).cast("long").alias("sequence_id"),
        (F.col("base") + nth % F.col("times") * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: (key, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset)."""
    pieces = materialize(cut_documents(docs, key, text, size, path, with_ids), "pieces")
    return place_pieces(pieces, size)

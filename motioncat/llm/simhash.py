"""Near-duplicates by SimHash with a Gray-order hierarchical index.

Fingerprints. A text is lower-cased (A-Z), cut into words at ASCII white space, and every
three neighbouring words form a shingle (fewer words: the whole sequence is one; none: the
fingerprint is zero). A bit of the fingerprint is set if it is set in over half of the
shingles' XXH64 hashes.

Index. Equal fingerprints are combined first. Two fingerprints that differ in at most d bits
agree in one of d + 1 blocks of bits, so each fingerprint is filed under each of its blocks,
with its bits rotated so that the block comes first. Under a block the rotated fingerprints
are sorted by Gray rank, in which neighbours differ in few bits. Runs of 16 make leaves, 16
leaves a node, and so on; a node keeps the bits on which all below it agree (a mask and the
masked pattern). A pair of nodes is dropped, with all pairs below it, once the bits that both
have fixed differ in more than d places; otherwise its children are paired, and the
differences found so far can only grow. What is left at the leaves is compared bit by bit.

A block that many fingerprints share is cut into parts and every two parts are compared in a
task of their own. Tasks return the links' spanning stars, never all pairs.

Nulls: a null text counts as empty. A document with a null id gets a fingerprint and joins
its group, but is never a group's smallest id; a group of null ids alone has a null one.
Repeated rows each keep their row. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motioncat.llm import jaccard
from motioncat.llm.common import component_of, links_to_labels, materialize, texts_of

SHINGLE = 3
SEED = 42
DIFFERENT_BITS = 2
FANOUT = 16
PART_ROWS = 4096
PAIRS_AT_ONCE = 1 << 12


def fingerprint(text: str, shingle: int = SHINGLE, at_once: int = 1 << 16) -> int:
    """SimHash of a text as a signed 64-bit integer."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams: Iterator[bytes] = iter([b" ".join(words)])
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, at_once):
        ones += np.unpackbits(hashes[i : i + at_once].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fingerprint long) for every row of ``docs``."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([fingerprint(t, shingle) for t in texts_of(batch.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), prints], names=["key", "fingerprint"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fingerprint long")


def gray_rank(bits: Column) -> Column:
    """Place of a 64-bit word in the Gray order: each bit becomes the parity of those from the top to it."""
    for step in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, step))
    return bits


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class GrayTree:
    """Masks and patterns over fingerprints that are sorted by Gray rank."""

    def __init__(self, prints: np.ndarray, fanout: int = FANOUT) -> None:
        self.prints, self.fanout = prints.view(np.uint64), fanout
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # (mask, pattern), leaves first
        both = either = self.prints
        while len(both) > 1:
            starts = np.arange(0, len(both), fanout)
            both, either = np.bitwise_and.reduceat(both, starts), np.bitwise_or.reduceat(either, starts)
            mask = ~(both ^ either)
            self.levels.append((mask, both & mask))

    def _children(self, a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs a <= b of the next lower level under the pairs of nodes (a, b)."""
        step = np.arange(self.fanout)
        left = (a[:, None] * self.fanout + step)[:, :, None]
        right = (b[:, None] * self.fanout + step)[:, None, :]
        left, right = np.broadcast_arrays(left, right)
        keep = (left <= right) & (right < size)
        return left[keep], right[keep]

    def labels(self, bits: int) -> np.ndarray:
        """Component of every fingerprint, over links of at most ``bits`` differing bits."""
        n = len(self.prints)
        label = np.arange(n)
        if n < 2:
            return label
        work = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while work:
            level, a, b = work.pop()
            mask, pattern = self.levels[level]
            near = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= bits
            if level == 0:
                near &= ~self._settled(label, a, b)
            a, b = a[near], b[near]
            if len(a) > PAIRS_AT_ONCE:
                work += [(level, a[i : i + PAIRS_AT_ONCE], b[i : i + PAIRS_AT_ONCE]) for i in range(0, len(a), PAIRS_AT_ONCE)]
            elif level and len(a):
                work.append((level - 1, *self._children(a, b, len(self.levels[level - 1][0]))))
            elif len(a):
                a, b = self._children(a, b, n)
                near = (a < b) & (_differ(self.prints[a], self.prints[b]) <= bits)
                label = links_to_labels(n, np.concatenate([np.arange(n), a[near]]), np.concatenate([label, b[near]]))
        return label

    def _settled(self, label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Are all fingerprints below both leaves in one component already?"""
        starts = np.arange(0, len(label), self.fanout)
        low, high = np.minimum.reduceat(label, starts), np.maximum.reduceat(label, starts)
        return (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])


def _groups(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[np.ndarray]]:
    """Sorted rows in chunks that never split a group; the first ``columns`` columns name the group."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(rows[0]):
            continue
        rest = rows if rest is None else [np.concatenate(p) for p in zip(rest, rows)]
        same = np.ones(len(rest[0]), bool)
        for c in rest[:columns]:
            same &= c == c[-1]
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield [c[:cut] for c in rest]
            rest = [c[cut:] for c in rest]
    if rest is not None:
        yield rest


def near_fingerprints(prints: DataFrame, bits: int = DIFFERENT_BITS, part_rows: int = PART_ROWS) -> DataFrame:
    """Links (a, b) that connect all distinct ``fingerprint`` values at most ``bits`` bits apart."""
    blocks = bits + 1
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    filed = []
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        turned = F.col("fingerprint") if low == 0 else F.shiftleft("fingerprint", low).bitwiseOR(F.shiftrightunsigned("fingerprint", 64 - low))
        filed.append(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(turned, 64 - (high - low)).alias("bits"), gray_rank(turned).alias("gray")))
    rows = prints.select("fingerprint", F.explode(F.array(*filed)).alias("f")).select("f.*", "fingerprint")
    shared = rows.groupBy("block", "bits").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"), F.count("*").alias("n")).filter("n > 1").drop("n")
    placed = rows.join(shared, ["block", "bits"]).withColumn("own", F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int"))
    others = F.expr("CASE WHEN parts = 1 THEN array(0) ELSE filter(sequence(0, parts - 1), p -> p <> own) END")
    spread = placed.withColumn("other", F.explode(others)).select(
        "block", "bits", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "gray", "fingerprint"
    )
    name = ["block", "bits", "p", "q"]
    tasks = spread.repartition(*name).sortWithinPartitions(*name, "gray")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *names, _, found in _groups(batches, len(name)):
            change = np.zeros(len(found), bool)
            for c in names:
                change[1:] |= c[1:] != c[:-1]
            starts = np.concatenate([[0], np.nonzero(change)[0]])
            ends = np.append(starts[1:], len(found))
            small = ends - starts <= FANOUT
            a, b = [], []
            group = np.repeat(np.where(small, np.arange(len(starts)), -1), ends - starts)
            for step in range(1, FANOUT):  # groups of one leaf, all at once
                same = (group[step:] == group[:-step]) & (group[step:] >= 0)
                i = np.nonzero(same)[0]
                i = i[_differ(found[i], found[i + step]) <= bits]
                a.append(found[i])
                b.append(found[i + step])
            for s, e in zip(starts[~small], ends[~small]):
                own = found[s:e]
                label = GrayTree(own).labels(bits)
                linked = np.nonzero(label != np.arange(e - s))[0]
                a.append(own[linked])
                b.append(own[label[linked]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return tasks.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = DIFFERENT_BITS, shingle: int = SHINGLE) -> DataFrame:
    """(key, fingerprint long, component_id) for every row: the smallest key reachable over links."""
    marked = materialize(fingerprints(docs, key, text, shingle), "fingerprints")
    distinct = materialize(marked.groupBy("fingerprint").agg(F.min(key).alias("_first")), "distinct")
    links = near_fingerprints(distinct.select("fingerprint"), bits)
    grouped = component_of(distinct, "fingerprint", links)
    least = grouped.groupBy("component").agg(F.min("_first").alias("component_id"))
    found = grouped.select("fingerprint", "component").join(least, "component").drop("component")
    return marked.join(found, "fingerprint").select(key, "fingerprint", "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = jaccard.SHINGLE, similarity: float = jaccard.SIMILARITY) -> DataFrame:
    """One row of each group of near-duplicates stays: one with the group's smallest key; of its rows with a null key one stays too.

    Texts are brought together by their fingerprints over ``shingle`` words (``near_duplicates``) and by bands
    of MinHash values, which also find copies whose fingerprints are further apart (``jaccard``). The exact check
    follows: groups are those over pairs of texts whose shingle sets have a Jaccard similarity of ``similarity`` or more.
    """
    sketched = materialize(jaccard.with_sketches(docs, text, "_near_print", "_near_bands", shingle), "sketches")
    sets = sketched.select(F.col("_near_print").alias("print"), F.col("_near_bands").alias("bands"), F.col(key).alias("_first"))
    near = near_duplicates(sketched.select("_near_print", text), "_near_print", text, shingle=shingle)
    linked = near.filter("_near_print <> component_id").select(F.col("_near_print").alias("a"), F.col("component_id").alias("b")).distinct()
    coarse = materialize(jaccard.coarse_groups(sets, linked), "coarse")
    # Joined by shuffle at every size: the prints grow with the documents, so they are never broadcast. A partition's
    # prints are hashed, as they are few bytes each and a print comes once; whole texts are not sorted.
    own = coarse.select(F.col("print").alias("_near_print"), "coarse").withColumnRenamed("coarse", "_near_coarse")
    marked = materialize(sketched.drop("_near_bands").join(own.hint("shuffle_hash"), "_near_print", "left"), "marked")
    met = marked.filter(F.col("_near_coarse").isNotNull())
    texts = met.groupBy(F.col("_near_coarse").alias("coarse"), F.col("_near_print").alias("print")).agg(F.first(text).alias("text"))
    links = materialize(jaccard.near_sets(materialize(texts, "texts"), similarity, shingle), "near")
    counts = sets.join(coarse.select("print"), "print").groupBy("print", "_first").agg(F.count("*").alias("_rows"))
    grouped = component_of(counts, "print", links)
    least = grouped.groupBy("component", F.col("_first").isNull().alias("_bare")).agg(F.min(F.struct("_first", "print", "_rows")).alias("_least")).select("_least.*")
    firsts = materialize(least.select(F.col("print").alias("_near_print"), F.col("_first").alias("_near_first"), F.col("_rows").alias("_near_rows")), "firsts")
    kept = met.join(firsts.hint("shuffle_hash"), "_near_print").filter(F.col(key).eqNullSafe(F.col("_near_first")))
    out = marked.filter(F.col("_near_coarse").isNull()).select(*docs.columns)
    out = out.unionByName(kept.filter("_near_rows = 1").select(*docs.columns))
    return out.unionByName(kept.filter("_near_rows > 1").dropDuplicates(["_near_print", key]).select(*docs.columns))

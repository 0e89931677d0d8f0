"""Importance resampling towards a target distribution, on hashed runs of one and two words.

Words are runs of digits, a-z (A-Z lowered) and code points beyond ASCII. A feature's bucket is
the CRC-32 of its bytes modulo ``buckets``. CRCs are taken of a slice's distinct features
together: features of equal length form a two-dimensional array of bytes, all whose CRCs are
updated column by column; the results are scattered back to the features.

One pass over source and target counts the buckets: a task sums its own and hands on one row per
bucket. The gain of a bucket is the scaled logarithm of how much more frequent it is in the
target, with one added to every count. A second pass gives every document the floored mean of
its features' gains, and a score, the weight plus Gumbel noise from the hash of its key: the
highest scores are a sample without replacement in proportion to the importance weights. Ranks
come from a sort over range partitions, never from one task.

Nulls: a null text has no words. A document without features has weight 0. A null key takes its
noise from the empty string in place of its decimals and comes last among equal scores. Ties
of score go to the smaller key; rows that repeat a key count each for itself, in an order fixed
when the scores are written. Documents below ``least_words`` words have a score but no rank. An
empty source gives no rows; an empty target has no counts. Other columns are dropped, so their
names do not matter. Very long texts and words are whole features: nothing is cut.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motioncat.llm.common import byte_slices, materialize
from motioncat.operators.ordered import running

BUCKETS = 10_000
SCALE = 1000
SLICE_BYTES = 4_000_000
# Bytes outside words become spaces, A-Z become a-z.
TO_WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))
CRC_POLYNOMIAL = 0xEDB88320


def crc_table() -> np.ndarray:
    """What each byte adds to a CRC: eight divisions by the polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(CRC_POLYNOMIAL), table >> 1)
    return table


CRC_STEP = crc_table()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


def crc_columns(features: list[bytes]) -> np.ndarray:
    """CRC-32 of every feature, by matrices of features of equal length."""
    lengths = np.fromiter(map(len, features), np.int64, len(features))
    order = np.argsort(lengths, kind="stable")
    flat = np.frombuffer(b"".join([features[i] for i in order.tolist()]), np.uint8)
    out = np.empty(len(features), np.uint32)
    sizes, firsts, counts = np.unique(lengths[order], return_index=True, return_counts=True)
    at = 0
    for size, first, count in zip(sizes.tolist(), firsts.tolist(), counts.tolist()):
        columns = np.ascontiguousarray(flat[at : at + size * count].reshape(count, size).T)
        crc = np.full(count, 0xFFFFFFFF, np.uint32)
        for column in columns:
            crc = CRC_STEP[(crc ^ column) & 0xFF] ^ (crc >> 8)
        out[order[first : first + count]] = ~crc
        at += size * count
    return out


class Slice:
    """Features of some texts: the distinct ones' buckets, and which of them every text holds."""

    def __init__(self, texts: Iterable[bytes], buckets: int) -> None:
        found = [words_of(t) for t in texts]
        self.n_words = np.fromiter(map(len, found), np.int64, len(found))
        words = [w for each in found for w in each]
        codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
        single = list(codes)
        coded = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
        row = np.repeat(np.arange(len(found)), self.n_words)
        inside = row[1:] == row[:-1]
        pairs, which = np.unique((coded[:-1] << 32 | coded[1:])[inside], return_inverse=True)
        double = [single[p >> 32] + b" " + single[p & 0xFFFFFFFF] for p in pairs.tolist()]
        self.bucket = (crc_columns(single + double) % buckets).astype(np.int64)
        self.feature = np.concatenate([coded, which + len(single)])
        self.row = np.concatenate([row, row[1:][inside]])

    def counts(self, buckets: int) -> np.ndarray:
        return np.bincount(self.bucket[self.feature], minlength=buckets)

    def sums(self, gains: np.ndarray) -> np.ndarray:
        """Sum of the gains of every text's features, in whole numbers."""
        total = np.zeros(len(self.n_words), np.int64)
        np.add.at(total, self.row, gains[self.bucket[self.feature]])
        return total


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How often the features of all ``texts`` fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, part in byte_slices(batch.column(0), SLICE_BYTES):
                total += Slice(part, buckets).counts(buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in texts.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # <= buckets rows
        out[bucket] = n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored, scaled logarithm of target share over source share of every bucket."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(SCALE * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(key: object, seed: int) -> int:
    """Scaled Gumbel noise from the decimal key."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def score_documents(docs: DataFrame, gains: np.ndarray, key: str = "doc_id", text: str = "text", seed: int = 7) -> DataFrame:
    """(key, n_words, n_features, weight, score, part, nth) of every row; the last two number the rows once they are written."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, j, texts in byte_slices(batch.column(1), SLICE_BYTES):
                found = Slice(texts, len(gains))
                n_features = found.n_words + np.maximum(found.n_words - 1, 0)
                weight = found.sums(gains) // np.maximum(n_features, 1)
                keys = batch.column(0)[i:j]
                score = weight + np.array([noise(k, seed) for k in keys.to_pylist()], np.int64)
                numbers = (found.n_words, n_features, weight, score, np.full(j - i, part), np.arange(nth, nth + j - i))
                nth += j - i
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, pa.int64()) for c in numbers)], names=["key", "n_words", "n_features", "weight", "score", "part", "nth"])

    schema = f"`{key}` {kind}, n_words long, n_features long, weight long, score long, part long, nth long"
    return docs.select(key, text).mapInArrow(run, schema)


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS,
) -> DataFrame:
    """(key, n_features, weight, score, rank) of every row; ``rank`` 1, 2, ... of the drawn ``percent`` of the documents long enough, else null."""
    gains = bucket_gains(bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets))
    scored = materialize(score_documents(docs, gains, key, text, seed), "scores").withColumnRenamed(key, "key")
    drawn = percent * scored.filter(F.col("n_words") >= least_words).count() // 100
    ordered = scored.withColumns({"late": F.col("n_words") < least_words, "descending": -F.col("score"), "no_key": F.col("key").isNull()})
    ranked = running(ordered, [], ["late", "descending", "no_key", "key", "part", "nth"], {"place": F.lit(1)})
    rank = F.when(~F.col("late") & (F.col("place") <= drawn), F.col("place").cast("long"))
    return ranked.select(F.col("key").alias(key), "n_features", "weight", "score", rank.alias("rank"))

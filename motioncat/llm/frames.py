"""Fill-in-middle over texts stored as seekable compressed frames.

Store. A text is cut at code points into frames of some 32 kB; every frame is compressed on its
own (zstandard) and keeps the number of units, code points and bytes before it. A unit is a run
of letters A-Z and a-z or any other single code point; a run that crosses a frame's end counts
where it starts, and ``joined`` says that a frame starts inside one.

Selection. A cut after k units lies in the frame whose counts enclose k, the only one that is
decompressed to find its byte. Sections between cuts are streamed frame by frame in order, into
the digest and into the frames of the output, so that of a long document one frame at a time is
held as plain text.

Restoring reads only output and form: the marks are found in one stream over the output's
frames, the sections are streamed back in their first order. No mark stands in the text of a
form other than plain, and two marks cannot overlap, so every mark found is a boundary.

Nulls: a null text counts as empty; the empty text has no units, no frames and the form plain. A
null key draws its cuts from the empty string in place of its decimals. Repeated rows and rows
that repeat a key each get their own result. Other columns are dropped, so their names do not
matter. An empty table gives no rows. A very long text is one row of work, one frame at a time.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from motioncat.llm.common import byte_slices, slices

FRAME_BYTES = 32_768
SLICE_BYTES = 4_000_000
LEVEL = 1
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
FRAMES = "array<struct<units:long,chars:long,bytes:long,joined:boolean,data:binary>>"
FRAME_TYPE = pa.list_(pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("bytes", pa.int64()), ("joined", pa.bool_()), ("data", pa.binary())]))


class Place(NamedTuple):
    """A point in a text."""

    chars: int
    byte: int


def unit_starts(data: bytes, joined: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes start a code point, and which a unit; ``joined`` if a letter stands before ``data``."""
    raw = np.frombuffer(data, np.uint8)
    points = raw & 0xC0 != 0x80
    letters = (raw | 0x20) - np.uint8(0x61) < 26
    after_letter = np.concatenate([[joined], letters[:-1]])
    return points, points & ~(letters & after_letter)


@lru_cache(maxsize=1)
def codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """One compressor and decompressor per process; their working memory is larger than most texts."""
    return zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()


class Frames:
    """The frames of one text, to be appended to and read from any byte on."""

    def __init__(self, rows: Iterable[dict] = (), size: int = FRAME_BYTES) -> None:
        self.rows, self.size, self.rest = list(rows), size, b""
        self.units = self.chars = self.bytes = 0
        self.joined = False

    def append(self, data: bytes) -> None:
        self.rest += data
        at, end = 0, len(self.rest)
        while end - at >= self.size + 4:
            cut = at + self.size
            while self.rest[cut] & 0xC0 == 0x80:
                cut -= 1
            self._add(self.rest[at:cut])
            at = cut
        self.rest = self.rest[at:]

    def close(self) -> Frames:
        if self.rest:
            self._add(self.rest)
            self.rest = b""
        return self

    def _add(self, data: bytes) -> None:
        points, units = unit_starts(data, self.joined)
        self.rows.append({"units": self.units, "chars": self.chars, "bytes": self.bytes, "joined": self.joined, "data": codec()[0].compress(data)})
        self.units += int(np.count_nonzero(units))
        self.chars += int(np.count_nonzero(points))
        self.bytes += len(data)
        self.joined = data[-1:].isalpha()

    def plain(self, k: int) -> bytes:
        return codec()[1].decompress(self.rows[k]["data"])

    def place(self, units: int, total: Place, n: int) -> Place:
        """Where the first ``units`` of all ``n`` end, which is where the next one starts."""
        if units >= n:
            return total
        k = bisect_right(self.rows, units, key=lambda r: r["units"]) - 1
        row, data = self.rows[k], self.plain(k)
        points, starts = unit_starts(data, row["joined"])
        at = int(np.flatnonzero(starts)[units - row["units"]])
        return Place(row["chars"] + int(np.count_nonzero(points[:at])), row["bytes"] + at)

    def stream(self, start: int, end: int) -> Iterator[bytes]:
        """The bytes from ``start`` to ``end``, frame by frame."""
        if start >= end:
            return
        for k in range(bisect_right(self.rows, start, key=lambda r: r["bytes"]) - 1, len(self.rows)):
            first = self.rows[k]["bytes"]
            if first >= end:
                return
            data = self.plain(k)
            yield data[max(0, start - first) : end - first]


def has_marks(data: bytes) -> bool:
    return any(m in data for m in MARKS)


def find_marks(pieces: Iterable[bytes]) -> dict[bytes, int]:
    """Byte at which each mark stands, in one pass over a stream."""
    found: dict[bytes, int] = {}
    tail, before = b"", 0
    for piece in pieces:
        seen = tail + piece
        for mark in MARKS:
            at = seen.find(mark)
            if at >= 0:
                found.setdefault(mark, before - len(tail) + at)
        tail, before = seen[-2:], before + len(piece)
    return found


def draws(key: object, seed: int) -> list[int]:
    """Four numbers of 32 bits from the decimal key."""
    digits = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in (0, 8, 16, 24)]


def sections(form: str, a: int, b: int, size: int) -> list[tuple[bytes, int, int]]:
    """What the output is made of, in order: a mark and the bytes of the text that follow it."""
    prefix, middle, suffix = (PREFIX, 0, a), (MIDDLE, a, b), (SUFFIX, b, size)
    return [prefix, suffix, middle] if form == "psm" else [suffix, prefix, middle]


def _write(into: Frames, digest: hashlib._Hash, pieces: Iterable[bytes]) -> None:
    for piece in pieces:
        digest.update(piece)
        into.append(piece)


def store_frames(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = FRAME_BYTES) -> DataFrame:
    """(key, n, chars, bytes, marked, frames) for every row: totals, whether a mark stands in the text, and its frames."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in byte_slices(batch.column(1), SLICE_BYTES):
                held = []
                for data in texts:
                    frames = Frames(size=size)
                    for at in range(0, len(data), size):
                        frames.append(data[at : at + size])
                    held.append(frames.close())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[i:j],
                        *(pa.array([getattr(f, name) for f in held], pa.int64()) for name in ("units", "chars", "bytes")),
                        pa.array([has_marks(data) for data in texts], pa.bool_()),
                        pa.array([f.rows for f in held], FRAME_TYPE),
                    ],
                    names=["key", "n", "chars", "bytes", "marked", "frames"],
                )

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n long, chars long, bytes long, marked boolean, frames {FRAMES}")


def _held(column: pa.Array) -> Iterator[tuple[int, int, list[list[dict]]]]:
    """Slices of a column of frames, by their compressed size."""
    ends = np.asarray(column.offsets)
    data = column.values.field("data")
    sizes = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.binary_length(data), 0).to_numpy(zero_copy_only=False))])
    totals = sizes[ends[1:] - ends[0]] - sizes[ends[:-1] - ends[0]] if len(sizes) > ends[-1] - ends[0] else np.zeros(len(column))
    for i, j in slices(totals.tolist(), SLICE_BYTES // 4):
        yield i, j, [rows or [] for rows in column[i:j].to_pylist()]


def fill_in_middle(stored: DataFrame, key: str = "doc_id", seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output_sha256, bytes, frames of the output) of what ``store_frames`` returned.

    Of a document with n units, the prefix ends after the smaller of two drawn numbers of units
    and the middle after the larger. The form is plain (the text itself) for an empty text, one
    that holds a mark, and where the third draw's last two digits are ``plain_from`` or more; else spm
    where those of the fourth are below ``spm_below``, and psm for the rest.
    """
    kind = stored.schema[key].dataType.simpleString()

    def one(name: object, n: int, total: Place, marked: bool, rows: list[dict]) -> tuple:
        text, output, digest = Frames(rows), Frames(), hashlib.sha256()
        h1, h2, h3, h4 = draws(name, seed)
        if n == 0 or marked or h3 % 100 >= plain_from:
            for piece in text.stream(0, total.byte):
                digest.update(piece)
            return n, "plain", None, None, digest.hexdigest(), total.byte, rows
        form = "spm" if h4 % 100 < spm_below else "psm"
        a, b = (text.place(k, total, n) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
        for mark, start, end in sections(form, a.byte, b.byte, total.byte):
            _write(output, digest, [mark])
            _write(output, digest, text.stream(start, end))
        output.close()
        return n, form, a.chars, b.chars - a.chars, digest.hexdigest(), output.bytes, output.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, n, chars, size, marked = (batch.column(c).to_pylist() for c in range(5))
            for i, j, held in _held(batch.column(5)):
                out = [one(names[k], n[k], Place(chars[k], size[k]), marked[k], held[k - i]) for k in range(i, j)]
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), FRAME_TYPE)
                columns = [pa.array(values, t) for values, t in zip(zip(*out), types)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], *columns], names=["key", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "bytes", "frames"]
                )

    schema = f"`{key}` {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, bytes long, frames {FRAMES}"
    return stored.select(key, "n", "chars", "bytes", "marked", "frames").mapInArrow(run, schema)


def restored_stream(form: str, frames: Frames, size: int) -> Iterator[bytes]:
    """The text behind an output, section by section."""
    if form == "plain":
        yield from frames.stream(0, size)
        return
    marks = find_marks(frames.stream(0, size))
    starts = sorted(marks.values())
    ends = dict(zip(starts, [*starts[1:], size]))
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from frames.stream(marks[mark] + len(mark), ends[marks[mark]])


def restore_texts(moved: DataFrame, keep: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """(*keep, restored_sha256[, restored]) from the form, size and frames of every output of ``fill_in_middle``.

    With ``with_text`` the text itself is made as well, and the ``output`` as a plain string.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in moved.select(*keep).schema)
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form, size = (batch.column(width + c).to_pylist() for c in range(2))
            for i, j, held in _held(batch.column(width + 2)):
                digests, texts, outputs = [], [], []
                for k in range(i, j):
                    frames, digest = Frames(held[k - i]), hashlib.sha256()
                    pieces = []
                    for piece in restored_stream(form[k], frames, size[k]):
                        digest.update(piece)
                        if with_text:
                            pieces.append(piece)
                    digests.append(digest.hexdigest())
                    if with_text:
                        texts.append(b"".join(pieces))
                        outputs.append(b"".join(frames.stream(0, size[k])))
                columns = [*(batch.column(c)[i:j] for c in range(width)), pa.array(digests, pa.string())]
                names = [*(f"c{c}" for c in range(width)), "restored_sha256"]
                if with_text:
                    columns += [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(outputs, pa.binary()).cast(pa.string())]
                    names += ["restored", "output"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"{fields}, restored_sha256 string{', restored string, output string' if with_text else ''}"
    return moved.select(*keep, "form", "bytes", "frames").mapInArrow(run, schema)

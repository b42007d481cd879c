"""Fill-in-the-middle over content-defined chunks whose counts are remembered.

A rolling hash of the last 32 bytes cuts a text into chunks, so texts that share a
passage share its chunks whatever stands before it. A chunk is counted once: its line
ends and code points are kept under its bytes, and a later chunk with the same bytes takes
them from there. Adding up the counts of a document's chunks tells in which chunk a cut
lies; only there the kept line ends are looked at. A document is read once and nothing is
shuffled.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import only
from tessera.llm.words import slices

# The marks.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)

#: A chunk ends where the hash's highest bits are zero, every 512 bytes on average, but not
#: within the hash's reach of another such place; none is longer than LONGEST.
REACH = 32
MEAN_BITS = 9
LONGEST = 8192
#: Bytes of chunks that a task keeps; the chunk used longest ago goes first.
CACHE_BYTES = 48 << 20
_ENTRY_BYTES = 400

_GEAR = np.random.default_rng(20250613).integers(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)


def chunk_ends(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Ends of the chunks of all rows, in bytes; every row end is one.

    The hash of a place covers the 32 bytes up to it, so a place closer to its row's start
    is never an end and what a chunk is does not depend on the rows before.
    """
    h = _GEAR[data]
    span = 1
    while span < REACH:
        h[span:] = h[span:] + (h[:-span] << np.uint32(span)) if len(h) > span else h[span:]
        span *= 2
    # The highest bits have seen all 32 bytes; the lowest only the last one.
    cut = np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1
    cut = cut[np.diff(cut, prepend=-REACH) >= REACH]
    start = rows[np.searchsorted(rows, cut, "left") - 1] if len(cut) else cut
    cut = cut[cut - start >= REACH]
    ends = np.union1d(cut, rows[1:][rows[1:] > rows[:-1]])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    long = np.flatnonzero(ends - starts > LONGEST)
    extra = [np.arange(starts[i] + LONGEST, ends[i], LONGEST) for i in long]
    return np.union1d(ends, np.concatenate(extra)) if extra else ends


@dataclass(slots=True)
class Chunk:
    """What is remembered of a chunk: its counts, its line ends and its edges."""

    lines: int
    points: int
    line_ends: np.ndarray
    marked: bool
    head: bytes
    tail: bytes


def summary(chunk: bytes) -> Chunk:
    data = np.frombuffer(chunk, np.uint8)
    line_ends = (np.flatnonzero(data == 0x0A) + 1).astype(np.uint16 if len(data) < 65536 else np.int64)
    points = len(data) - int(np.count_nonzero((data & 0xC0) == 0x80))
    return Chunk(len(line_ends), points, line_ends, any(m in chunk for m in MARKS), chunk[:2], chunk[-2:])


class Cache:
    """Summaries by the chunk's bytes; the bytes themselves are compared, not a hash alone."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.kept: OrderedDict[bytes, Chunk] = OrderedDict()
        self.size, self.limit, self.hits, self.asked = 0, limit, 0, 0

    def get(self, chunk: bytes) -> Chunk:
        self.asked += 1
        found = self.kept.get(chunk)
        if found is not None:
            self.hits += 1
            self.kept.move_to_end(chunk)
            return found
        found = self.kept[chunk] = summary(chunk)
        self.size += len(chunk) + _ENTRY_BYTES + found.line_ends.nbytes
        while self.size > self.limit and len(self.kept) > 1:
            old, gone = self.kept.popitem(last=False)
            self.size -= len(old) + _ENTRY_BYTES + gone.line_ends.nbytes
        return found


class Text:
    """A document as its chunks, with running counts of bytes, line ends and code points."""

    def __init__(self, text: bytes, ends: list[int], cache: Cache):
        starts = [0, *ends[:-1]]
        self.text = text
        self.chunks = [cache.get(text[a:b]) for a, b in zip(starts, ends)]
        self.starts = np.array([*starts, len(text)] if ends else [0], np.int64)
        self.lines = np.cumsum([0, *(c.lines for c in self.chunks)])
        self.points = np.cumsum([0, *(c.points for c in self.chunks)])
        self.units = int(self.lines[-1]) + (bool(text) and not text.endswith(b"\n"))

    def marked(self) -> bool:
        """Whether a mark occurs: inside a chunk, or across the edges of neighbours."""
        if any(c.marked for c in self.chunks):
            return True
        for k in range(1, len(self.chunks)):
            a, b = self.chunks[k - 1].tail, self.chunks[k].head
            if len(a) + len(b) < 4:  # a chunk of one byte: look at the text around it
                at = int(self.starts[k])
                a, b = self.text[max(at - 2, 0) : at], self.text[at : at + 2]
            if any(m in a + b for m in MARKS):
                return True
        return False

    def cut(self, unit: int) -> tuple[int, int]:
        """The end of the first ``unit`` lines, in bytes and in code points."""
        if unit <= 0:
            return 0, 0
        if unit > self.lines[-1]:
            return len(self.text), int(self.points[-1])
        k = int(np.searchsorted(self.lines, unit, "left")) - 1
        chunk, at = self.chunks[k], int(self.starts[k])
        end = int(chunk.line_ends[unit - int(self.lines[k]) - 1])
        part = np.frombuffer(self.text, np.uint8, end, at) if end else np.zeros(0, np.uint8)
        return at + end, int(self.points[k]) + end - int(np.count_nonzero((part & 0xC0) == 0x80))


def assemble(prefix: bytes, middle: bytes, suffix: bytes, form: str) -> bytes:
    if form == "psm":
        return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))


def restore(output: bytes, form: str) -> bytes:
    """The text that ``assemble`` was given, from its output and form alone."""
    if form == "plain":
        return output
    head, middle = output[len(PREFIX) :].split(MIDDLE, 1)
    first, second = head.split(SUFFIX if form == "psm" else PREFIX, 1)
    prefix, suffix = (first, second) if form == "psm" else (second, first)
    return prefix + middle + suffix


_caches: list[Cache] = []


def _transform(percent: int, spm_percent: int):
    def run(batches):
        if not _caches:
            _caches.append(Cache())
        cache = _caches[0]
        for batch in batches:
            for part, data, rows in slices(batch, "text"):
                ends = chunk_ends(data, rows)
                bounds = np.searchsorted(ends, rows, "right")
                whole = data.tobytes()
                h = [part.column(k).to_pylist() for k in range(2, 6)]
                out = {"n": [], "form": [], "prefix_chars": [], "middle_chars": [], "output": []}
                for i, (a, b) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist())):
                    own = ends[bounds[i] : bounds[i + 1]] - a if b > a else ends[:0]
                    text = Text(whole[a:b], own.tolist(), cache)
                    n = text.units
                    form, before, between, made = "plain", None, None, text.text
                    if n and h[2][i] % 100 < percent and not text.marked():
                        form = "spm" if h[3][i] % 100 < spm_percent else "psm"
                        x, y = sorted((h[0][i] % (n + 1), h[1][i] % (n + 1)))
                        (p, before), (q, upto) = text.cut(x), text.cut(y)
                        between = upto - before
                        made = assemble(text.text[:p], text.text[p:q], text.text[q:], form)
                    for name, value in zip(out, (n, form, before, between, made)):
                        out[name].append(value)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(out["n"], pa.int64()),
                        pa.array(out["form"], pa.string()),
                        pa.array(out["prefix_chars"], pa.int64()),
                        pa.array(out["middle_chars"], pa.int64()),
                        pa.array(out["output"], pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return run


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """The first four 8-digit groups of the hex sha256 of ``seed:doc_id``, as numbers."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(docs: DataFrame, percent: int = 100, spm_percent: int = 50, seed: int = 7) -> DataFrame:
    """Per row of ``docs``: doc_id, n, form, prefix_chars, middle_chars and the output text.

    Lines, with their ends, are the units; two draws from the id's sha256 choose the cuts,
    a third whether the document is transformed (``percent``), a fourth whether suffix or
    prefix comes first. The form is ``plain`` (and the two counts null) for a null or
    empty text, one that holds a mark, and one not chosen. A null id draws as an empty one.
    Repeated rows give repeated rows, no documents none. Only doc_id and text are read;
    a text is held in memory with its chunks, about three times its size.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = only(docs, "doc_id", "text")
    rows = rows.select("doc_id", "text", *_draws(F.col("doc_id"), seed))
    schema = f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return rows.mapInArrow(_transform(percent, spm_percent), schema)


def restored(rows: DataFrame) -> DataFrame:
    """Columns of ``fill_in_middle`` and the text rebuilt from output and form, as ``restored``."""

    def run(batches):
        for batch in batches:
            forms = batch.column(batch.schema.get_field_index("form")).to_pylist()
            outputs = batch.column(batch.schema.get_field_index("output")).cast(pa.binary()).to_pylist()
            texts = pa.array([restore(o, f) for o, f in zip(outputs, forms)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "restored"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, restored string")

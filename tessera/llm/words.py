"""Words of whole text columns as numpy arrays, without a Python object per word.

A text column arrives in a task as an Arrow array. ``slices`` cuts it into runs of
rows of some megabytes; ``Words`` finds the words of a run in its UTF-8 bytes and
hashes them. Null counts as empty. A row longer than a run is a run of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

RUN_BYTES = 4 << 20
BLOCK_BYTES = 1 << 20
#: Bytes hashed at once: their sums stay in a core's cache.
HASH_BYTES = 1 << 16

#: Bytes between words: space and 0x09 to 0x0D.
_codes = np.arange(256)
SPACE_SEPARATED = ~((_codes == 0x20) | ((_codes >= 0x09) & (_codes <= 0x0D)))
#: After lower-casing: digits, a to z, and every byte of a character beyond ASCII.
ALPHANUMERIC = (
    ((_codes >= 0x30) & (_codes <= 0x39)) | ((_codes >= 0x61) & (_codes <= 0x7A)) | (_codes >= 0x80)
)
FOLD = np.where((_codes >= 0x41) & (_codes <= 0x5A), _codes + 32, _codes).astype(np.uint8)

_rng = np.random.default_rng(20250101)
_BYTE_WEIGHT = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to a block's size."""
    global _powers
    if _powers is None:
        tables = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            steps = np.full(BLOCK_BYTES + 1, base, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        _powers = tables[0], tables[1]
    return _powers


def _long_word(data: np.ndarray) -> np.uint64:
    """The weighted sum of a word longer than what is hashed at once, block by block."""
    forth, _ = _power_tables()
    total = 0
    for k in range(0, len(data), BLOCK_BYTES):
        piece = data[k : k + BLOCK_BYTES]
        own = int((_BYTE_WEIGHT[piece] * forth[: len(piece)]).sum(dtype=np.uint64))
        total += own * pow(_BASE, k, 2**64)
    return np.uint64(total % 2**64)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h + np.uint64((0x632BE59BD9B4E019 * (salt + 1)) % 2**64)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows, and where each row starts and the last one ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = RUN_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of at most ``limit`` bytes of text: rows, bytes, row bounds."""
    data, bounds = text_bytes(batch.column(batch.schema.get_field_index(text)))
    at, rows = 0, batch.num_rows
    while at < rows:
        to = int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1
        to = min(max(to, at + 1), rows)
        yield batch.slice(at, to - at), data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


class Words:
    """Words of consecutive rows: ``starts`` and ``ends`` in bytes, ``bounds`` in words by row."""

    def __init__(self, data: np.ndarray, rows: np.ndarray, alphabet: np.ndarray = SPACE_SEPARATED, fold: bool = True):
        self.data = FOLD[data] if fold else data
        inside = alphabet[self.data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = rows[1:] > rows[:-1]
        first[rows[:-1][full]] = inside[rows[:-1][full]]
        last[rows[1:][full] - 1] = inside[rows[1:][full] - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, rows)
        self.counts = np.diff(self.bounds)

    def __len__(self) -> int:
        return len(self.starts)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same in every task."""
        out = np.empty(len(self), np.uint64)
        forth, back = _power_tables()
        step, at = min(HASH_BYTES, len(forth) - 1), 0
        while at < len(self):
            origin = self.starts[at]
            to = int(np.searchsorted(self.ends, origin + step, "right"))
            if to <= at:
                out[at] = _long_word(self.data[origin : self.ends[at]])
                at += 1
                continue
            stop = self.ends[to - 1]
            sums = np.zeros(stop - origin + 1, np.uint64)
            np.cumsum(_BYTE_WEIGHT[self.data[origin:stop]] * forth[: stop - origin], out=sums[1:])
            begin = self.starts[at:to] - origin
            out[at:to] = (sums[self.ends[at:to] - origin] - sums[begin]) * back[begin]
            at = to
        return mix(out)

    def window_starts(self, width: int) -> np.ndarray:
        """Word numbers at which a window of ``width`` words of one row starts."""
        if len(self) == 0:
            return np.zeros(0, np.int64)
        room = np.repeat(self.bounds[1:], self.counts) - np.arange(len(self))
        return np.flatnonzero(room >= width)


def gram_hashes(words: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hash of the ``width`` words from each word on, regardless of row bounds."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    out, covered, power, span = None, 0, mix(words, salt), 1
    rest = width
    while rest:
        if rest & 1:
            if out is None:
                out = power[: len(words) - width + 1].copy()
            else:
                out = mix(out * np.uint64(0xD6E8FEB86659FD93) + power[covered : covered + len(words) - width + 1], salt)
            covered += span
        rest >>= 1
        if rest:
            power = mix(power[:-span] * np.uint64(0xD6E8FEB86659FD93) + power[span:], salt)
            span *= 2
    return out


def sliding(values: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """Smallest (or by ``best``) of each ``width`` consecutive values."""
    if len(values) < width:
        return values[:0]
    span = 1
    while span * 2 <= width:
        values = best(values[:-span], values[span:])
        span *= 2
    return best(values[: len(values) - (width - span)], values[width - span :]) if width > span else values

"""Benchmark decontamination with suffix arrays of the training text.

Each task cuts its documents into shards of some megabytes and builds the suffix array
of each: the word positions, sorted by the words that follow, as far as any search can
tell them apart. Every benchmark suffix is binary-searched in every shard. The interval
it ends in holds all verbatim occurrences, and the words at them are marked.

A suffix that starts with a pair of words found nowhere in the benchmark cannot match a
window, so it is left out of the array. A single-word item is searched by one word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import only
from tessera.llm.words import ALPHANUMERIC, Words, gram_hashes, slices, text_bytes
from tessera.session import staged

WINDOW = 10
#: Benchmark text that one pass over the documents searches for; a larger benchmark
#: takes a pass for each such block.
BLOCK_BYTES = 16 << 20


class Needles:
    """The windows of some benchmark items as word hashes."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.ids = [i for i, _ in items]
        data, rows = text_bytes(pa.array([t or "" for _, t in items], pa.large_string()))
        words = Words(data, rows, ALPHANUMERIC)
        self.words, self.bounds = words.hashes(), words.bounds
        self.window = window
        starts, lengths, owner = [], [], []
        for i, (a, b) in enumerate(zip(self.bounds[:-1], self.bounds[1:])):
            n = b - a
            size = min(n, window)
            count = n - size + 1 if n else 0
            starts.append(np.arange(a, a + count))
            lengths.append(np.full(count, size))
            owner.append(np.full(count, i))
        self.starts = np.concatenate([*starts, np.zeros(0, int)]).astype(np.int64)
        self.lengths = np.concatenate([*lengths, np.zeros(0, int)]).astype(np.int64)
        self.owner = np.concatenate([*owner, np.zeros(0, int)]).astype(np.int64)
        self._group(window)
        #: Remaining words of the item from each window on.
        self.room = (self.bounds[1:][self.owner] - self.starts) if len(self.owner) else self.owner
        one = self.lengths == 1
        self.first_words = np.unique(self.words[self.starts[one]])
        pairs = gram_hashes(self.words, 2)
        self.first_pairs = np.unique(pairs[self.starts[~one]]) if len(pairs) else pairs

    def _group(self, window: int) -> None:
        """Equal windows are one kind, searched once; kinds found in the same items share an owner set."""
        kind, total = np.zeros(len(self.starts), np.int64), 0
        for size in np.unique(self.lengths):
            mine = np.flatnonzero(self.lengths == size)
            names, kind[mine] = np.unique(gram_hashes(self.words, int(size))[self.starts[mine]], return_inverse=True)
            kind[mine] += total
            total += len(names)
        #: Windows ordered by kind, and where each kind begins there.
        self.by_kind = np.lexsort([self.owner, kind])
        self.kind_bounds = np.searchsorted(kind[self.by_kind], np.arange(total + 1))
        sample = self.by_kind[self.kind_bounds[:-1]]
        self.kind_starts, self.kind_lengths = self.starts[sample], self.lengths[sample]
        ordered_kind, ordered_owner = kind[self.by_kind], self.owner[self.by_kind]
        fresh = np.ones(len(kind), bool)
        fresh[1:] = (ordered_kind[1:] != ordered_kind[:-1]) | (ordered_owner[1:] != ordered_owner[:-1])
        owner, owner_kind = ordered_owner[fresh], ordered_kind[fresh]
        bounds = np.searchsorted(owner_kind, np.arange(total + 1))
        # Two sums of random numbers of the items tell owner sets apart by 128 bits.
        marks = np.random.default_rng(1).integers(0, 1 << 63, (2, len(self.ids) + 1), np.uint64)
        sums = [np.add.reduceat(m[owner], bounds[:-1]) if total else m[:0] for m in marks]
        _, first, self.owner_set = np.unique(np.stack(sums, 1), axis=0, return_index=True, return_inverse=True)
        self.owner_set = self.owner_set.reshape(-1)
        self.set_owners = [owner[bounds[k] : bounds[k + 1]] for k in first]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size says."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    # A table of low bits rules out nearly all values before the binary search.
    table = np.zeros(1 << 18, bool)
    table[(ordered & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
    out = table[(values & np.uint64((1 << 18) - 1)).astype(np.int64)]
    at = np.flatnonzero(out)
    found = np.minimum(np.searchsorted(ordered, values[at]), len(ordered) - 1)
    out[at] = ordered[found] == values[at]
    return out


def suffix_array(words: np.ndarray, row_end: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The positions ``at`` sorted by the up to ``depth`` words that follow in their row.

    ``row_end`` has the end of each position's row. A row's end sorts before any word.
    """
    keys = []
    for d in reversed(range(depth)):
        p = at + d
        inside = p < row_end[at]
        keys.append(np.where(inside, words[np.minimum(p, len(words) - 1)], np.uint64(0)))
        keys.append(inside)
    return at[np.lexsort(keys)] if len(at) else at


def _search(words, row_end, array, needles: Needles) -> tuple[np.ndarray, np.ndarray]:
    """For each kind of window the interval of the suffix array whose suffixes start with it."""
    n = len(needles.kind_starts)
    lo, hi = np.zeros(n, np.int64), np.full(n, len(array), np.int64)
    for d in range(int(needles.kind_lengths.max(initial=0))):
        live = np.flatnonzero((needles.kind_lengths > d) & (lo < hi))
        if not len(live):
            break
        wanted = needles.words[needles.kind_starts[live] + d]
        bounds = []
        for right in (False, True):
            a, b = lo[live].copy(), hi[live].copy()
            while True:
                open_ = np.flatnonzero(a < b)
                if not len(open_):
                    break
                mid = (a[open_] + b[open_]) >> 1
                p = array[mid] + d
                inside = p < row_end[array[mid]]
                word = words[np.minimum(p, len(words) - 1)]
                less = ~inside | ((word <= wanted[open_]) if right else (word < wanted[open_]))
                a[open_[less]] = mid[less] + 1
                b[open_[~less]] = mid[~less]
            bounds.append(a)
        lo[live], hi[live] = bounds
    return lo, np.maximum(lo, hi)


def _extend(words, row_end, at, needles: Needles, window: np.ndarray) -> np.ndarray:
    """How many words the item and the document share from each occurrence on."""
    length = needles.lengths[window].copy()
    live = np.arange(len(at))
    while len(live):
        n = length[live]
        ok = (n < needles.room[window[live]]) & (at[live] + n < row_end[at[live]])
        live, n = live[ok], n[ok]
        same = words[at[live] + n] == needles.words[needles.starts[window[live]] + n]
        live = live[same]
        length[live] += 1
    return length


def _matches(words, row_end, at, kind, needles: Needles) -> tuple:
    """Longest verbatim matches of one document: item number, first word, how many words.

    Of the occurrences of one item on one diagonal the first is the longest match.
    """
    sizes = needles.kind_bounds[kind + 1] - needles.kind_bounds[kind]
    window = needles.by_kind[_ranges(needles.kind_bounds[kind], sizes)]
    at, owner = np.repeat(at, sizes), needles.owner[window]
    length = _extend(words, row_end, at, needles, window)
    diagonal = at - needles.starts[window]
    order = np.lexsort([at, diagonal, owner])
    o, g, a, n = owner[order], diagonal[order], at[order], length[order]
    first = np.ones(len(order), bool)
    first[1:] = (o[1:] != o[:-1]) | (g[1:] != g[:-1]) | (a[1:] > a[:-1] + n[:-1])
    return o[first], a[first], n[first]


def _lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _shard(data, rows, needles: Needles, doc_ids, places: bool) -> pa.RecordBatch:
    found = Words(data, rows, ALPHANUMERIC)
    words, count = found.hashes(), found.counts
    row = found.row_of()
    row_end = found.bounds[1:][row] if len(row) else row
    keep = np.zeros(len(words), bool)
    if len(words):
        pairs = gram_hashes(words, 2)
        keep[: len(pairs)] = _member(pairs, needles.first_pairs)
        keep |= _member(words, needles.first_words)
    depth = int(needles.lengths.max(initial=0))
    array = suffix_array(words, row_end, np.flatnonzero(keep), depth)
    lo, hi = _search(words, row_end, array, needles)
    # At most one occurrence for each word and length of window, however often an item repeats one.
    kind = np.repeat(np.arange(len(lo)), hi - lo)
    at = array[_ranges(lo, hi - lo)] if len(kind) else np.zeros(0, np.int64)
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + needles.kind_lengths[kind], -1)
    hit = np.cumsum(marks)[:-1] > 0
    n_hit = np.add.reduceat(np.append(hit, False), np.minimum(found.bounds[:-1], len(hit))) * (count > 0) if len(count) else count
    order = np.argsort(row[at], kind="stable")
    at, kind = at[order], kind[order]
    ends = np.searchsorted(row[at], np.arange(len(count) + 1))
    items: list[list] = [[] for _ in count]
    n_spots, spots = np.zeros(len(count), np.int64), []
    for r in np.flatnonzero(np.diff(ends)):
        here = slice(ends[r], ends[r + 1])
        sets = [needles.set_owners[s] for s in np.unique(needles.owner_set[kind[here]])]
        items[r] = [needles.ids[o] for o in np.unique(np.concatenate(sets))]
        if places:
            o, a, n = _matches(words, row_end, at[here], kind[here], needles)
            spots.append((o, a - found.bounds[r], n))
            n_spots[r] = len(o)
    o, a, n = (np.concatenate([s[i] for s in spots]) if spots else np.zeros(0, np.int64) for i in range(3))
    ids = pa.array(needles.ids, pa.int64()).take(pa.array(o))
    spot = pa.StructArray.from_arrays([ids, pa.array(a, pa.int64()), pa.array(n, pa.int64())], ["item_id", "at", "words"])
    spans = [_runs(hit[found.bounds[i] : found.bounds[i + 1]]) if n_hit[i] else np.zeros((0, 2), np.int64) for i in range(len(count))]
    edges = np.concatenate([*spans, np.zeros((0, 2), np.int64)]).astype(np.int64)
    span = pa.StructArray.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["from", "to"])
    return pa.RecordBatch.from_arrays(
        [
            doc_ids,
            pa.array(count.astype(np.int64)),
            _lists(np.array([len(s) for s in spans], np.int64), span),
            pa.array(items, pa.list_(pa.int64())),
            _lists(n_spots, spot),
        ],
        ["doc_id", "n_words", "spans", "items", "matches"],
    )


def _runs(hit: np.ndarray) -> np.ndarray:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edges.reshape(-1, 2)


_SCHEMA = "doc_id bigint, n_words bigint, spans array<struct<from:bigint,to:bigint>>, items array<bigint>, matches array<struct<item_id:bigint,at:bigint,words:bigint>>"


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """The items in blocks of bounded size, one at a time on the driver."""
    block, size = [], 0
    for r in only(benchmark, "item_id", "text").toLocalIterator():
        block.append((r[0], r[1]))
        size += 64 + 4 * len(r[1] or "")
        if size > BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _search_block(docs: DataFrame, items: list[tuple], window: int, places: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        needles = Needles(shared.value, window)
        for batch in batches:
            for rows, data, bounds in slices(batch, "text"):
                yield _shard(data, bounds, needles, rows.column(0), places)

    return docs.mapInArrow(run, _SCHEMA)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, places: bool = True) -> DataFrame:
    """Per document: doc_id, n_words, spans, items, matches.

    ``spans`` are the runs of hit words (word numbers from, to), ``items`` the ids of the
    items with an occurring window, ``matches`` the longest verbatim matches of each item
    (at which word, how many words), none without ``places``. Equal windows are searched
    once, so the search is linear in text that many items share; the matches themselves are
    one for each item and place. Words are runs of digits, a to z after lower-casing
    A to Z, and characters beyond ASCII. A null or empty text has no words; an item
    without words matches nothing. Repeated documents give repeated rows; items that
    share a text are all reported; an item with a null id is reported as null. With no
    documents the result is empty, with no items nothing is hit.
    """
    docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    benchmark = benchmark.select(benchmark["item_id"].cast("bigint").alias("item_id"), benchmark["text"])
    parts = [_search_block(docs, block, window, places) for block in _blocks(benchmark)]
    if len(parts) <= 1:
        return parts[0] if parts else _search_block(docs, [], window, places)
    # More than one block: a document's rows are brought together by id and number of words.
    numbered = staged(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    plain = numbered.select(F.col("row").alias("doc_id"), "text")
    found = None
    for block in _blocks(benchmark):
        part = _search_block(plain, block, window, places)
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"),
        *(F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "matches")),
    )
    return merged.withColumnRenamed("doc_id", "row").join(numbered.select("row", "doc_id"), "row").select(
        "doc_id", "n_words", "spans", "items", "matches"
    )


def _digest(batches):
    for batch in batches:
        hits, names, shas = [], [], []
        for spans, items in zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist()):
            n, reach = 0, 0
            for s in sorted(spans, key=lambda s: s["from"]):
                n += max(0, s["to"] - max(reach, s["from"]))
                reach = max(reach, s["to"])
            ids = sorted(str(i) for i in {*items} - {None})
            hits.append(n)
            names.append(len({*items}))
            shas.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), pa.array(hits, pa.int64()), pa.array(names, pa.int64()), pa.array(shas), pa.array([h > 0 for h in hits])],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Nulls, empty texts, repeated rows and empty tables are as in ``benchmark_matches``.
    """
    return benchmark_matches(docs, benchmark, window, places=False).mapInArrow(
        _digest, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, with their columns.

    Rows are judged and passed on in the same task, so nothing is shuffled. Null and empty
    texts hold no window and stay; repeated rows stay or go together; without items, or
    with items that hold no word, every row stays.
    """
    at = docs.columns.index("text")
    for items in _blocks(only(benchmark, "item_id", "text")):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            needles = Needles([(0, t) for _, t in shared.value], window)
            for batch in batches:
                plain = pa.RecordBatch.from_arrays([batch.column(at)], ["text"])
                for rows, data, bounds in slices(plain, "text"):
                    begin = rows.column(0).offset - plain.column(0).offset
                    spans = _shard(data, bounds, needles, pa.nulls(rows.num_rows, pa.int64()), False).column("spans")
                    yield batch.slice(begin, rows.num_rows).filter(pc.equal(pc.list_value_length(spans), 0))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

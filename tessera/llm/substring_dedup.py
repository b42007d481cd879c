"""Substring deduplication by relative Lempel-Ziv parsing.

The corpus is cut into blocks, and every block is both a reference and a text to parse.
The blocks' windows of ``width`` words are indexed in buckets by hash, so that one
question to a bucket looks a window up in all blocks at once. A document is then parsed
greedily: a factor starts at the first window that a block holds a copy of and grows
word by word as long as the window that ends in the next word has a copy too. The next
factor is looked for from the window after the last one, not from the word after it, so
that a copy that lies across the boundary of two factors is found. Factors are at least
``width`` words long and are the duplicate spans.

Two equal windows have the same minimizer (the smallest hash of ``SEED`` words in them),
so only windows whose minimizer occurs more than once can have a copy: the blocks first
ask for their minimizers, a small share of all positions, and index only what is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.blocks import (
    QUESTION,
    Block,
    answer,
    blocks,
    bucket_bounds,
    buckets_for,
    each_block,
    flags,
    questions,
    with_answers,
)
from tessera.llm.words import Words, gram_hashes, sliding

WIDTH = 35
SEED = 8


def _repeated_by_block(own: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Which keys another block has too. A block brings each key once."""
    order = np.lexsort(keys[::-1])
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    out = np.zeros(len(order), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


class Minimizers:
    """Windows of a block with their minimizers."""

    def __init__(self, block: Block, width: int, seed: int):
        self.words = Words(block.data, block.rows, fold=False)
        self.hashes = self.words.hashes()
        self.starts = self.words.window_starts(width)
        grams = gram_hashes(self.hashes, seed)
        span = width - seed + 1
        least = sliding(grams, span)
        self.least = least[self.starts] if len(self.starts) else np.zeros(0, np.uint64)
        # A seed is chosen where some whole window has it as its minimum.
        shown = np.zeros(len(grams) + span - 1, np.uint64)
        shown[self.starts + span - 1] = self.least
        top = sliding(shown, span, np.maximum)
        chosen = grams[top == grams] if len(grams) else grams
        self.seeds, counts = np.unique(chosen, return_counts=True)
        self.local = counts > 1

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Window starts whose minimizer occurs more than once."""
        keep = (repeated | self.local)[np.searchsorted(self.seeds, self.least)] if len(self.least) else np.zeros(0, bool)
        return self.starts[keep]


class Windows:
    """The candidate windows of a block: distinct 96-bit keys, and which of them each start has."""

    def __init__(self, hashes: np.ndarray, starts: np.ndarray, width: int):
        self.starts = starts
        first = gram_hashes(hashes, width)[starts] if len(starts) else np.zeros(0, np.uint64)
        second = gram_hashes(hashes, width, 1)[starts].astype(np.uint32) if len(starts) else np.zeros(0, np.uint32)
        order = np.lexsort([second, first])
        a, b = first[order], second[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.first, self.second = a[new], b[new]
        self.key = np.empty(len(order), np.int64)
        self.key[order] = np.cumsum(new) - 1
        self.local = np.bincount(self.key, minlength=len(self.first)) > 1


def parse(is_copied: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Greedy factors (from, to) of one document, from which window starts have a copy."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], is_copied.astype(np.int8), [0]])))
    return [(a, b - 1 + width) for a, b in edges.reshape(-1, 2).tolist()]


def duplicate_factors(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, factors, kept.

    ``factors`` are the parsed duplicate factors (word numbers from, to; they may overlap
    by up to ``width`` - 1 words), and ``kept`` is the text of the words outside them,
    joined by one space. A window counts as copied if its words start anywhere else,
    in the same document too. Words are split at space and 0x09 to 0x0D and compared as
    they are. Null and empty texts have no words and texts under ``width`` words no
    windows: both are kept whole. Repeated rows are copies of each other and lose all
    their windows. Ids are only carried along: null and repeated ones do no harm. No
    documents give no rows. Windows are compared by 96 bits of two hashes.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = blocks(docs)
    buckets = buckets_for(found)

    def ask_seeds(batches):
        for block in each_block(batches):
            m = Minimizers(block, width, seed)
            yield questions(block.number, bucket_bounds(m.seeds, buckets), m.seeds)

    seeds = answer(found.mapInArrow(ask_seeds, QUESTION), (np.uint64,), _repeated_by_block, pack=True)

    def windows_of(block: Block) -> tuple[Minimizers, Windows]:
        m = Minimizers(block, width, seed)
        repeated = flags(bucket_bounds(m.seeds, buckets), block.told("seeds"))
        return m, Windows(m.hashes, m.candidates(repeated), width)

    def ask_windows(batches):
        for block in each_block(batches):
            _, w = windows_of(block)
            yield questions(block.number, bucket_bounds(w.first, buckets), w.first, w.second)

    windows = answer(
        with_answers(found, seeds=seeds).mapInArrow(ask_windows, QUESTION), (np.uint64, np.uint32), _repeated_by_block, pack=True
    )

    def remove(batches):
        for block in each_block(batches):
            m, w = windows_of(block)
            copied = (flags(bucket_bounds(w.first, buckets), block.told("windows")) | w.local)[w.key]
            starts = np.zeros(len(m.words), bool)
            starts[w.starts[copied]] = True
            bounds = m.words.bounds
            raw = block.data.tobytes()
            factors, kept = [], []
            for i in range(len(bounds) - 1):
                own = raw[block.rows[i] : block.rows[i + 1]].split()
                spans = parse(starts[bounds[i] : bounds[i + 1]], width)
                if spans:
                    left, at = [], 0
                    for a, b in spans:
                        left += own[at:a]
                        at = max(at, b)
                    own = left + own[at:]
                factors.append([{"from": a, "to": b} for a, b in spans])
                kept.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays(
                [
                    block.doc_ids,
                    pa.array(m.words.counts.astype(np.int64)),
                    pa.array(factors, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "factors", "kept"],
            )

    return with_answers(found, seeds=seeds, windows=windows).mapInArrow(
        remove, f"doc_id {kind}, n_words bigint, factors array<struct<from:bigint,to:bigint>>, kept string"
    )

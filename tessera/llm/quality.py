"""Quality by votes of the nearest labelled documents in a latent semantic space.

A document is a bag of shape terms, triples of character kinds (lower, upper, digit,
space, line end, letter beyond ASCII, and every punctuation mark for itself) and counts
of repeated neighbours, and of word terms, its words and pairs of words hashed into a
fixed number of buckets. The terms of a bounded labelled sample are weighted, each of the
two bags to its share of the length, and decomposed; the leading right singular vectors
are the latent space. The sample's
vectors are broadcast, every document's cosine to all of them is computed exactly, a
block of documents at a time, and the nearest vote with their similarity as weight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import in_part, only
from tessera.llm.samples import labelled
from tessera.llm.words import ALPHANUMERIC, Words, gram_hashes, slices

#: Labelled documents to learn from, size of the space, and voters.
SAMPLE = 4000
LATENT = 48
NEIGHBOURS = 25
#: Blocks of documents that are compared with the sample at once.
BLOCK = 512
#: Bytes of text whose terms are counted at once; every byte takes some 50 of memory.
RUN = 1 << 20
THRESHOLD = 0.3

_codes = np.arange(256)
_KIND = np.zeros(256, np.int64)
_KIND[(_codes >= 0x61) & (_codes <= 0x7A)] = 1
_KIND[(_codes >= 0x41) & (_codes <= 0x5A)] = 2
_KIND[(_codes >= 0x30) & (_codes <= 0x39)] = 3
_KIND[_codes == 0x20] = 4
_KIND[_codes == 0x0A] = 5
_KIND[_codes >= 0x80] = 6
_marks = [c for c in range(0x21, 0x7F) if _KIND[c] == 0]
_KIND[_marks] = 7 + np.arange(len(_marks))
_KINDS = 7 + len(_marks)
SHAPES = _KINDS**3
LAGS = 4
#: Words and pairs of words go into 2**WORD_BITS buckets each; their bag has this length beside the shapes' one.
WORD_BITS = 12
WORD_SHARE = 0.6
FIRST_WORD = SHAPES + LAGS
TERMS = FIRST_WORD + 2 * (1 << WORD_BITS)


def term_counts(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shape and word terms of each row: row, term and count, ordered by row."""
    n = len(rows) - 1
    kind = _KIND[data]
    shape = (kind[:-2] * _KINDS + kind[1:-1]) * _KINDS + kind[2:] if len(kind) > 2 else kind[:0]
    owner = np.repeat(np.arange(n), np.diff(rows))
    whole = owner[:-2] == owner[2:] if len(kind) > 2 else owner[:0].astype(bool)
    keys, counts = np.unique(owner[:-2][whole] * TERMS + shape[whole], return_counts=True) if whole.any() else (kind[:0], kind[:0])
    words = Words(data, rows)
    hashes, of = words.hashes(), words.row_of()
    more_keys, more_counts = [keys], [counts]
    for lag in range(1, LAGS + 1):
        same = (hashes[lag:] == hashes[:-lag]) & (of[lag:] == of[:-lag])
        repeats = np.bincount(of[lag:][same], minlength=n)[:n]
        at = np.flatnonzero(repeats)
        more_keys.append(at * TERMS + SHAPES + lag - 1)
        more_counts.append(repeats[at])
    plain = Words(data, rows, ALPHANUMERIC)
    words, of = plain.hashes(), plain.row_of()
    pairs = gram_hashes(words, 2)
    inside = of[: len(pairs)] == of[1 : 1 + len(pairs)]
    for i, (row, hashed) in enumerate([(of, words), (of[: len(pairs)][inside], pairs[inside])]):
        bucket = (hashed >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        keys, counts = np.unique(row * TERMS + FIRST_WORD + (i << WORD_BITS) + bucket, return_counts=True)
        more_keys.append(keys)
        more_counts.append(counts)
    keys, counts = np.concatenate(more_keys), np.concatenate(more_counts)
    order = np.argsort(keys, kind="stable")
    return keys[order] // TERMS, keys[order] % TERMS, counts[order]


class LatentVotes:
    """The fitted space and its labelled vectors."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, latent: int = LATENT):
        """``docs`` holds terms and counts of each labelled document."""
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        seen = np.concatenate([t for t, _ in docs] + [np.zeros(0, np.int32)])
        self.terms, frequency = np.unique(seen, return_counts=True)
        self.n_shapes = int(np.searchsorted(self.terms, FIRST_WORD))
        self.place = np.full(TERMS, -1, np.int32)
        self.place[self.terms] = np.arange(len(self.terms))
        self.weight = (np.log((1 + len(docs)) / (1 + frequency)) + 1).astype(np.float32)
        self.axes = np.zeros((len(self.terms), 1), np.float32)
        if not len(docs) or not len(self.terms):
            self.vectors = np.zeros((len(docs), 1), np.float32)
            return
        bounds = np.concatenate([[0], np.cumsum([len(t) for t, _ in docs])])
        counts = np.concatenate([c for _, c in docs])

        def parts():
            """The weighted sample, a block of rows at a time: as a whole it would be hundreds of megabytes."""
            for first in range(0, len(docs), BLOCK):
                last = min(len(docs), first + BLOCK)
                row = np.repeat(np.arange(last - first), np.diff(bounds[first : last + 1]))
                yield slice(first, last), self._matrix(last - first, row, seen[bounds[first] : bounds[last]], counts[bounds[first] : bounds[last]])

        times = lambda right: np.concatenate([m @ right for _, m in parts()])
        under = lambda left: sum(m.T @ left[at] for at, m in parts())
        shape = len(docs), len(self.terms)
        k = min(latent, *shape)
        probe = np.random.default_rng(5).standard_normal((shape[1], min(k + 16, shape[1]))).astype(np.float32)
        basis = times(probe)
        for _ in range(4):
            basis, _ = np.linalg.qr(times(under(basis)))
        _, _, right = np.linalg.svd(under(basis).T, full_matrices=False)
        self.axes = np.ascontiguousarray(right[:k].T)
        self.vectors = self._unit(times(self.axes))

    @staticmethod
    def _unit(m: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, size, out=np.zeros_like(m), where=size > 0)

    def _matrix(self, n: int, row: np.ndarray, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        at = self.place[term]
        known = at >= 0
        out = np.zeros((n, len(self.terms)), np.float32)
        out[row[known], at[known]] = np.log1p(count[known]) * self.weight[at[known]]
        out[:, : self.n_shapes] = self._unit(out[:, : self.n_shapes])
        out[:, self.n_shapes :] = self._unit(out[:, self.n_shapes :]) * np.float32(WORD_SHARE)
        return self._unit(out)

    def scores(self, n: int, row: np.ndarray, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Votes for label 1 in 0..1; the share of label 1 in the sample where nothing is near."""
        out = np.full(n, self.prior)
        k = min(NEIGHBOURS, len(self.labels))
        if not k:
            return out
        for a in range(0, n, BLOCK):
            b = min(n, a + BLOCK)
            i, j = np.searchsorted(row, [a, b])
            near = self._unit(self._matrix(b - a, row[i:j] - a, term[i:j], count[i:j]) @ self.axes) @ self.vectors.T
            best = np.argpartition(near, -k, axis=1)[:, -k:]
            weight = np.maximum(np.take_along_axis(near, best, 1), 0) ** 8
            total = weight.sum(axis=1)
            some = total > 0
            out[a:b][some] = (weight * self.labels[best]).sum(axis=1)[some] / total[some]
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> LatentVotes:
    """Learn from at most ``sample`` labelled documents (crc32(doc_id) mod 5 not 0)."""

    def run(batches):
        for batch in batches:
            for rows, data, bounds in slices(batch, "text", RUN):
                row, term, count = term_counts(data, bounds)
                cut = np.searchsorted(row, np.arange(1, rows.num_rows))
                # Big-endian numbers: their bytes sort as the numbers do.
                term, count = (pa.array([x.tobytes() for x in np.split(v.astype(">i4"), cut)], pa.binary()) for v in (term, count))
                yield pa.RecordBatch.from_arrays([rows.column(0), term, count], ["label", "terms", "counts"])

    found = labelled(docs, labels, label, sample).select("label", "text").mapInArrow(run, "label int, terms binary, counts binary")
    # Whatever order the rows come in, equal similarities are settled the same way.
    rows = sorted(found.collect(), key=tuple)
    numbers = lambda v: np.frombuffer(v, ">i4").astype(np.int32)
    return LatentVotes([(numbers(r[1]), numbers(r[2])) for r in rows], np.array([r[0] for r in rows], np.float64))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted.

    held_out is crc32(doc_id as text) mod 5 = 0 (false for a null id). A null or empty
    text, or one without a term of the sample, is near to nothing and scores the share of
    label 1 in the sample; so does everything when no labelled row exists (then 0.5).
    Repeated rows give repeated rows, no documents none; of ties in similarity the first in
    the sample vote, which is ordered by label and terms. Only doc_id and text of ``docs`` are read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for rows, data, bounds in slices(batch, "text", RUN):
                score = model.value.scores(rows.num_rows, *term_counts(data, bounds))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(score)], ["doc_id", "score"])

    scored = only(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", in_part(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with their columns.

    Null and empty texts score the sample's share of label 1; repeated rows are judged each
    for itself, and no documents give none.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            plain = pa.RecordBatch.from_arrays([batch.column(at)], ["text"])
            done = 0
            for rows, data, bounds in slices(plain, "text", RUN):
                score = model.value.scores(rows.num_rows, *term_counts(data, bounds))
                yield batch.slice(done, rows.num_rows).filter(pa.array(score >= threshold))
                done += rows.num_rows

    return docs.mapInArrow(run, docs.schema)

"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter triple is bound into one vector:
the first letter's vector rotated twice, times the second's rotated once, times the
third's. The bundle of all triples of a text is its profile; the bundle of the unit
profiles of a language's documents is its prototype, and a text has the language whose
prototype's cosine with its profile is largest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import in_part, only
from tessera.llm.words import FOLD, slices
from tessera.session import staged

DIMENSIONS = 512
#: Languages a model may have; they are collected with their prototypes.
MOST_LANGUAGES = 4096

LETTERS = 64
_TRIPLES = LETTERS**3
_codes = np.arange(256)
#: 0: no letter; a to z; the bytes of characters beyond ASCII, folded into 37 codes.
_LETTER = np.zeros(256, np.int32)
_LETTER[0x61:0x7B] = np.arange(1, 27)
_LETTER[0x80:] = 27 + (_codes[0x80:] & 0x3F) % 37
_VECTORS = np.random.default_rng(11).choice(np.array([-1, 1], np.int8), (LETTERS, DIMENSIONS))
_BOUND_ONCE = 16_384


def triple_vectors(triples: np.ndarray) -> np.ndarray:
    a, rest = np.divmod(triples, LETTERS * LETTERS)
    b, c = np.divmod(rest, LETTERS)
    return np.roll(_VECTORS, 2, axis=1)[a] * np.roll(_VECTORS, 1, axis=1)[b] * _VECTORS[c]


class Binder:
    """Bound triples, kept for the first ``_BOUND_ONCE`` different ones a worker meets."""

    def __init__(self):
        self.place = np.full(_TRIPLES, -1, np.int32)
        self.table = np.empty((_BOUND_ONCE, DIMENSIONS), np.float32)
        self.used = 0

    def bundle(self, triples: np.ndarray, counts: np.ndarray) -> np.ndarray:
        new = triples[self.place[triples] < 0][: _BOUND_ONCE - self.used]
        if len(new):
            self.table[self.used : self.used + len(new)] = triple_vectors(new)
            self.place[new] = np.arange(self.used, self.used + len(new))
            self.used += len(new)
        at = self.place[triples]
        known = at >= 0
        weights = counts.astype(np.float32)
        total = weights[known] @ self.table[at[known]]
        if not known.all():
            total = total + weights[~known] @ triple_vectors(triples[~known]).astype(np.float32)
        return total


_binder: list[Binder] = []


def profiles(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Unit profiles of consecutive rows; zero for a row without a triple."""
    if not _binder:
        _binder.append(Binder())
    code = _LETTER[FOLD[data]]
    out = np.zeros((len(rows) - 1, DIMENSIONS), np.float32)
    for i, (a, b) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist())):
        if a == b:
            continue
        own = np.concatenate([[0], code[a:b], [0]])
        triple = (own[:-2] * LETTERS + own[1:-1]) * LETTERS + own[2:]
        triple = triple[own[1:-1] > 0]
        if len(triple) > _TRIPLES // 4:
            counts = np.bincount(triple, minlength=_TRIPLES)
            distinct = np.flatnonzero(counts)
            counts = counts[distinct]
        else:
            distinct, counts = np.unique(triple, return_counts=True)
        if len(distinct):
            vector = _binder[0].bundle(distinct, counts)
            size = float(np.linalg.norm(vector))
            out[i] = vector / size if size else vector
    return out


def _has_letter(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    folded = FOLD[data]
    seen = np.concatenate([[0], np.cumsum((folded >= 0x61) & (folded <= 0x7A))])
    out = seen[rows[1:]] > seen[rows[:-1]]
    for i in np.flatnonzero(~out & (rows[1:] > rows[:-1])):
        out[i] = any(c.isalpha() for c in data[rows[i] : rows[i + 1]].tobytes().decode(errors="replace"))
    return out


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and unit prototypes of all learning documents.

    Learning documents have a language and crc32(doc_id) mod 4 not 2. A task sums the
    profiles of its own, so what is sent is one vector a task and language.
    """
    learn = only(docs, "doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~in_part(F.col("doc_id"), 4, 2))

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for rows, data, bounds in slices(batch, "text"):
                vectors = profiles(data, bounds)
                languages = rows.column(rows.schema.get_field_index("lang")).to_pylist()
                for language in {*languages}:
                    mine = np.array([x == language for x in languages])
                    sums[language] = sums.get(language, 0) + vectors[mine].sum(axis=0, dtype=np.float64)
        for language, vector in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(np.asarray(vector, np.float64))],
                ["lang", "dimension", "value"],
            )

    found = learn.select("text", "lang").mapInArrow(run, "lang string, dimension int, value double")
    sums = staged(found.groupBy("lang", "dimension").agg(F.sum("value").alias("value")), "prototypes")
    languages = sorted(r[0] for r in sums.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    prototypes = np.zeros((len(languages), DIMENSIONS))
    at = {x: i for i, x in enumerate(languages)}
    for r in sums.collect():
        prototypes[at[r["lang"]], r["dimension"]] = r["value"]
    size = np.linalg.norm(prototypes, axis=1, keepdims=True)
    return languages, np.divide(prototypes, size, out=np.zeros_like(prototypes), where=size > 0).astype(np.float32)


def identify(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score.

    held_out is crc32(doc_id as text) mod 4 = 2 (false for a null id, which is not
    learned from either). A null text or one without any letter gets ``und`` and score 0,
    as does every text when there is nothing to learn from. The score is the cosine with
    the winning prototype, at least 0; ties go to the language that sorts first. Repeated
    rows give repeated rows, no documents none.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        languages, prototypes = model.value
        names = np.array([*languages, "und"], object)
        for batch in batches:
            for rows, data, bounds in slices(batch, "text"):
                near = profiles(data, bounds) @ prototypes.T
                if not len(languages):
                    best, score = np.zeros(rows.num_rows, int), np.zeros(rows.num_rows)
                else:
                    best = near.argmax(axis=1)
                    score = np.clip(near[np.arange(len(best)), best], 0, 1).astype(np.float64)
                silent = ~_has_letter(data, bounds)
                best, score = np.where(silent, len(languages), best), np.where(silent, 0.0, score)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    found = only(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", in_part(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")

"""Toxicity by a learned lexicon that is met through a Levenshtein automaton.

The lexicon holds words, and word beginnings, that labelled toxic documents have much
more often than others. Its trie is intersected with the Levenshtein automaton of one
edit: a state of the product is a set of (trie node, edits so far), and the reachable
sets become one table, so that a document word walks it once, whatever the size of the
lexicon, and ends in the best term within one edit. All words of a run of documents
walk together. What counts is weighted by the words around it: a hit between quotation
marks or after a word of saying is kept apart from one in running speech, and a
regression on a few sums gives the score.
"""

from __future__ import annotations

import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import in_part, only
from tessera.llm.samples import labelled
from tessera.llm.words import FOLD, Words, slices


#: Labelled documents to learn from, half of each label.
SAMPLE = 8000
#: Support and odds an entry of the lexicon needs; all that have them are in it.
LEAST_DOCUMENTS = 5
LEAST_ODDS = 2.5
PREFIXES = range(3, 9)
#: Words of fewer letters are met exactly only.
FUZZY_FROM = 5
#: Words before and after a hit in which quotation is looked for.
CONTEXT = 6
MOST_LETTERS = 40

_codes = np.arange(256)
#: One code a character up to U+00FF: 0xC2 or 0xC3 and its follower become the Latin-1 code.
_LOWER_LATIN = np.where((_codes >= 0xC0) & (_codes <= 0xDE) & (_codes != 0xD7), _codes + 32, FOLD).astype(np.uint8)
_LETTER = ((_codes >= 0x61) & (_codes <= 0x7A)) | ((_codes >= 0x30) & (_codes <= 0x39)) | (_codes >= 0x80) | np.isin(_codes, list(b"@$"))
_QUOTE = _codes == 0x22
SAYING = ("said", "says", "called", "quote", "quoted", "word", "sagte", "wort", "dit", "mot", "dijo", "palabra")


#: Single quotation marks are apostrophes as well: like the ASCII one they only separate words.
_QUOTATION = "«»“”„‟‹›「」『』〝〞〟＂"


def _mark_of(code: int) -> int:
    """0 for a character of words, else the ASCII one that stands for it: a quotation mark or a space."""
    c = chr(code)
    if c in _QUOTATION:
        return 0x22
    kind = unicodedata.category(c)
    return 0x20 if kind[0] in "PSZ" or kind == "Cc" or code in (0x200B, 0xFEFF) else 0


_MARKS = np.array([0] * 0x80 + [_mark_of(c) for c in range(0x80, 0x20000)], np.uint8)


def latin(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased text with one code for each character up to U+00FF, and its row bounds.

    Quotation marks, other punctuation, symbols and spaces beyond ASCII become one ASCII
    quotation mark or space each; other characters keep their bytes.
    """
    value, gone = data.copy(), np.zeros(len(data), bool)
    for length, low, high in ((2, 0xC2, 0xDF), (3, 0xE0, 0xEF), (4, 0xF0, 0xF4)):
        at = np.flatnonzero((data >= low) & (data <= high))
        at = at[at + length <= len(data)]
        code = data[at].astype(np.int64) & (0x7F >> length)
        whole = np.ones(len(at), bool)
        for k in range(1, length):
            whole &= (data[at + k] & 0xC0) == 0x80
            code = code << 6 | (data[at + k] & 0x3F)
        mark = np.where(whole & (code < len(_MARKS)), _MARKS[np.minimum(code, len(_MARKS) - 1)], 0)
        is_mark = mark > 0
        value[at[is_mark]] = mark[is_mark]
        for k in range(1, length):
            gone[at[is_mark] + k] = True
        short = at[whole & ~is_mark & (code < 0x100)]
        value[short + 1] = value[short + 1] | (data[short] & 1) << 6
        gone[short] = True
    kept = np.concatenate([[0], np.cumsum(~gone)])
    return _LOWER_LATIN[value[~gone]], kept[rows]


def _features_of_word(word: bytes):
    yield b"=" + word
    for n in PREFIXES:
        if len(word) > n:
            yield b"^" + word[:n]


def _document_entries(batches):
    """(entry, label, documents) of each batch: which words and beginnings a document has."""
    for batch in batches:
        counts: Counter = Counter()
        for rows, data, bounds in slices(batch, "text"):
            text, bounds = latin(data, bounds)
            words = Words(text, bounds, _LETTER, fold=False)
            raw = words.data.tobytes()
            for i, label in enumerate(rows.column(rows.schema.get_field_index("label")).to_pylist()):
                a, b = words.bounds[i], words.bounds[i + 1]
                own = {raw[s:e] for s, e in zip(words.starts[a:b].tolist(), words.ends[a:b].tolist()) if e - s <= MOST_LETTERS}
                for entry in {x for w in own for x in _features_of_word(w)}:
                    counts[entry, label] += 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())],
            ["entry", "label", "n"],
        )


def learn_lexicon(sample: DataFrame) -> list[tuple[bytes, float]]:
    """Every (entry, log odds) with support and odds: ``=word`` or ``^beginning``, best first.

    ``sample`` is a bounded table (text, label), so what is counted is bounded too.
    """
    sizes = dict(sample.groupBy("label").count().collect())
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return []
    counts = sample.select("text", "label").mapInArrow(_document_entries, "entry binary, label int, n bigint")
    totals = counts.groupBy("entry").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("b"),
    )
    odds = F.log((F.col("a") + 0.25) / (toxic + 0.5)) - F.log((F.col("b") + 0.25) / (clean + 0.5))
    best = (
        totals.filter(F.col("a") >= LEAST_DOCUMENTS)
        .withColumn("odds", odds)
        .filter(F.col("odds") >= LEAST_ODDS)
        .orderBy((F.col("odds") * F.col("a")).desc(), "entry")
    )
    return [(bytes(r["entry"]), float(r["odds"])) for r in best.select("entry", "odds").collect()]


class LexiconAutomaton:
    """The lexicon's trie intersected with the automaton of at most one edit.

    ``step[state, kind]`` leads on; state 0 is dead and 1 the start. A word that ends in a
    state has ``exact`` or else ``fuzzy`` weight (0: none); ``begun`` is the weight of a
    beginning that is complete on entering a state.
    """

    def __init__(self, lexicon: list[tuple[bytes, float]]):
        children: list[dict[int, int]] = [{}]
        whole: list[float] = [0.0]
        start: list[float] = [0.0]
        fuzzy = [False]
        for entry, weight in lexicon:
            node, path = 0, [0]
            for c in entry[1:]:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    whole.append(0.0)
                    start.append(0.0)
                    fuzzy.append(False)
                node = children[node][c]
                path.append(node)
            if entry[:1] == b"=":
                whole[node] = max(whole[node], weight)
                if len(entry) - 1 >= FUZZY_FROM:
                    for n in path:
                        fuzzy[n] = True
            else:
                start[node] = max(start[node], weight)
        long = [False] * len(children)
        for entry, _ in lexicon:
            if entry[:1] == b"=" and len(entry) - 1 >= FUZZY_FROM:
                node = 0
                for c in entry[1:]:
                    node = children[node][c]
                long[node] = True
        letters = sorted({c for x in children for c in x})
        self.kind = np.zeros(256, np.int32)
        self.kind[letters] = np.arange(1, len(letters) + 1)

        def closed(nodes: set) -> frozenset:
            out = set(nodes)
            for n, e in nodes:
                if e == 0:
                    out.update((m, 1) for m in children[n].values() if fuzzy[m])
            return frozenset((n, e) for n, e in out if e == 0 or (n, 0) not in out)

        def move(state: frozenset, c: int | None) -> frozenset:
            out = set()
            for n, e in state:
                if c in children[n] and (e == 0 or fuzzy[children[n][c]]):
                    out.add((children[n][c], e))
                if e == 0:
                    if fuzzy[n]:
                        out.add((n, 1))
                    out.update((m, 1) for x, m in children[n].items() if x != c and fuzzy[m])
            return closed(out)

        first = closed({(0, 0)})
        numbers = {frozenset(): 0, first: 1}
        queue, rows = [frozenset(), first], []
        for state in queue:
            row = []
            for c in [None, *letters]:
                to = move(state, c) if state else state
                if to not in numbers:
                    numbers[to] = len(queue)
                    queue.append(to)
                row.append(numbers[to])
            rows.append(row)
        self.step = np.array(rows, np.int32)
        self.exact = np.array([max([whole[n] for n, e in s if e == 0], default=0.0) for s in queue])
        self.fuzzy = np.array([max([whole[n] for n, e in s if e == 1 and long[n]], default=0.0) for s in queue])
        self.begun = np.array([max([start[n] for n, e in s if e == 0], default=0.0) for s in queue])

    def weigh(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """For each word the weight of its exact hit, and that of a hit with one edit."""
        n = len(words)
        state = np.ones(n, np.int32)
        exact, fuzzy = np.zeros(n), np.zeros(n)
        live = np.arange(n)
        depth = 0
        while len(live):
            ended = words.starts[live] + depth >= words.ends[live]
            done = live[ended]
            exact[done] = np.maximum(exact[done], self.exact[state[done]])
            fuzzy[done] = self.fuzzy[state[done]]
            live = live[~ended]
            to = self.step[state[live], self.kind[words.data[words.starts[live] + depth]]]
            state[live] = to
            begun = self.begun[to]
            hit = begun > 0
            exact[live[hit]] = np.maximum(exact[live[hit]], begun[hit])
            live = live[to > 0]
            depth += 1
        return exact, np.where(exact > 0, 0.0, fuzzy)


FEATURES = 7


def features(automaton: LexiconAutomaton, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Per row: sums of plain, quoted and misspelled hits, the best hit, the share of hits, hits, size."""
    n = len(rows) - 1
    text, rows = latin(data, rows)
    words = Words(text, rows, _LETTER, fold=False)
    out = np.zeros((n, FEATURES))
    exact, fuzzy = automaton.weigh(words)
    hits = np.flatnonzero((exact > 0) | (fuzzy > 0))
    out[:, 6] = np.log1p(words.counts)
    if not len(hits):
        return out
    of = np.searchsorted(words.bounds, hits, "right") - 1
    low, high = words.bounds[of], words.bounds[of + 1]
    a, b = np.maximum(hits - CONTEXT, low), np.minimum(hits + CONTEXT, high - 1)
    marks = np.concatenate([[0], np.cumsum(_QUOTE[text])])
    before = marks[words.starts[hits]] - marks[words.starts[a]]
    after = marks[words.ends[b]] - marks[words.ends[hits]]
    says = np.zeros(len(words) + 1, np.int64)
    raw = text.tobytes()
    near = np.unique(np.concatenate([np.arange(x, y) for x, y in zip(a.tolist(), hits.tolist())] + [np.zeros(0, np.int64)]).astype(np.int64))
    spoken = [raw[words.starts[i] : words.ends[i]].decode("latin-1") in SAYING for i in near.tolist()]
    says[near[np.array(spoken, bool)] + 1 if len(near) else near] = 1
    says = np.cumsum(says)
    quoted = ((before > 0) & (after > 0)) | (says[hits] > says[a])
    weight = exact[hits] + 0.5 * fuzzy[hits]
    add = lambda column, value: np.add.at(out[:, column], of, value)
    add(0, np.where(quoted, 0, exact[hits]))
    add(1, np.where(quoted, weight, 0))
    add(2, np.where(quoted, 0, fuzzy[hits]))
    np.maximum.at(out[:, 3], of, np.where(quoted, 0.5 * weight, weight))
    add(5, 1)
    out[:, 4] = out[:, 5] / np.maximum(words.counts, 1)
    out[:, :3] = np.log1p(out[:, :3])
    out[:, 4] = np.sqrt(out[:, 4])
    out[:, 5] = np.log1p(out[:, 5])
    return out


class Regression:
    """Logistic regression by Newton steps with a small ridge; labels weighted to their true share."""

    def __init__(self, x: np.ndarray, y: np.ndarray, share: float):
        self.prior = share
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = self._design(x)
        weight = np.where(y > 0, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
        self.beta = np.zeros(z.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ self.beta, -30, 30)))
            gradient = z.T @ (weight * (y - p)) - 1e-2 * len(y) / 100 * self.beta
            curve = (z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + np.eye(z.shape[1]) * 1e-2 * len(y) / 100
            step = np.linalg.solve(curve, gradient)
            self.beta += step
            if np.abs(step).max() < 1e-6:
                break

    def _design(self, x):
        z = (x - self.mean) / self.scale
        crossed = z[:, [3]] * z[:, [6]]
        return np.concatenate([np.ones((len(x), 1)), z, crossed], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.beta, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE):
    """The automaton and the regression, learned from at most ``sample`` labelled documents.

    Only documents with crc32(doc_id) mod 5 not 0 are learned from. The true share of
    label 1 is counted over all of them.
    """
    rows = labelled(docs, labels, label, sample, per_class=True)
    lexicon = learn_lexicon(rows)
    automaton = LexiconAutomaton(lexicon)
    shares = only(labels, "doc_id", label).filter(F.col(label).isin(0, 1) & ~in_part(F.col("doc_id"), 5, 0)).agg(F.avg(label)).first()[0]

    def run(batches):
        for batch in batches:
            for part, data, bounds in slices(batch, "text"):
                x = features(automaton, data, bounds)
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index("label")), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"]
                )

    found = rows.select("text", "label").mapInArrow(run, "label int, x array<double>").collect()
    y = np.array([r[0] for r in found], np.float64)
    if not len(y) or y.min() == y.max():
        return automaton, None, float(y.mean()) if len(y) else 0.0
    return automaton, Regression(np.array([r[1] for r in found]), y, float(shares)), float(shares)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted, hits.

    held_out is crc32(doc_id as text) mod 5 = 0 (false for a null id, which is not
    learned from either). A null or empty text has no hits and scores as such. Without
    labels of both kinds every text scores the share of label 1, without any label 0.
    Repeated rows give repeated rows, no documents none. Only doc_id and text of
    ``docs`` are read; a text is read whole.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        automaton, regression, prior = model.value
        for batch in batches:
            for rows, data, bounds in slices(batch, "text"):
                x = features(automaton, data, bounds)
                score = regression.scores(x) if regression else np.full(len(x), prior)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(score), pa.array(np.rint(np.expm1(x[:, 5])).astype(np.int64))], ["doc_id", "score", "hits"])

    scored = only(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, hits bigint")
    return scored.select(
        "doc_id", in_part(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits"
    )

"""A hashed maximum-entropy language model with a class-factored softmax.

log P(word | history) = log P(class | history) + log P(word | class). The class model is
a maximum-entropy model: hashed features of the history (the last word, the two last
words, and the words two and three back) each give every class a weight, and a softmax
over the few classes normalises. Within a class the model has the words' unigram feature
only, whose smoothed solution is closed: (c + 1) / (n + v + 1), with c the word's count,
n all counts of the class and v its words; the one left over is for unseen words.

Counts are gathered over the whole corpus: each block of documents asks a distributed
index for the counts of its distinct words. The class weights are trained by rounds of
distributed gradient updates: every task runs AdaGrad over its own documents from the
common weights, and the mean of the tasks' changes makes the next weights. Scoring works
on blocks of documents with sparse feature indexes in numpy.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import QUESTION, SUMMARY, Block, answer, blocks, bucket_bounds, buckets_for, each_block, questions, values, with_answers
from tessera.llm.words import Words, mix

MODULUS, HELD_OUT = 7, 2
#: Classes: the most frequent words have one each, all others one by their ending.
OWN_CLASS = 24
ENDINGS = 40
CLASSES = OWN_CLASS + ENDINGS
#: Rows of the weight table (at most 16 bits), and features of a history.
FEATURE_BITS = 14
FEATURES = 4
ROUNDS = 3
BATCH = 8192
RATE = 0.15
#: Rows of a feature in a batch up to which they are added with those of the other features.
SHORT_RUN = 16
#: Tokens whose logits stay in a core's cache while they are worked on.
CACHED = 1024
#: Logits of at most this size need no maximum taken off before the exponential.
SAFE_LOGIT = 60.0
#: The table travels in this many pieces.
PIECES = 16

_END = np.uint64(0xE0D0C0B0A0908070)
_BEFORE = np.uint64(0x1234567890ABCDEF)
_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True


class Tokens:
    """Tokens of a block, one end after each document: hash, ending class, document."""

    def __init__(self, block: Block):
        words = Words(block.data, block.rows)
        n, rows = len(words), len(words.counts)
        self.bounds = words.bounds + np.arange(rows + 1)
        self.counts = words.counts + 1
        place = np.arange(n) + words.row_of()
        self.hashes = np.full(n + rows, _END)
        self.hashes[place] = words.hashes()
        last = words.data[words.ends - 1].astype(np.uint64) if n else np.zeros(0, np.uint64)
        is_letter = _LETTER[last.astype(np.int64)]
        mark = np.where(is_letter, 0, np.where((last == 0x2C) | (last == 0x2E), 1, 2)).astype(np.uint64)
        stop = words.ends - (~is_letter).astype(np.int64)
        code = mark
        for back in (1, 2):
            at = stop - back
            inside = at >= words.starts
            code = code * np.uint64(257) + np.where(inside, words.data[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0)) if n else code
        self.ending = np.full(n + rows, OWN_CLASS, np.int64)
        self.ending[place] = OWN_CLASS + (mix(code) % np.uint64(ENDINGS)).astype(np.int64)
        self.row = np.repeat(np.arange(rows), self.counts)
        parts = [None if d is None else zlib.crc32(str(d).encode()) % MODULUS for d in block.doc_ids.to_pylist()]
        self.held_out = np.array([p == HELD_OUT for p in parts], bool)
        self.learn = np.array([p is not None and p != HELD_OUT for p in parts], bool)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes, the number of each token's, and where each occurs first."""
        keys, first, at = np.unique(self.hashes, return_index=True, return_inverse=True)
        return keys, at, first

    def classes(self, own: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Class of each token; ``own`` has the words with a class of their own, sorted, and their classes."""
        out = self.ending.copy()
        if len(own[0]):
            at = np.minimum(np.searchsorted(own[0], self.hashes), len(own[0]) - 1)
            mine = own[0][at] == self.hashes
            out[mine] = own[1][at[mine]]
        return out

    def features(self) -> np.ndarray:
        """Rows of the weight table that each token's history switches on."""
        n = len(self.hashes)
        depth = np.arange(n) - self.bounds[:-1][self.row] if n else np.zeros(0, np.int64)

        def back(k: int) -> np.ndarray:
            out = np.full(n, _BEFORE)
            out[k:] = self.hashes[:-k] if k < n else out[k:]
            return np.where(depth >= k, out, _BEFORE)

        one, two, three = back(1), back(2), back(3)
        pair = mix(one * np.uint64(3) + two)
        mask = np.uint64((1 << FEATURE_BITS) - 1)
        return np.stack([(mix(h, 10 + k) & mask).astype(np.int32) for k, h in enumerate((one, pair, two, three))], axis=1)


def _logits(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    out = weights.take(rows[:, 0], axis=0, out=out, mode="clip")
    for k in range(1, FEATURES):
        out += weights.take(rows[:, k], axis=0)
    out += bias
    return out


def _shares(logits: np.ndarray) -> np.ndarray:
    """Sums of the exponentials of each row, which are left in place of the logits."""
    np.exp(logits, out=logits)
    return np.einsum("ij->i", logits)


def _settle(logits: np.ndarray) -> np.ndarray:
    """The logits, in place, less their row's maximum where some are too large for an exponential."""
    if logits.size and max(logits.max(), -logits.min()) > SAFE_LOGIT:
        logits -= logits.max(axis=1, keepdims=True)
    return logits


def _softmax(logits: np.ndarray) -> np.ndarray:
    """Probabilities, in place of the logits."""
    total = _shares(_settle(logits))
    logits *= (1 / total)[:, None]
    return logits


def _log_softmax_at(logits: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax at one class a row; the logits are used up."""
    at = _settle(logits)[np.arange(len(logits)), classes]
    return at - np.log(_shares(logits))


def _run_sums(rows: np.ndarray, begin: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """Sums of the runs of ``rows``, taken in ``order``, that start at ``begin``; most runs are short, and added row by row for all at once."""
    order = np.arange(len(rows)) if order is None else order
    sizes = np.diff(begin, append=len(order))
    out = rows.take(order.take(begin), axis=0)
    for i in np.flatnonzero(sizes > SHORT_RUN):
        np.add.reduce(rows.take(order[begin[i] : begin[i] + sizes[i]], axis=0), axis=0, out=out[i])
    short = np.flatnonzero((sizes > 1) & (sizes <= SHORT_RUN))
    short = short[np.argsort(-sizes[short], kind="stable")]
    if len(short):
        # The longest come first, so those that have a row left are the beginning.
        more, at, left = rows.take(order.take(begin[short] + 1), axis=0), begin[short], sizes[short]
        for j in range(2, int(left[0])):
            n = np.searchsorted(-left, -j)
            more[:n] += rows.take(order.take(at[:n] + j), axis=0)
        out[short] += more
    return out


class ClassModel:
    """Weights of the class softmax: one row a hashed feature, and a bias that is fixed by counts."""

    def __init__(self, bias: np.ndarray):
        self.bias = bias.astype(np.float32)
        self.weights = np.zeros((1 << FEATURE_BITS, CLASSES), np.float32)

    def log_probability(self, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Natural logarithm of P(class | history)."""
        out = np.empty(len(classes))
        for a in range(0, len(classes), CACHED):
            b = a + CACHED
            out[a:b] = _log_softmax_at(_logits(self.weights, self.bias, rows[a:b]), classes[a:b])
        return out

    def learn(self, rows: np.ndarray, classes: np.ndarray, squares: np.ndarray) -> None:
        """One pass of AdaGrad over the tokens of a block."""
        for a in range(0, len(classes), BATCH):
            batch, own = rows[a : a + BATCH], classes[a : a + BATCH]
            gradient = np.empty((len(batch), CLASSES), np.float32)
            for c in range(0, len(batch), CACHED):
                _softmax(_logits(self.weights, self.bias, batch[c : c + CACHED], gradient[c : c + CACHED]))
            gradient[np.arange(len(batch)), own] -= 1
            for k in range(FEATURES):
                # Numbers of 16 bits are sorted by radix.
                feature = batch[:, k].astype(np.uint16)
                order = np.argsort(feature, kind="stable")
                ordered = feature.take(order)
                begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
                where = ordered.take(begin).astype(np.intp)
                total = _run_sums(gradient, begin, order)
                squares[where] += np.einsum("ij,ij->i", total, total) / CLASSES
                total *= (RATE / np.sqrt(squares[where] + 1.0))[:, None]
                now = self.weights.take(where, axis=0)
                now -= total
                self.weights[where] = now


def _asked(buckets: int):
    def run(batches):
        for block in each_block(batches):
            t = Tokens(block)
            keys, at, first = t.distinct()
            counts = np.bincount(at[t.learn[t.row]], minlength=len(keys)).astype(np.uint32)
            yield questions(block.number, bucket_bounds(keys, buckets), keys, counts, t.ending[first].astype(np.uint8))

    return run


_KINDS = (np.uint64, np.uint32, np.uint8)


def _total_counts(own: np.ndarray, keys: np.ndarray, counts: np.ndarray, ending: np.ndarray) -> np.ndarray:
    distinct, at = np.unique(keys, return_inverse=True)
    return np.bincount(at, counts, len(distinct)).astype(np.uint64)[at]


def _bucket_statistics(keys: np.ndarray, counts: np.ndarray, ending: np.ndarray) -> bytes:
    """Of a bucket: tokens and words by ending class, and its most frequent words."""
    distinct, first, at = np.unique(keys, return_index=True, return_inverse=True)
    total = np.bincount(at, counts, len(distinct))
    seen = total > 0
    ending = ending[first]
    tokens = np.bincount(ending[seen], total[seen], CLASSES)
    words = np.bincount(ending[seen], minlength=CLASSES)
    top = np.argsort(-total, kind="stable")[:OWN_CLASS]
    top = top[seen[top]]
    rows = [(c, tokens[c], words[c]) for c in np.flatnonzero(words)]
    return np.array([(-1, *r) for r in rows] + [(distinct[i].view(np.int64), 0, total[i], ending[i]) for i in top], np.int64).reshape(-1, 4).tobytes()


_STATISTICS = "key bigint, class bigint, tokens bigint, words bigint"


def _statistics_rows(batches):
    for batch in batches:
        for payload in batch.column("payload"):
            rows = np.frombuffer(payload.as_buffer(), np.int64).reshape(-1, 4)
            is_word = rows[:, 0] != -1
            # Of a word: its key, its ending class, its count. Of a class: tokens and words.
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows[:, 0], mask=~is_word),
                    pa.array(np.where(is_word, rows[:, 3], rows[:, 1])),
                    pa.array(rows[:, 2]),
                    pa.array(np.where(is_word, 1, rows[:, 3])),
                ],
                ["key", "class", "tokens", "words"],
            )


class Counts:
    """What is common to all documents: tokens, words, and both by class."""

    def __init__(self, told: DataFrame):
        found = told.filter(F.col("block") == SUMMARY).select("payload").mapInArrow(_statistics_rows, _STATISTICS)
        classes = found.filter("key is null").groupBy("class").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).collect()
        top = found.filter("key is not null").orderBy(F.col("tokens").desc(), "key").limit(OWN_CLASS).collect()
        self.in_class, self.words_of = np.zeros(CLASSES), np.zeros(CLASSES)
        for r in classes:
            self.in_class[r["class"]], self.words_of[r["class"]] = r["tokens"], r["words"]
        self.tokens, self.words = int(self.in_class.sum()), int(self.words_of.sum())
        keys = np.array([r["key"] for r in top], np.int64).view(np.uint64)
        order = np.argsort(keys)
        self.own = keys[order], order
        for c, r in enumerate(top):
            self.in_class[c], self.words_of[c] = r["tokens"], 1
            self.in_class[r["class"]] -= r["tokens"]
            self.words_of[r["class"]] -= 1
        self.room = self.in_class + self.words_of + 1

    def bias(self) -> np.ndarray:
        return np.log((self.in_class + 0.5) / (self.tokens + 0.5 * CLASSES))


def _train_round(found: DataFrame, counts: Counts, model: ClassModel, part: int, rounds: int, groups: int) -> np.ndarray:
    """Mean change of the weights over the tasks that learn from this round's blocks.

    A piece is summed over the tasks of each of ``groups`` groups, then over the groups.
    """
    shared = found.sparkSession.sparkContext.broadcast((counts.own, model))
    mine = found.filter(F.pmod(F.xxhash64("block"), F.lit(rounds)) == part)

    def run(batches):
        own, common = shared.value
        local = ClassModel(common.bias)
        local.weights = common.weights.copy()
        squares = np.zeros(len(local.weights), np.float32)
        for block in each_block(batches):
            t = Tokens(block)
            use = t.learn[t.row]
            local.learn(t.features()[use], t.classes(own)[use], squares)
        change = (local.weights - common.weights).astype(np.float16)
        # Only rows that moved count in the mean.
        moved = (squares > 0).astype(np.float16)[:, None]
        piece = np.split(np.concatenate([change, moved], axis=1), PIECES)
        group = TaskContext.get().partitionId() % groups
        if squares.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(PIECES, dtype=np.int32)), pa.array(np.full(PIECES, group, np.int32)), pa.array([p.tobytes() for p in piece], pa.binary())],
                ["piece", "tasks", "change"],
            )

    def adder(kind):
        def add(table: pa.Table) -> pa.Table:
            total = 0
            for p in table.column("change"):
                total = total + np.frombuffer(p.as_buffer(), kind).astype(np.float64)
            return pa.table({"piece": table.column("piece").slice(0, 1), "change": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

        return add

    changes = mine.mapInArrow(run, "piece int, tasks int, change binary")
    sums = changes.groupBy("piece", "tasks").applyInArrow(adder(np.float16), "piece int, change binary")
    sums = sums.groupBy("piece").applyInArrow(adder(np.float32), "piece int, change binary")
    out = np.zeros((PIECES, (1 << FEATURE_BITS) // PIECES, CLASSES + 1))
    for r in sums.collect():
        out[r["piece"]] = np.frombuffer(r["change"], np.float32).reshape(out.shape[1:])
    out = out.reshape(1 << FEATURE_BITS, CLASSES + 1)
    return (out[:, :-1] / np.maximum(out[:, -1:], 1)).astype(np.float32)


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words split at space and 0x09 to 0x0D after A to Z are lower-cased, and
    one end a document; a null or empty text is just its end. The model learns from rows
    whose crc32(doc_id as text) mod 7 is not 2; a null id is neither learned from nor
    held out. base_score is the add-one unigram log10 probability, score the model's.
    Repeated rows are counted and scored as often as they occur. With nothing to learn
    from, counts are zero and every class is as likely. No documents give no rows. Words
    are told apart by a 64-bit hash.

    Broadcast and collected are the weight table (``FEATURE_BITS``, ``CLASSES``) and the
    class sums, whatever the input; word counts stay on the cluster.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = blocks(docs)
    buckets = buckets_for(found)
    told = answer(found.mapInArrow(_asked(buckets), QUESTION), _KINDS, _total_counts, pack=False, summary=_bucket_statistics)
    counts = Counts(told)
    model = ClassModel(counts.bias())
    for part in range(rounds):
        model.weights += _train_round(found, counts, model, part, rounds, max(4, math.isqrt(buckets)))
    shared = docs.sparkSession.sparkContext.broadcast((counts.own, counts.room, counts.tokens, counts.words, model))

    def run(batches):
        own, room, tokens, words, trained = shared.value
        for block in each_block(batches):
            t = Tokens(block)
            keys, at, _ = t.distinct()
            count = values(bucket_bounds(keys, buckets), block.told("counts"), np.uint64)[at].astype(np.float64)
            classes = t.classes(own)
            plain = np.log10(count + 1)
            scored = plain - np.log10(room)[classes] + trained.log_probability(t.features(), classes) / np.log(10)
            add = lambda v: np.add.reduceat(v, t.bounds[:-1]) if len(t.counts) else v
            yield pa.RecordBatch.from_arrays(
                [
                    block.doc_ids,
                    pa.array(t.held_out),
                    pa.array(t.counts.astype(np.int64)),
                    pa.array(add((count > 0).astype(np.int64))),
                    pa.array(np.full(len(t.counts), tokens, np.int64)),
                    pa.array(add(plain) - t.counts * np.log10(tokens + words + 1)),
                    pa.array(add(scored)),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return with_answers(found, counts=told).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    )

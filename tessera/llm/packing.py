"""Packing of token streams into sequences by order-preserving dynamic programming.

Documents keep their order. A sequence is a window of the stream; windows may be cut at
document ends, at sentence ends, and every ``FORCED_GAP`` ids inside a longer sentence.
Cuts are chosen to minimise padding plus a penalty for cuts inside a document, over all
ways to cut a stretch of the stream. With ``g`` the cost of a cut plus its position, the
cheapest predecessor is the minimum of ``g`` over the cuts at most one sequence back,
which a monotone queue hands over in constant time.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import only
from tessera.llm.words import Words, slices

SEQUENCE = 2048
END_ID = 1
#: Penalties in padding ids: a cut at a sentence end, a cut inside a sentence.
SENTENCE_CUT = 4
FORCED_CUT = 16
FORCED_GAP = 16
#: Ids over which one run of the dynamic programme looks; its last window is carried on.
STRETCH = 1 << 17
CACHED_WORDS = 1_000_000
#: Bytes of text that are encoded at once.
RUN = 1 << 20

_codes = np.arange(256)
#: Punctuation that never joins the letter or digit before it, nor a special token.
_TRAILING = np.isin(_codes, list(b".,;:!?&%$#*"))
_ASCII_WORD = ((_codes >= 0x61) & (_codes <= 0x7A)) | ((_codes >= 0x30) & (_codes <= 0x39))
#: Bytes of the letters a to z and, after 0xC3, of the lower-case letters up to U+00FF.
_LETTER_BYTE = ((_codes >= 0x61) & (_codes <= 0x7A)) | (_codes == 0xC3) | ((_codes >= 0x9F) & (_codes <= 0xBF) & (_codes != 0xB7))
#: Byte-level models show each byte as a character: those that print as themselves, the
#: rest as U+0100 and following, in order.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SHOWN = np.arange(256, dtype="<u2")
_SHOWN[np.setdiff1d(_codes, _PRINTED)] = 0x100 + np.arange(256 - len(_PRINTED))
_SENTENCE_END = np.isin(_codes, list(b".!?"))
_MOST_TRAILING = 6


class WordTokenizer:
    """Token ids of texts, by unit: a word, or its trailing punctuation on its own.

    The tokenizer drops white space and splits letters from punctuation, so a text's ids
    are those of its units one after the other, and each different unit is encoded once
    a worker. Units are told apart by a 64-bit hash. What is known is kept as sorted
    hashes with their places in one array of ids, and forgotten beyond ``CACHED_WORDS``.

    A unit of lower-case letters up to U+00FF, or of plain punctuation, is one pre-token
    that normalisation leaves as it is, and goes to the tokenizer's model directly, each
    byte as the character that stands for it; all others take the whole way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.place = np.zeros((0, 2), np.uint32)  # first id and number of ids
        self.ids = np.zeros(0, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)

    def _learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw, found = data.tobytes(), [None] * len(hashes)
        tokenize, shown = self.model.tokenize, _SHOWN[data].tobytes().decode("utf-16-le")
        odd = np.concatenate([[0], np.cumsum(~_LETTER_BYTE[data])])
        marks = np.concatenate([[0], np.cumsum(~_TRAILING[data])])
        simple = (odd[ends] == odd[starts]) | (marks[ends] == marks[starts])
        at = np.flatnonzero(simple)
        for k, a, b in zip(at.tolist(), starts[at].tolist(), ends[at].tolist()):
            found[k] = [t.id for t in tokenize(shown[a:b])]
        whole = np.flatnonzero(~simple).tolist()
        texts = [raw[starts[k] : ends[k]].decode() for k in whole]
        for k, e in zip(whole, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            found[k] = e.ids
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        first = len(self.ids) + np.cumsum(sizes) - sizes
        self.ids = np.concatenate([self.ids, np.fromiter((i for ids in found for i in ids), self.ids.dtype, int(sizes.sum()))])
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.place = np.insert(self.place, at, np.stack([first, sizes], 1), axis=0)

    def encode(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of consecutive rows, the end of each row in ids, and the sentence ends in ids."""
        # A special token is matched in its own case only.
        fold = b"<|" not in data.tobytes()
        words = Words(data, rows, fold=fold)
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(rows) - 1, np.int64), np.zeros(0, np.int64)
        core = words.ends.copy()
        for _ in range(_MOST_TRAILING):
            core -= _TRAILING[words.data[core - 1]] & (core - 1 > words.starts)
        split = (core < words.ends) & _ASCII_WORD[words.data[core - 1]]
        core = np.where(split, core, words.ends)
        extra = np.cumsum(split) - split
        n = len(words) + int(split.sum())
        unit_starts, unit_ends = np.empty(n, np.int64), np.empty(n, np.int64)
        first = np.arange(len(words)) + extra
        unit_starts[first], unit_ends[first] = words.starts, core
        unit_starts[first[split] + 1], unit_ends[first[split] + 1] = core[split], words.ends[split]
        ends_sentence = _SENTENCE_END[words.data[words.ends - 1]]
        last_unit = first + split
        words.starts, words.ends = unit_starts, unit_ends
        distinct, example, unit = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.known) > CACHED_WORDS:
            self.forget()
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != distinct[inside]
        if new.any():
            self._learn(distinct[new], words.data, unit_starts[example[new]], unit_ends[example[new]])
            at = np.searchsorted(self.known, distinct)
        begins, lengths = self.place[at].astype(np.int64).T
        sizes = lengths[unit]
        unit_to = np.cumsum(sizes)
        ids = self.ids[np.repeat(begins[unit] - (unit_to - sizes), sizes) + np.arange(int(unit_to[-1]))].astype(np.uint32)
        word_to = unit_to[last_unit]
        row_to = np.concatenate([[0], word_to])[words.bounds[1:]]
        return ids, row_to, word_to[ends_sentence]


def choose_cuts(positions: list[int], penalties: list[int], size: int = SEQUENCE) -> list[int]:
    """Positions at which the cheapest cutting of [positions[0], positions[-1]] cuts.

    ``positions`` ascend by at most ``size``; the first and last are always cut.
    """
    cost = [positions[0]]
    back = [0]
    queue: deque[int] = deque([0])
    for j in range(1, len(positions)):
        low = positions[j] - size
        while positions[queue[0]] < low:
            queue.popleft()
        best = queue[0]
        value = size + penalties[j] + cost[best]
        cost.append(value)
        back.append(best)
        while queue and cost[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(positions) - 1
    while j:
        cuts.append(positions[j])
        j = back[j]
    cuts.append(positions[0])
    return cuts[::-1]


class Stretch:
    """Documents, or the rest of one, that wait to be cut."""

    def __init__(self):
        self.ids: list[np.ndarray] = []
        self.sentences: list[np.ndarray] = []
        self.docs: list[tuple] = []  # doc_id, ids before, ids here, ids of the document
        self.size = 0

    def add(self, doc_id, before: int, ids: np.ndarray, sentences: np.ndarray, total: int) -> None:
        self.ids.append(ids)
        self.sentences.append(sentences + self.size)
        self.docs.append((doc_id, before, len(ids), total))
        self.size += len(ids)

    def cut(self, last: bool) -> tuple[list[tuple], Stretch]:
        """Pieces of all windows but the last, which is carried on unless ``last``."""
        ids = np.concatenate(self.ids)
        doc_to = np.cumsum([d[2] for d in self.docs])
        sentences = np.concatenate(self.sentences)
        sentences = sentences[(sentences > 0) & (sentences < self.size - 1)]
        penalty = np.full(self.size + 1, -1, np.int16)
        penalty[sentences] = SENTENCE_CUT
        penalty[doc_to - 1] = -1  # never leave the end id alone
        penalty[doc_to] = 0
        penalty[0] = 0
        place = np.arange(self.size + 1)
        since = place - np.maximum.accumulate(np.where(penalty >= 0, place, 0))
        inner = (penalty < 0) & (since % FORCED_GAP == 0)
        inner[doc_to - 1] = False
        penalty[inner] = FORCED_CUT
        places = np.flatnonzero(penalty >= 0)
        cuts = choose_cuts(places.tolist(), penalty[places].tolist())
        rest = Stretch()
        end = self.size
        if not last and len(cuts) > 2:
            end = cuts[-2]
            cuts.pop()
        elif last:
            cuts = _split_tail(cuts)
        edges = np.unique(np.concatenate([cuts, doc_to[doc_to < end]]))
        doc_from = doc_to - [d[2] for d in self.docs]
        owner = np.searchsorted(doc_to, edges[:-1], "right")
        window = np.searchsorted(cuts, edges[:-1], "right") - 1
        pieces = []
        for a, b, d, w in zip(edges[:-1].tolist(), edges[1:].tolist(), owner.tolist(), window.tolist()):
            doc_id, before, _, total = self.docs[d]
            pieces.append((doc_id, before + a - int(doc_from[d]), b - a, ids[a:b].tobytes(), total, w, a - cuts[w]))
        if end < self.size:
            for d in range(int(np.searchsorted(doc_to, end, "right")), len(self.docs)):
                a, b = max(end, int(doc_from[d])), int(doc_to[d])
                doc_id, before, _, total = self.docs[d]
                inside = sentences[(sentences > a) & (sentences < b)]
                rest.add(doc_id, before + a - int(doc_from[d]), ids[a:b], inside - a, total)
        return pieces, rest


def _split_tail(cuts: list[int]) -> list[int]:
    """The last window as powers of two, which need no padding, where that is cheaper."""
    a, b = cuts[-2], cuts[-1]
    parts = [1 << k for k in reversed(range(12)) if (b - a) >> k & 1]
    if SEQUENCE - (b - a) <= FORCED_CUT * (len(parts) - 1):
        return cuts
    return cuts[:-1] + [a + s for s in np.cumsum(parts).tolist()]


_SCHEMA = "start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
_tokenizers: dict[str, WordTokenizer] = {}


def _packer(path: str, stretch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tokenizers:
            _tokenizers[path] = WordTokenizer(path)
        tokenizer = _tokenizers[path]
        base = TaskContext.get().partitionId() << 40
        waiting, sequences = Stretch(), 0

        def rows(last: bool) -> pa.RecordBatch:
            nonlocal waiting, sequences
            pieces, waiting = waiting.cut(last)
            columns = list(zip(*pieces)) if pieces else [()] * 7
            numbers = np.array(columns[5], np.int64) + sequences + base
            sequences = int(numbers[-1]) + 1 - base if len(numbers) else sequences
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], kind),
                    pa.array(columns[1], pa.int64()),
                    pa.array(columns[2], pa.int64()),
                    pa.array(columns[3], pa.binary()),
                    pa.array(columns[4], pa.int64()),
                    pa.array(numbers),
                    pa.array(columns[6], pa.int64()),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for part, data, bounds in slices(batch, "text", RUN):
                ids, row_to, sentences = tokenizer.encode(data, bounds)
                row_from = np.concatenate([[0], row_to[:-1]])
                from_s = np.searchsorted(sentences, row_from, "right")
                to_s = np.searchsorted(sentences, row_to, "right")
                for doc_id, a, b, s, t in zip(part.column(0).to_pylist(), row_from.tolist(), row_to.tolist(), from_s.tolist(), to_s.tolist()):
                    own = np.append(ids[a:b], np.uint32(END_ID)).astype(np.uint32)
                    waiting.add(doc_id, 0, own, sentences[s:t] - a, len(own))
                    if waiting.size >= stretch:
                        yield rows(False)
        if waiting.size:
            yield rows(True)

    return run


def pack(docs: DataFrame, tokenizer: str, stretch: int = STRETCH) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids, in the order of doc_id.

    Returns doc_id, start, length, ids, doc_tokens, sequence_id, offset; ``ids`` are
    little-endian unsigned 32-bit ids. Every document, a null or empty one too, ends
    with id 1, so it has at least one piece.
    Documents are dealt to tasks by ranges of doc_id; a task packs its range for itself
    and numbers its sequences from its own base. Null ids come first; rows with the same
    id are spread and ordered by a hash of the text and packed one by one. No documents
    give no rows. Only doc_id and text are read. A very long document is held as ids
    once, four bytes each.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = only(docs, "doc_id", "text").withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return rows.mapInArrow(_packer(tokenizer, stretch), f"doc_id {kind}, {_SCHEMA}")

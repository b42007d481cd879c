"""Line-first cleaning: rules per line, failing lines go, then documents that lose too much.

Every line with a word is judged by itself for punctuation, navigation and boilerplate.
What remains is the cleaned text; a document whose lost words are too large a share of
its words is rejected, as is one that fails the two base rules. All counts are over the
whole text, with numpy over the bytes of a batch: no row is looked at twice, nothing is
shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import only
from tessera.llm.words import SPACE_SEPARATED, Words, gram_hashes, slices

# The base rules, and the characters that count as symbols.
BASE_WORDS = 50
BASE_REPEATED = 50
WINDOW = 3
SYMBOLS = b"#*$%&|<>"

# Phrases that mark a line as boilerplate, in lower case.
PHRASES = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "use of cookies",
    "enable javascript", "lorem ipsum", "sign up for our newsletter", "click here", "read more", "powered by",
    "tous droits réservés", "todos los derechos reservados", "alle rechte vorbehalten", "todos os direitos reservados",
)
# Words that stand between the entries of a menu or a path.
SEPARATORS = ("|", ">", "»", "›", "·", "•", "::")


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules and of the loss; shares are percentages of a line's words.

    symbols: words that hold a symbol. shouted: words that end in ``!!`` or ``??``.
    capitals: words of two or more letters A-Z without one of a-z, in lines of
    ``capital_words`` words or more. separators: words that only separate entries, in lines
    with at least two of them. ``lost`` is the share of a document's words that may go.
    """

    symbols: int = 20
    shouted: int = 20
    capitals: int = 60
    capital_words: int = 4
    separators: int = 15
    lost: int = 50


PHRASE = re.compile(b"|".join(re.escape(p.encode()) for p in PHRASES))
LOWER = np.arange(256).astype(np.uint8)
LOWER[0x41:0x5B] += 32
_LINE = np.arange(256) != 0x0A
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def _sums(flags: np.ndarray) -> np.ndarray:
    """Totals before each place, so that a range's count is a difference."""
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _seen_before(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """True where an earlier entry of the same row has the same value."""
    order = np.lexsort((np.arange(len(row)), value, row))
    out = np.zeros(len(row), bool)
    same = (row[order][1:] == row[order][:-1]) & (value[order][1:] == value[order][:-1])
    out[order[1:][same]] = True
    return out


def _in_repeats(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Words inside a window that is found twice or more in its row."""
    starts = words.window_starts(WINDOW)
    found = np.zeros(len(words) + 1, np.int64)
    if len(starts):
        row, gram = words.row_of()[starts], gram_hashes(hashes, WINDOW)[starts]
        order = np.lexsort((gram, row))
        same = np.zeros(len(starts) + 1, bool)
        same[1:-1] = (row[order][1:] == row[order][:-1]) & (gram[order][1:] == gram[order][:-1])
        twice = starts[order[same[1:] | same[:-1]]]
        np.add.at(found, twice, 1)
        np.add.at(found, twice + WINDOW, -1)
    return np.cumsum(found)[:-1] > 0


_separator_hashes: list[np.ndarray] = []


def _separators() -> np.ndarray:
    if not _separator_hashes:
        text = " ".join(SEPARATORS).encode()
        data = np.frombuffer(text, np.uint8)
        _separator_hashes.append(np.sort(Words(data, np.array([0, len(data)]), fold=False).hashes()))
    return _separator_hashes[0]


def failing_lines(data: np.ndarray, rows: np.ndarray, words: Words, hashes: np.ndarray, rules: Rules):
    """Lines with a word (``Words`` whose words are lines), their word bounds, and which fail."""
    lines = Words(data, rows, _LINE, fold=False)
    first = np.searchsorted(words.starts, lines.starts)
    last = np.searchsorted(words.starts, lines.ends)
    n = last - first
    symbols, upper, lower = _sums(_SYMBOL[data]), _sums((data >= 0x41) & (data <= 0x5A)), _sums((data >= 0x61) & (data <= 0x7A))
    of_word = lambda sums: sums[words.ends] - sums[words.starts]
    end = data[words.ends - 1] if len(words) else data[:0]
    before = data[np.maximum(words.ends - 2, 0)] if len(words) else data[:0]
    shouted = ((end == 0x21) | (end == 0x3F)) & (end == before) & (words.ends - words.starts >= 2)
    capitals = (of_word(upper) >= 2) & (of_word(lower) == 0)
    between = np.isin(hashes, _separators())

    def share(flags: np.ndarray, limit: int) -> np.ndarray:
        sums = _sums(flags)
        return 100 * (sums[last] - sums[first]) > limit * n

    separators = _sums(between)
    navigation = share(between, rules.separators) & (separators[last] - separators[first] >= 2)
    punctuation = share(of_word(symbols) > 0, rules.symbols) | share(shouted, rules.shouted)
    punctuation |= share(capitals, rules.capitals) & (n >= rules.capital_words)
    repeated = _seen_before(lines.row_of(), lines.hashes())
    phrase = np.zeros(len(lines), bool)
    if len(lines):
        at = np.fromiter((m.start() for m in PHRASE.finditer(LOWER[data].tobytes())), np.int64)
        phrase[np.searchsorted(lines.starts, at, "right") - 1] = True
    return lines, first, last, repeated & (n > 0), (n > 0) & (navigation | punctuation | repeated | phrase)


def _clean(rules: Rules):
    def run(batches):
        for batch in batches:
            for part, data, rows in slices(batch, "text"):
                yield _cleaned(part, data, rows, rules)

    return run


def _cleaned(part: pa.RecordBatch, data: np.ndarray, rows: np.ndarray, rules: Rules) -> pa.RecordBatch:
    words = Words(data, rows, SPACE_SEPARATED, fold=False)
    hashes = words.hashes()
    lines, first, last, repeated, fails = failing_lines(data, rows, words, hashes, rules)
    by_row = lambda sums, bounds: sums[bounds[1:]] - sums[bounds[:-1]]
    letters = _sums((data & 0xC0) != 0x80)
    n_words = words.counts.astype(np.int64)
    n_repeat = by_row(_sums(_in_repeats(words, hashes)), words.bounds)
    lost = by_row(_sums(np.where(fails, last - first, 0)), lines.bounds)
    failed = (n_words < BASE_WORDS) | (100 * n_repeat > BASE_REPEATED * n_words)
    kept = ~failed & (100 * lost <= rules.lost * n_words)
    texts = []
    stays = ~fails & (last > first)
    for a, b in zip(lines.bounds[:-1].tolist(), lines.bounds[1:].tolist()):
        own = np.flatnonzero(stays[a:b]) + a
        texts.append(b"\n".join(data[s:e].tobytes() for s, e in zip(lines.starts[own].tolist(), lines.ends[own].tolist())))
    columns = {
        "n_words": n_words,
        "word_chars": by_row(_sums(letters[words.ends] - letters[words.starts]), words.bounds),
        "n_symbols": by_row(_sums(_SYMBOL[data]), rows),
        "n_dup_lines": by_row(_sums(repeated), lines.bounds),
        "n_repeat_words": n_repeat,
        "base_failed": failed,
        "kept": kept,
        "n_lines": by_row(_sums(last > first), lines.bounds),
        "n_lines_removed": by_row(_sums(fails), lines.bounds),
        "n_words_removed": lost,
    }
    arrays = [part.column(0), *(pa.array(v) for v in columns.values()), pa.array(texts, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", *columns, "cleaned"])


_SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, n_lines bigint, n_lines_removed bigint, n_words_removed bigint, cleaned string"
)


def clean_lines(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per row of ``docs``: doc_id, its counts, base_failed, kept, and the cleaned text.

    ``cleaned`` holds the lines that passed, joined by newlines, also of rejected
    documents. Lines are cut at ``\\n``; one without a word is dropped without being
    counted. A null or empty text has no words: it fails the base rules and its cleaned
    text is empty. Of equal lines in one text the first may stay. Repeated rows give
    repeated rows, no documents none; a null id stays null. Only doc_id and text are read.
    A text is held in memory once with some eight times its size of counts.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return only(docs, "doc_id", "text").mapInArrow(_clean(rules), f"doc_id {kind}, {_SCHEMA}")


def keep_clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The columns doc_id and text of kept documents, the text cleaned; see ``clean_lines``."""
    return clean_lines(docs, rules).filter("kept").selectExpr("doc_id", "cleaned as text")

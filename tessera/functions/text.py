"""Text helpers as Column functions with Python-compatible semantics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# The code points Python treats as white space and as line ends.
# Both classes are written so that Java and RE2 read them the same way.
WS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
EOL_SET = r"\n\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"
EOL = rf"(?:\r\n|[\r{EOL_SET}])"
WORD = r"[\p{L}\p{N}_]+"
# The same characters as a plain string, for Spark's trim functions.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
# White space that is no line end, then a line end, then the rest of the run.
BREAK = rf"(?<!{WS})[\t\x1f\x20\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}]*+[\r{EOL_SET}]{WS}*+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    Without this a nested expression that mentions an array several times is
    evaluated once per mention.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that is computed once per row.

    A plain column may be computed again by every filter that Spark pushes below
    it. Filters are not pushed through a generator, so this one is not.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(WS_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WS_CHARS))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def collapse(c: Column) -> Column:
    """Trim and turn every run of white space into one space."""
    return F.regexp_replace(strip(c), rf"{WS}+", " ")


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def split_words(c: Column) -> Column:
    """White-space separated words, without empty ones."""
    # No white space is a visible ASCII character: most characters need one comparison.
    return F.array_remove(F.split(c, rf"(?![!-~]){WS}+"), "")


def lines(c: Column) -> Column:
    """Lines without their ends; a final line end opens no extra line."""
    body = F.regexp_replace(c, rf"{EOL}\z", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(body, EOL, -1))


def lines_with_ends(c: Column) -> Column:
    """Lines that keep their ends, so that joining them gives the text back."""
    cut = rf"(?<=[{EOL_SET}])|(?<=\r)(?!\n)"
    return F.filter(F.split(c, cut, -1), lambda x: x != "")


def contains_any(c: Column, needles: list[str] | tuple[str, ...]) -> Column:
    """True when any literal needle occurs in ``c``.

    Few needles are looked for one by one, which beats a regex on long texts;
    many go into one alternation.
    """
    if len(needles) > 16:
        return c.rlike("|".join(_quote(n) for n in needles))
    return reduce(lambda found, n: found | F.contains(c, F.lit(n)), needles[1:], F.contains(c, F.lit(needles[0])))


def count_hits(c: Column, needles: list[str] | tuple[str, ...]) -> Column:
    """How many of the literal needles occur in ``c``."""
    total = F.lit(0)
    for needle in needles:
        total = total + F.contains(c, F.lit(needle)).cast("int")
    return total


def _quote(literal: str) -> str:
    return "".join("\\" + ch if ch in r"\.[]{}()*+-?^$|/#&~" else ch for ch in literal)


quote_literal = _quote


def unique_trimmed(items: Column, cap: int | None = None) -> Column:
    """Trim, drop blanks, keep first occurrences, then keep the first ``cap``."""
    kept = F.array_distinct(F.filter(F.transform(items, strip), lambda x: x != ""))
    return F.slice(kept, 1, cap) if cap is not None else kept

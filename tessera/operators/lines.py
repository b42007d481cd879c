"""Line dedupe, white-space clean-up and the statistics about them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tessera.functions.text import WS, let, lines, lines_with_ends, rstrip, strip

# Lines shorter than this are always kept; the page marker.
MIN_LINE_LENGTH = 5
PAGE_MARK = "--- PAGE START:"


def kept_lines(c: Column, min_length: int = MIN_LINE_LENGTH) -> Column:
    """Lines (with ends) left after dropping repeats anywhere in the text.

    Repeats are found by sorting the lines of the one text, so the cost is
    n log n inside the row and nothing is shuffled.
    """
    tagged = F.transform(
        lines_with_ends(c),
        lambda x, i: F.struct(rstrip(x).alias("key"), i.alias("at"), x.alias("line")),
    )

    def pick(all_lines: Column) -> Column:
        long_lines = F.sort_array(F.filter(all_lines, lambda p: F.length(p["key"]) >= min_length))
        firsts = let(
            long_lines,
            lambda s: F.filter(
                s, lambda p, j: (j == 0) | (p["key"] != F.get(s, j - 1)["key"])
            ),
        )
        short = F.filter(all_lines, lambda p: F.length(p["key"]) < min_length)
        by_place = F.transform(
            F.concat(firsts, short), lambda p: F.struct(p["at"].alias("at"), p["line"].alias("line"))
        )
        return F.transform(F.sort_array(by_place), lambda p: p["line"])

    return let(tagged, pick)


def kept_lines_consecutive(c: Column, min_length: int = MIN_LINE_LENGTH) -> Column:
    """Lines left after dropping those equal to the line before; short lines reset."""
    tagged = F.transform(
        lines_with_ends(c), lambda x: F.struct(rstrip(x).alias("key"), x.alias("line"))
    )
    return let(
        tagged,
        lambda ls: F.transform(
            F.filter(
                ls,
                lambda p, i: (F.length(p["key"]) < min_length)
                | (i == 0)
                | (p["key"] != F.get(ls, i - 1)["key"]),
            ),
            lambda p: p["line"],
        ),
    )


def dedupe_lines(c: Column, scope: str = "document", min_length: int = MIN_LINE_LENGTH) -> Column:
    """Text without repeated lines; ``scope`` is ``document`` or ``consecutive``."""
    if scope == "document":
        return F.array_join(kept_lines(c, min_length), "")
    if scope == "consecutive":
        return F.array_join(kept_lines_consecutive(c, min_length), "")
    raise ValueError(f"unknown scope: {scope}")


def normalize_whitespace(c: Column) -> Column:
    """Cut line ends, end every line in a newline, keep at most two blank lines."""
    trimmed = F.array_join(
        F.transform(lines(c), lambda x: F.concat(rstrip(x), F.lit("\n"))), ""
    )
    return F.regexp_replace(F.regexp_replace(trimmed, r"\A\n{3,}", "\n\n"), r"\n{4,}", "\n\n\n")


def clean_text(c: Column, scope: str = "document") -> Column:
    """Line dedupe followed by white-space clean-up."""
    return normalize_whitespace(dedupe_lines(c, scope))


def dedupe_stats(c: Column) -> Column:
    """Struct of line and character counts before and after cleaning."""

    def build(kept: Column) -> Column:
        deduped = F.array_join(kept, "")
        return let(
            F.struct(
                F.size(lines_with_ends(c)).cast("long").alias("before"),
                F.size(kept).cast("long").alias("after"),
                F.length(deduped).cast("long").alias("deduped_chars"),
                F.length(normalize_whitespace(deduped)).cast("long").alias("final_chars"),
            ),
            lambda n: F.struct(
                n["before"].alias("original_lines"),
                n["after"].alias("unique_lines"),
                (n["before"] - n["after"]).alias("removed_lines"),
                _percent(n["before"] - n["after"], n["before"]).alias("removed_percent"),
                F.length(c).cast("long").alias("original_chars"),
                n["deduped_chars"].alias("deduped_chars"),
                n["final_chars"].alias("final_chars"),
                _percent(F.length(c) - n["final_chars"], F.length(c)).alias("reduction_percent"),
            ),
        )

    return let(kept_lines(c), build)


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def content_quality(c: Column) -> Column:
    """Struct of the fourteen character and line counts of a text."""

    def count(pattern: str) -> Column:
        return F.regexp_count(c, F.lit(pattern)).cast("long")

    def build(ls: Column) -> Column:
        repeats = F.size(
            F.filter(ls, lambda x, i: (i > 0) & (x == F.get(ls, i - 1)) & (strip(x) != ""))
        )
        length_sum = F.aggregate(ls, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x))
        return F.struct(
            F.length(c).cast("long").alias("total_length"),
            count(WS).alias("whitespace_chars"),
            count(r"\n").alias("newlines"),
            count(r"\t").alias("tabs"),
            count(" ").alias("spaces"),
            count(r"\n{3,}").alias("long_newline_runs"),
            count(" {3,}").alias("long_space_runs"),
            count(r"[^\x00-\x7f]").alias("non_ascii_chars"),
            count(r"[\x00-\x08\x0b\x0c\x0e-\x1f]").alias("control_chars"),
            repeats.cast("long").alias("duplicate_lines"),
            F.size(ls).cast("long").alias("total_lines"),
            (length_sum / F.size(ls)).alias("avg_line_length"),
            F.contains(c, F.lit(PAGE_MARK)).alias("has_page_marks"),
            page_count(c).alias("num_pages"),
        )

    return let(F.split(c, "\n", -1), build)


def page_count(c: Column) -> Column:
    """Page marks plus one, or one for a text without marks."""
    marks = F.regexp_count(c, F.lit(PAGE_MARK))
    return (F.when(marks > 0, marks).otherwise(F.lit(0)) + 1).cast("long")

"""Pages to token-bounded chunks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.text import lines, rstrip, strip
from tessera.functions.tokens import CHARS_PER_TOKEN, CHUNK_MAX_TOKENS, effective_max, estimate_tokens
from tessera.operators.lines import MIN_LINE_LENGTH, PAGE_MARK
from tessera.operators.ordered import ordered_scan, range_sorted, running_totals
from tessera.operators.sites import page_block
from tessera.session import staged

# The smallest useful chunk and the rules for cutting long lines.
MIN_CHUNK_CHARS = 500
CHAR_CUT_MARGIN = 0.9
CHAR_CUT_FLOOR = 0.7


@dataclass(frozen=True)
class ChunkRules:
    """Limits of one chunking run; the defaults give 14705 tokens per chunk."""

    limit: int = effective_max()
    hard_limit: int = CHUNK_MAX_TOKENS
    min_chars: int = MIN_CHUNK_CHARS


def split_marked_text(df: DataFrame, column: str = "content") -> DataFrame:
    """Split text that holds page marks into (…, page_ord, url, page).

    Text before the first mark is a page without url; blank text there is none.
    """
    pages = F.transform(
        F.split(column, PAGE_MARK, -1),
        lambda p, i: F.when(i > 0, F.concat(F.lit(PAGE_MARK), p)).when(strip(p) != "", p),
    )
    keep = [c for c in df.columns if c != column]
    found = F.regexp_extract("page", rf"{PAGE_MARK}\s*([^\n]+)", 1)
    return (
        df.select(*keep, F.posexplode(F.filter(pages, lambda p: p.isNotNull())).alias("page_ord", "page"))
        .withColumn("url", F.regexp_replace(found, r"\s*(?:---)?\s*\z", ""))
        .withColumn("url", F.when(F.col("url") != "", F.col("url")))
    )


def _cut_line(line: str, limit: int) -> list[str]:
    """Cut one long line near spaces; what is left blank is dropped."""
    width = int(limit * CHARS_PER_TOKEN * CHAR_CUT_MARGIN)
    pieces, at = [], 0
    while len(line) - at > width:
        end = at + width
        gap = max(line.rfind(" ", at, end), line.rfind("\n", at, end))
        if gap - at > width * CHAR_CUT_FLOOR:
            end = gap + 1
        if line[at:end].strip():
            pieces.append(line[at:end])
        at = end
    if at < len(line):
        pieces.append(line[at:])
    return pieces


def _fill(parts: list[str], ending: str, bound: int, unit: int, cut) -> list[str]:
    """Put parts into pieces up to the bound; an oversize part is cut further.

    Sizes are counted per part in whole units. Text gathered before an oversize
    part becomes a piece of its own.
    """
    pieces: list[str] = []
    held: list[str] = []
    used = 0
    for part in parts:
        cost = (len(part) + len(ending)) // unit
        full = used + cost > bound
        if held and full:
            pieces.append("".join(held))
            held, used = [], 0
        if cost > bound:
            pieces.extend(cut(part))
        else:
            held.append(part + ending)
            used += cost
    return pieces + ["".join(held)] if held else pieces


def split_text(text: str, limit: int, exact: bool = False) -> list[str]:
    """Paragraphs, else lines, else stretches of characters, up to the limit.

    Tokens are counted per part and rounded down, so a piece of many parts can
    end a little over the limit; ``exact`` counts characters and never does.
    """
    bound, unit = (limit * CHARS_PER_TOKEN + CHARS_PER_TOKEN - 1, 1) if exact else (limit, CHARS_PER_TOKEN)

    def by_chars(line: str) -> list[str]:
        return _cut_line(line, limit)

    def by_lines(paragraph: str) -> list[str]:
        return _fill(paragraph.split("\n"), "\n", bound, unit, by_chars)

    if "\n\n" in text:
        return _fill(text.split("\n\n"), "\n\n", bound, unit, by_lines)
    return _fill(text.split("\n"), "\n", bound, unit, by_chars)


def split_within(text: str, limit: int) -> list[str]:
    """``split_text`` with every piece brought under the limit."""
    return [
        piece
        for first in split_text(text, limit)
        for piece in (
            [first] if len(first) // CHARS_PER_TOKEN <= limit else split_text(first, limit, exact=True)
        )
    ]


def split_large(c: Column, limit: int, strict: bool = False) -> Column:
    """Array of pieces; a text within the limit stays whole and stays in the JVM.

    ``strict`` guarantees the limit for every piece.
    """
    split = split_within if strict else split_text

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else split(t, limit))

    oversize = estimate_tokens(c) > limit
    return F.coalesce(cut(F.when(oversize, c)), F.array(c))


def _pack_step(limit: int):
    """Next fit over a batch: one step of the loop for each chunk, not for each piece.

    The state is the token sum of the open chunk, negative before a site's first piece.
    """

    def step(state, new, tokens):
        tokens = tokens.to_numpy().astype(np.int64)
        n = len(tokens)
        if new[0]:
            state = -1
        sums = np.concatenate([[0], np.cumsum(tokens)])
        begins = np.append(np.flatnonzero(new), n)
        end = begins[np.searchsorted(begins, np.arange(n), side="right")]
        # First piece over the limit counted from each piece on; a new site opens a chunk anyway.
        over = np.searchsorted(sums[1:], sums[:-1] + limit, side="right")
        following = np.minimum(np.maximum(over, np.arange(n) + 1), end)
        at = 0 if state < 0 else min(int(np.searchsorted(sums[1:], limit - state, side="right")), int(end[0]))
        opens = np.zeros(n, np.int64)
        last = -1
        while at < n:
            opens[at] = 1
            last, at = at, following[at]
        used = int(sums[n] - sums[last]) if last >= 0 else state + int(sums[n])
        return used, [opens]

    return step


def page_packing(pieces: DataFrame, limit: int, order: tuple[str, ...] = ("page_ord",)) -> DataFrame:
    """Number of the chunk each piece of a site falls into, by greedy next fit.

    ``pieces`` holds (site, *order, tokens). A chunk is closed when the next
    piece would take its token sum over the limit.
    """
    ordered = range_sorted(pieces.select("site", *order, "tokens"), ["site"], list(order))
    opened = ordered_scan(ordered, ["site"], ["tokens"], _pack_step(limit), -1, "opens int", batched=True)
    numbered = running_totals(opened, ["site"], list(order), {"chunk_no": F.col("opens")})
    return numbered.select("site", *order, "tokens", F.col("chunk_no").cast("long"))


def site_page_texts(pages: DataFrame, min_length: int = MIN_LINE_LENGTH) -> DataFrame:
    """Marked page texts with lines that repeat anywhere in the site removed.

    The first occurrence of a line in the site stays. Lines are counted per
    (site, line) with map-side aggregation, so a menu line found on every page
    of a huge site is reduced before the shuffle.
    """
    block = page_block(F.col("url"), F.col("content"))
    rows = pages.select(
        "site", "page_ord", F.posexplode(F.transform(lines(block), rstrip)).alias("line_no", "line")
    )
    place = F.struct("page_ord", "line_no")
    is_long = F.length("line") >= min_length
    first = (
        rows.where(is_long)
        .groupBy("site", "line")
        .agg(F.min(place).alias("p"))
        .select("site", "p.page_ord", "p.line_no", "line")
    )
    kept = first.unionByName(rows.where(~is_long))
    # The last page of a site has no blank line after it. The join key is unique.
    last = pages.groupBy("site").agg(F.max("page_ord").alias("page_ord")).withColumn("is_last", F.lit(True))
    texts = (
        kept.groupBy("site", "page_ord")
        .agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
        .join(last, ["site", "page_ord"], "left")
    )
    body = F.concat(
        F.array_join(F.transform("ls", lambda x: F.concat(x["line"], F.lit("\n"))), ""),
        F.when(F.col("is_last"), F.lit("")).otherwise(F.lit("\n")),
    )
    return texts.select(
        "site", "page_ord", F.regexp_replace(body, r"\n{4,}", "\n\n\n").alias("text")
    )


def chunk_pages(texts: DataFrame, urls: DataFrame, rules: ChunkRules = ChunkRules()) -> DataFrame:
    """Page texts (site, page_ord, text) to numbered chunks.

    Long pages are split, pieces are packed, and packed chunks that came out over
    the limit once joined are split again until none is over it. Returns (site, chunk_index,
    total_chunks, content, tokens, pages_included).
    """
    order = ("page_ord", "piece_no")
    pieces = staged(
        texts.select(
            "site",
            "page_ord",
            F.posexplode(split_large(F.col("text"), rules.limit)).alias("piece_no", "piece"),
        ).withColumn("tokens", estimate_tokens(F.col("piece"))),
        "pieces",
    )
    packed = page_packing(
        pieces.select("site", *order, "tokens"), rules.limit, order
    ).drop("tokens")
    with_url = pieces.drop("tokens").join(packed, ["site", *order]).join(
        urls.select("site", "page_ord", "url"), ["site", "page_ord"], "left"
    )
    # A piece names its page only where it holds the mark: the first piece does.
    marked = F.when(F.col("piece").startswith(PAGE_MARK), F.col("url"))
    chunks = (
        with_url.groupBy("site", "chunk_no")
        .agg(F.sort_array(F.collect_list(F.struct(*order, "piece", marked.alias("url")))).alias("ps"))
        .select(
            "site",
            "chunk_no",
            F.array_join(F.transform("ps", lambda p: p["piece"]), "\n\n").alias("joined"),
            F.transform(F.filter("ps", lambda p: p["url"].isNotNull()), lambda p: p["url"]).alias(
                "pages_included"
            ),
        )
    )
    final = chunks.select(
        "site",
        "chunk_no",
        "pages_included",
        F.posexplode(split_large(F.col("joined"), rules.limit, strict=True)).alias("sub_no", "content"),
    )
    return number_chunks(staged(final, "chunks"))


def number_chunks(chunks: DataFrame) -> DataFrame:
    """Dense 1-based index and total per site over (chunk_no, sub_no).

    Only the three key columns are sorted; the texts are joined back on a key
    that is unique, so a huge site does not pile up in one task.
    """
    order = ["chunk_no", "sub_no"]
    numbers = running_totals(
        range_sorted(chunks.select("site", *order), ["site"], order),
        ["site"],
        order,
        {"chunk_index": F.lit(1)},
        key_totals={"total_chunks": F.lit(1)},
    ).drop("_part")
    return chunks.join(numbers, ["site", *order]).select(
        "site",
        "chunk_index",
        "total_chunks",
        "content",
        estimate_tokens(F.col("content")).alias("tokens"),
        "pages_included",
    )


def chunk_issues(content: Column, tokens: Column, rules: ChunkRules = ChunkRules()) -> Column:
    """Names of the checks a chunk fails; empty for a good chunk."""
    useful = F.length(strip(content))
    checks = [
        (tokens > rules.limit, "over_effective_max"),
        (tokens > rules.hard_limit, "over_absolute_max"),
        (useful == 0, "empty"),
        (useful < rules.min_chars, "too_small"),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in checks]))


def chunk_report(chunks: DataFrame, limit: int, content: str = "content") -> DataFrame:
    """Per chunk its size against the limit, the prompt's overhead counted in.

    ``chunks`` holds chunk_index, total_chunks and the text.
    """
    full = estimate_tokens(F.col(content), overhead=True)
    return chunks.withColumns(
        {
            "content_length": F.length(content).cast("long"),
            "tokens": estimate_tokens(F.col(content)),
            "tokens_with_overhead": full,
            "limit": F.lit(limit).cast("long"),
            "exceeds_limit": full > limit,
        }
    )


def chunk_stats(chunks: DataFrame, rules: ChunkRules = ChunkRules()) -> DataFrame:
    """Per site: chunks, token average, maximum and sum, invalid chunks."""
    invalid = F.size(chunk_issues(F.col("content"), F.col("tokens"), rules)) > 0
    return (
        chunks.select("site", "tokens", invalid.cast("long").alias("bad"))
        .groupBy("site")
        .agg(
            F.count("*").alias("n_chunks"),
            F.avg("tokens").alias("avg_tokens"),
            F.max("tokens").alias("max_tokens"),
            F.sum("tokens").alias("total_tokens"),
            F.sum("bad").alias("invalid_chunks"),
        )
    )

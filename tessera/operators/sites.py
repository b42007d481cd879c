"""Sites: the pages of one host taken together."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.operators.access import MIN_PAGE_CHARS, page_success
from tessera.operators.ordered import range_sorted, running_totals


def page_block(url, content):
    """A page between its marks, as it stands in the text of its site."""
    return F.concat(
        F.lit("--- PAGE START: "), url, F.lit(" ---\n"), content, F.lit("\n--- PAGE END ---")
    )


def successful_pages(pages: DataFrame) -> DataFrame:
    return pages.where(page_success(F.col("content"), F.col("error")))


def site_content(pages: DataFrame) -> DataFrame:
    """Marked pages of each site as rows (site, page_ord, char_offset, block).

    ``pages`` holds successful pages (site, page_ord, url, content); the main page has
    the lowest ``page_ord``. ``char_offset`` is where the block stands in the text of the
    site, whose blocks are joined by a blank line. A site never becomes one value.
    """
    blocks = pages.select("site", "page_ord", page_block(F.col("url"), F.col("content")).alias("block"))
    sized = blocks.select("site", "page_ord", F.length("block").alias("chars"))
    placed = running_totals(
        range_sorted(sized, ["site"], ["page_ord"]), ["site"], ["page_ord"], {"upto": F.col("chars") + 2}
    ).select("site", "page_ord", (F.col("upto") - F.col("chars") - 2).cast("long").alias("char_offset"))
    return blocks.join(placed, ["site", "page_ord"]).select("site", "page_ord", "char_offset", "block")


def joined_text(content: DataFrame) -> DataFrame:
    """(site, content): the blocks of ``site_content`` as one text per site.

    For callers that need the text as one value and know that their sites fit into one.
    """
    blocks = F.sort_array(F.collect_list(F.struct("page_ord", "block")))
    return content.groupBy("site").agg(blocks.alias("b")).select(
        "site", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("content")
    )


def site_sizes(pages: DataFrame) -> DataFrame:
    """Pages and characters of each site's joined text, without building it."""
    sized = pages.select("site", F.length(page_block(F.col("url"), F.col("content"))).alias("chars"))
    return (
        sized.groupBy("site")
        .agg(F.count("*").alias("n_pages"), F.sum("chars").alias("chars"))
        .withColumn("chars", F.col("chars") + 2 * (F.col("n_pages") - 1))
    )


def min_site_content(pages: DataFrame, at_least: int = MIN_PAGE_CHARS) -> DataFrame:
    """Sites with enough text to be worth chunking."""
    return site_sizes(pages).where(F.col("chars") >= at_least)


def site_document_links(pages: DataFrame) -> DataFrame:
    """Distinct (site, link) over the document links of all pages of a site."""
    return pages.select("site", F.explode("document_links").alias("link")).distinct()


def visited_urls(pages: DataFrame) -> DataFrame:
    """(site, page_ord, url) of the pages that succeeded."""
    return successful_pages(pages).select("site", "page_ord", "url")


def site_success_rate(pages: DataFrame) -> DataFrame:
    ok = page_success(F.col("content"), F.col("error")).cast("long")
    return (
        pages.groupBy("site")
        .agg(F.count("*").alias("n_pages"), F.sum(ok).alias("n_success"))
        .withColumn("success_rate", F.col("n_success") / F.col("n_pages"))
    )

"""Fetched pages to chunks, per site."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tessera.functions import html as H, urls as U
from tessera.functions.text import once
from tessera.operators import access as A, chunking as C, links as N, sites as S
from tessera.session import staged


def pages_from_responses(responses: DataFrame) -> DataFrame:
    """(page_id, url, html) to the page model: text, links and a verdict.

    The markup is read once; only text and links travel on from here.
    """
    read = F.struct(
        A.page_status(H.html_text(F.col("html"))).alias("s"),
        N.extract_links(F.col("html"), F.col("url")).alias("l"),
    )
    return once(responses, "r", read).select(
        U.url_domain(F.col("url")).alias("site"),
        F.col("page_id").alias("page_ord"),
        "url",
        "r.s.content",
        "r.s.status_code",
        "r.s.error",
        F.col("r.l.pages").alias("links"),
        F.col("r.l.documents").alias("document_links"),
    )


def site_chunks(pages: DataFrame, rules: C.ChunkRules = C.ChunkRules()) -> DataFrame:
    """Successful pages (site, page_ord, url, content) to numbered chunks.

    Sites with too little text are left out. A chunk without a page mark gets the
    first five pages of its site. The pages are read several times here, so they
    are written once and their texts are not extracted again.
    """
    pages = staged(pages.select("site", "page_ord", "url", "content"), "pages")
    enough = S.min_site_content(pages).select("site")
    pages = pages.join(enough, "site", "left_semi")
    chunks = C.chunk_pages(C.site_page_texts(pages), pages, rules)
    by_place = Window.partitionBy("site").orderBy("page_ord")
    first_five = (
        pages.select("site", "page_ord", "url")
        .withColumn("rank", F.row_number().over(by_place))
        .where(F.col("rank") <= 5)
        .groupBy("site")
        .agg(F.sort_array(F.collect_list(F.struct("page_ord", "url"))).alias("f"))
        .select("site", F.transform("f", lambda x: x["url"]).alias("first_urls"))
    )
    bare = F.size("pages_included") == 0
    return chunks.join(first_five, "site", "left").select(
        "site",
        "chunk_index",
        "total_chunks",
        "content",
        "tokens",
        F.when(bare, F.col("first_urls")).otherwise(F.col("pages_included")).alias("pages_included"),
    )

"""Packing, splitting and chunk statistics over pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.registry import Tables, query
from tessera.catalog.text import SQL_WS
from tessera.catalog.web import SQL_BLOCK, SQL_SITE, SQL_SITE_PAGES, site_pages
from tessera.functions import tokens as K, urls as U
from tessera.operators import chunking as C, discovery as D, sites as S
from tessera.plans.company_profile import discoveries_from_searches, profiles_from_chunks
from tessera.plans.site_chunks import site_chunks
from tessera.session import scratch_folder, staged
from tessera.sources import stores

SMALL = C.ChunkRules(limit=500, hard_limit=600, min_chars=200)


def _walk_sql(pages: str, limit: int) -> str:
    """Greedy next fit as a recursive walk; ``pages`` needs site, rn, tok."""
    return f"""
walk(site, rn, used, grp) AS (
  SELECT site, rn, tok, 1 FROM {pages} WHERE rn = 1
  UNION ALL
  SELECT p.site, p.rn, CASE WHEN w.used + p.tok > {limit} THEN p.tok ELSE w.used + p.tok END,
         CASE WHEN w.used + p.tok > {limit} THEN w.grp + 1 ELSE w.grp END
  FROM walk w JOIN {pages} p ON p.site = w.site AND p.rn = w.rn + 1)
"""


@query(
    "page_packing",
    f"""WITH RECURSIVE {SQL_SITE_PAGES},
    n AS (SELECT site, page_ord, length(content) // 3 AS tok, row_number() OVER (PARTITION BY site ORDER BY page_ord) AS rn FROM ok),
    {_walk_sql('n', 2000)}
    SELECT n.site, n.page_ord, CAST(n.tok AS BIGINT) AS tokens, CAST(w.grp AS BIGINT) AS chunk_no FROM n JOIN walk w USING (site, rn)""",
)
def page_packing(t: Tables):
    pages = S.successful_pages(site_pages(t))
    sized = pages.select("site", "page_ord", K.estimate_tokens(F.col("content")).alias("tokens"))
    # Sorting by range reads its input twice, once for the sample.
    return C.page_packing(staged(sized, "sizes"), 2000)


# Lines packed into pieces, long lines cut near a space, as two recursive walks.
SQL_SPLIT_LARGE = """
WITH RECURSIVE big AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE length(text) // 3 > 500),
part AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM big),
sized AS (SELECT *, (length(line) + 1) // 3 AS cost FROM part),
walk AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS used, TRUE AS fresh, CAST(0 AS BIGINT) AS opened FROM big
  UNION ALL
  SELECT s.doc_id, s.pos, CASE WHEN s.cost > 500 THEN 0 WHEN w.fresh OR w.used + s.cost > 500 THEN s.cost ELSE w.used + s.cost END,
    s.cost > 500, CASE WHEN s.cost > 500 OR w.fresh OR w.used + s.cost > 500 THEN s.pos ELSE w.opened END
  FROM walk w JOIN sized s ON s.doc_id = w.doc_id AND s.pos = w.pos + 1),
held AS (SELECT w.doc_id, w.opened AS pos, CAST(0 AS BIGINT) AS sub, string_agg(s.line || chr(10), '' ORDER BY s.pos) AS piece
  FROM walk w JOIN sized s ON s.doc_id = w.doc_id AND s.pos = w.pos WHERE s.cost <= 500 GROUP BY w.doc_id, w.opened),
cuts AS (
  SELECT doc_id, pos, line, CAST(0 AS BIGINT) AS sub, CAST(0 AS BIGINT) AS start_at, CAST(0 AS BIGINT) AS end_at FROM sized WHERE cost > 500
  UNION ALL
  SELECT doc_id, pos, line, sub + 1, end_at, CASE WHEN length(line) - end_at <= 1350 THEN length(line)
     WHEN length(regexp_extract(substr(line, end_at + 1, 1350), '^(.*) ', 1)) > 945 THEN end_at + length(regexp_extract(substr(line, end_at + 1, 1350), '^(.*) ', 1)) + 1
     ELSE end_at + 1350 END
  FROM cuts WHERE end_at < length(line)),
pieces AS (SELECT doc_id, pos, sub, piece FROM held
  UNION ALL SELECT doc_id, pos, sub, substr(line, start_at + 1, end_at - start_at) FROM cuts WHERE sub > 0 AND trim(substr(line, start_at + 1, end_at - start_at)) <> ''
  UNION ALL SELECT doc_id, 0, 0, text FROM documents WHERE length(text) // 3 <= 500)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, sub) - 1 AS BIGINT) AS piece_no, md5(piece) AS digest, CAST(length(piece) // 3 AS BIGINT) AS tokens FROM pieces
"""


@query("split_large", SQL_SPLIT_LARGE)
def split_large(t: Tables):
    pieces = C.split_large(F.col("text"), SMALL.limit)
    return t.documents.select("doc_id", F.posexplode(pieces).alias("piece_no", "piece")).select(
        "doc_id", F.col("piece_no").cast("long").alias("piece_no"), F.md5("piece").alias("digest"), K.estimate_tokens(F.col("piece")).alias("tokens")
    )


@query("chunk_content")
def chunk_content(t: Tables):
    pages = staged(S.successful_pages(site_pages(t)), "pages")
    texts = pages.select(
        "site", "page_ord", S.page_block(F.col("url"), F.col("content")).alias("text")
    )
    return _digest(C.chunk_pages(texts, pages, SMALL))


@query("process_content")
def process_content(t: Tables):
    return _digest(site_chunks(S.successful_pages(site_pages(t)), SMALL))


def _digest(chunks):
    return chunks.select(
        "site",
        "chunk_index",
        "total_chunks",
        "tokens",
        F.md5("content").alias("digest"),
        F.array_join("pages_included", ",").alias("pages_included"),
    )


# The SQL packs whole pages. It says the same as long as no page and no joined chunk
# is over the limit and has to be split; the tests cover splitting.
SQL_CHUNK_STATS = f"""WITH RECURSIVE {SQL_SITE_PAGES},
    ln AS (SELECT site, page_ord, unnest(ls) AS raw, generate_subscripts(ls, 1) AS line_no
      FROM (SELECT site, page_ord, string_split({SQL_BLOCK}, chr(10)) AS ls FROM ok)),
    tr AS (SELECT site, page_ord, line_no, regexp_replace(raw, '{SQL_WS}+$', '') AS line FROM ln),
    mk AS (SELECT *, row_number() OVER (PARTITION BY site, line ORDER BY page_ord, line_no) AS seen,
       max(page_ord) OVER (PARTITION BY site) AS last_ord FROM tr),
    tx AS (SELECT site, page_ord, string_agg(line || chr(10), '' ORDER BY line_no) || CASE WHEN page_ord = any_value(last_ord) THEN '' ELSE chr(10) END AS text
       FROM mk WHERE length(line) < 5 OR seen = 1 GROUP BY site, page_ord),
    n AS (SELECT site, page_ord, text, length(text) // 3 AS tok, row_number() OVER (PARTITION BY site ORDER BY page_ord) AS rn FROM tx),
    {_walk_sql('n', 14705)},
    ch AS (SELECT n.site, w.grp, length(string_agg(n.text, chr(10) || chr(10) ORDER BY n.rn)) AS chars
       FROM n JOIN walk w USING (site, rn) GROUP BY n.site, w.grp)
    SELECT site, CAST(count(*) AS BIGINT) AS n_chunks, round(avg(chars // 3), 6) AS avg_tokens, CAST(max(chars // 3) AS BIGINT) AS max_tokens,
      CAST(sum(chars // 3) AS BIGINT) AS total_tokens FROM ch GROUP BY site"""


@query("site_chunk_stats", SQL_CHUNK_STATS)
def site_chunk_stats(t: Tables):
    chunks = site_chunks(S.successful_pages(site_pages(t)))
    stats = C.chunk_stats(chunks)
    return stats.select(
        "site", "n_chunks", F.round("avg_tokens", 6).alias("avg_tokens"), "max_tokens", "total_tokens"
    )


@query(
    "company_chain",
    f"""WITH found AS (SELECT {SQL_SITE} AS cnpj_basico, arg_max(url, page_id) AS website_url FROM pages GROUP BY 1),
    stats AS ({SQL_CHUNK_STATS})
    SELECT cnpj_basico, website_url, 'found' AS discovery_status, coalesce(n_chunks, 0) AS n_chunks, coalesce(total_tokens, 0) AS total_tokens,
      n_chunks IS NOT NULL AS has_profile FROM found LEFT JOIN stats ON site = cnpj_basico""",
)
def company_chain(t: Tables):
    """Searches to sites, sites to pages, pages to chunks, chunks to profiles.

    A host is a company; each of its pages was a search that brought a blocked link and
    the page, and the newest search counts.
    """
    searches = t.pages.select(
        U.url_domain(F.col("url")).alias("cnpj_basico"),
        F.concat(F.lit("q"), F.col("page_id")).alias("query_used"),
        F.array(
            F.struct(F.lit("f").alias("title"), F.lit("https://www.facebook.com/x").alias("link"), F.lit("").alias("snippet")),
            F.struct(F.lit("p").alias("title"), F.col("url").alias("link"), F.lit("").alias("snippet")),
        ).alias("results"),
        F.col("page_id").alias("created_at"),
        D.domain_label(F.col("url")).alias("name"),
    )
    requests = searches.select("cnpj_basico").distinct()
    names = searches.groupBy("cnpj_basico").agg(F.min("name").alias("name"))
    found = discoveries_from_searches(requests, searches.drop("name"), names)
    chunks = staged(site_chunks(S.successful_pages(site_pages(t))), "chunks")
    stats = C.chunk_stats(chunks).select(F.col("site").alias("cnpj_basico"), "n_chunks", "total_tokens")
    profiles = profiles_from_chunks(
        chunks.select(
            F.col("site").alias("cnpj_basico"), "chunk_index", F.col("content").alias("chunk_content"), F.col("pages_included").alias("page_source")
        )
    ).select("cnpj_basico", F.lit(True).alias("has_profile"))
    chain = found.join(stats, "cnpj_basico", "left").join(profiles, "cnpj_basico", "left")
    return chain.select(
        "cnpj_basico",
        "website_url",
        "discovery_status",
        F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
        F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"),
        F.coalesce("has_profile", F.lit(False)).alias("has_profile"),
    )


# Documents stand for chunks; some lose their text and some are doubled.
CHUNK_TEXT = "CASE doc_id % 10 WHEN 1 THEN '   ' WHEN 2 THEN text || text ELSE text END"


@query(
    "chunk_issues",
    f"""WITH b AS (SELECT doc_id, {CHUNK_TEXT} AS c FROM documents),
    s AS (SELECT doc_id, length(c) // 3 AS tok, length(regexp_replace(regexp_replace(c, '^{SQL_WS}+', ''), '{SQL_WS}+$', '')) AS n FROM b)
    SELECT doc_id, array_to_string(list_filter([CASE WHEN tok > 500 THEN 'over_effective_max' END, CASE WHEN tok > 600 THEN 'over_absolute_max' END,
      CASE WHEN n = 0 THEN 'empty' END, CASE WHEN n < 200 THEN 'too_small' END], lambda x: x IS NOT NULL), ',') AS issues FROM s""",
)
def chunk_issues(t: Tables):
    text = F.expr(CHUNK_TEXT)
    issues = C.chunk_issues(text, K.estimate_tokens(text), SMALL)
    return t.documents.select("doc_id", F.array_join(issues, ",").alias("issues"))


@query(
    "chunk_stats",
    f"""WITH s AS (SELECT source AS site, length(text) // 3 AS tok, length(regexp_replace(regexp_replace(text, '^{SQL_WS}+', ''), '{SQL_WS}+$', '')) AS n FROM documents)
    SELECT site, CAST(count(*) AS BIGINT) AS n_chunks, round(avg(tok), 6) AS avg_tokens, CAST(max(tok) AS BIGINT) AS max_tokens,
    CAST(sum(tok) AS BIGINT) AS total_tokens, CAST(count(*) FILTER (tok > 500 OR n < 200) AS BIGINT) AS invalid_chunks FROM s GROUP BY site""",
)
def chunk_stats(t: Tables):
    chunks = t.documents.select(
        F.col("source").alias("site"), F.col("text").alias("content"), K.estimate_tokens(F.col("text")).alias("tokens")
    )
    return C.chunk_stats(chunks, SMALL).withColumn("avg_tokens", F.round("avg_tokens", 6))


@query(
    "split_pages",
    f"""WITH {SQL_SITE_PAGES}, n AS (SELECT site, url, content, row_number() OVER (PARTITION BY site ORDER BY page_ord) AS rn, count(*) OVER (PARTITION BY site) AS total FROM ok)
    SELECT site, CAST(rn - 1 AS BIGINT) AS page_ord, url,
      CAST(length({SQL_BLOCK}) + CASE WHEN rn < total THEN 2 ELSE 0 END AS BIGINT) AS chars FROM n""",
)
def split_pages(t: Tables):
    pages = S.successful_pages(site_pages(t)).select("site", "page_ord", "url", "content")
    pages = C.split_marked_text(S.joined_text(S.site_content(staged(pages, "pages"))))
    return pages.select(
        "site", F.col("page_ord").cast("long").alias("page_ord"), "url", F.length("page").cast("long").alias("chars")
    )


@query(
    "chunk_report",
    """SELECT source, doc_id AS chunk_index, count(*) OVER (PARTITION BY source) AS total_chunks, CAST(length(text) AS BIGINT) AS content_length,
       CAST(length(text) // 3 AS BIGINT) AS tokens, CAST(length(text) // 3 + 2500 AS BIGINT) AS tokens_with_overhead, CAST(4000 AS BIGINT) AS "limit",
       length(text) // 3 + 2500 > 4000 AS exceeds_limit FROM documents""",
)
def chunk_report(t: Tables):
    totals = t.documents.groupBy("source").agg(F.count("*").alias("total_chunks"))
    chunks = t.documents.join(totals, "source").withColumnRenamed("doc_id", "chunk_index")
    return C.chunk_report(chunks, 4000, "text").select(
        "source", "chunk_index", "total_chunks", "content_length", "tokens", "tokens_with_overhead", "limit", "exceeds_limit"
    )


# Documents are the chunks of their source; some sources have no discovery.
@query(
    "scrape_stage",
    """WITH d AS (SELECT source, min(doc_id) AS id FROM documents WHERE lang <> 'en' AND doc_id % 3 = 0 GROUP BY source)
    SELECT source AS cnpj_basico, doc_id AS chunk_index, 'https://' || source || '.example.com' AS website_url,
      coalesce(id, -1) AS discovery_id FROM documents LEFT JOIN d USING (source)""",
)
def scrape_stage(t: Tables):
    discoveries = t.documents.where("lang <> 'en' and doc_id % 3 = 0").groupBy(F.col("source").alias("cnpj_basico")).agg(F.min("doc_id").alias("id"))
    chunks = t.documents.select(F.col("source").alias("cnpj_basico"), F.col("doc_id").alias("chunk_index"))
    site = F.concat(F.lit("https://"), F.col("cnpj_basico"), F.lit(".example.com"))
    found = stores.with_discovery(chunks.withColumn("website_url", site), discoveries)
    return found.withColumn("discovery_id", F.coalesce("discovery_id", F.lit(-1)))


@query(
    "chunk_scan",
    """SELECT source AS cnpj_basico, CAST(doc_id AS BIGINT) AS chunk_index, md5(text) AS digest FROM documents""",
)
def chunk_scan(t: Tables):
    chunks = t.documents.select(
        F.col("source").alias("cnpj_basico"), F.col("doc_id").alias("chunk_index"), F.col("text").alias("chunk_content")
    )
    wanted = chunks.select("cnpj_basico").distinct()
    return stores.scan_chunks(chunks, wanted).select(
        "cnpj_basico", "chunk_index", F.md5("chunk_content").alias("digest")
    )


@query("chunk_sink")
def chunk_sink(t: Tables):
    chunks = site_chunks(S.successful_pages(site_pages(t)), SMALL).withColumnsRenamed(
        {"site": "cnpj_basico", "content": "chunk_content", "tokens": "token_count"}
    )
    folder = scratch_folder(t.spark, "chunks")
    stores.write_chunks(chunks, folder)
    # Written again: a rerun replaces the company's chunks instead of doubling them.
    stores.write_chunks(chunks, folder)
    return stores.read_chunks(t.spark, folder).select(
        "cnpj_basico", "chunk_index", "total_chunks", "token_count", "page_source", F.md5("chunk_content").alias("digest")
    )

"""Requests, search results and discoveries over orders, customers and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.registry import Tables, query
from tessera.catalog.web import ERROR_KIND, ERROR_MESSAGE, SQL_PROBE_CLASS
from tessera.functions import tokens as K
from tessera.operators import access as A, discovery as D
from tessera.session import scratch_folder
from tessera.sources import stores as R

AS_OF = 1705276800.0  # 2024-01-15 00:00:00 UTC


def order_results(t: Tables):
    """Each order as one search: its lines are the hits."""
    hit = F.struct(
        F.concat(F.lit("part "), F.col("l_partkey")).alias("title"),
        F.concat(F.lit("https://s"), F.col("l_suppkey"), F.lit(".example.com/")).alias("link"),
        F.col("l_returnflag").alias("snippet"),
    )
    hits = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", hit.alias("hit")))).alias("hs")
    )
    results = F.coalesce(F.transform("hs", lambda h: h["hit"]), F.array().cast(R.SEARCH_HITS))
    return t.orders.join(hits, "o_orderkey", "left").select(
        F.col("o_custkey").alias("cnpj_basico"),
        F.concat(F.lit("q"), F.col("o_orderkey")).alias("query_used"),
        results.alias("results"),
        F.col("o_orderdate").alias("created_at"),
    )


@query(
    "serp_append",
    """WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT o_custkey AS cnpj_basico, 'q' || o_orderkey AS query_used, CAST(coalesce(n, 0) AS BIGINT) AS results_count
    FROM orders LEFT JOIN n ON l_orderkey = o_orderkey""",
)
def serp_append(t: Tables):
    folder = scratch_folder(t.spark, "serp")
    stored = R.append_search_results(order_results(t), folder)
    return stored.select("cnpj_basico", "query_used", "results_count")


PAYLOAD = """concat('{"organic": [{"title": "t', event_id, '", "link": "https://u', user_id, '.example.com/"',
  CASE WHEN event_id % 3 = 0 THEN ', "snippet": "s"' ELSE '' END, '}, {"link": "https://x.example.com/', event_id, '"}]}')"""


@query(
    "serp_parse",
    """SELECT event_id, CAST(0 AS BIGINT) AS rank, 't' || event_id AS title, 'https://u' || user_id || '.example.com/' AS link,
       CASE WHEN event_id % 3 = 0 THEN 's' ELSE '' END AS snippet FROM events
       UNION ALL SELECT event_id, 1, '', 'https://x.example.com/' || event_id, '' FROM events""",
)
def serp_parse(t: Tables):
    # The table's own payloads hold no hits; both kinds are parsed.
    own = t.events.select("event_id", R.parse_search_payload(F.col("props")).alias("results"))
    built = t.events.select("event_id", R.parse_search_payload(F.expr(PAYLOAD)).alias("results"))
    hits = R.search_hits(own.unionByName(built))
    return hits.select(
        "event_id", F.col("rank").cast("long").alias("rank"), F.coalesce("title", F.lit("")).alias("title"), "link", "snippet"
    )


@query(
    "latest_per_key",
    """SELECT o_custkey, o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS day FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
)
def latest_per_key(t: Tables):
    last = R.latest_per_key(
        t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey"
    )
    return last.select(
        "o_custkey", "o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    )


def discovery_tables(t: Tables):
    """Old discoveries from the customers, updates from the orders."""
    target = t.customer.select(
        F.col("c_custkey").alias("cnpj_basico"),
        F.concat(F.lit("https://"), F.lower("c_mktsegment"), F.lit(".example.com")).alias("website_url"),
        F.lit("found").alias("discovery_status"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
        F.lit(None).cast("long").alias("serper_id"),
    )
    updates = t.orders.select(
        F.col("o_custkey").alias("cnpj_basico"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("https://o"), F.col("o_orderkey"), F.lit(".example.com"))).alias("website_url"),
        F.when(F.col("o_orderstatus") == "F", "found").otherwise("not_found").alias("discovery_status"),
        F.col("o_orderdate").alias("updated_at"),
        F.col("o_orderkey").alias("serper_id"),
    )
    return target, updates


SQL_UPSERT = """
u AS (SELECT o_custkey AS k, CASE WHEN o_orderstatus = 'F' THEN 'https://o' || o_orderkey || '.example.com' ELSE '' END AS url,
  CASE WHEN o_orderstatus = 'F' THEN 'found' ELSE 'not_found' END AS st,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders),
merged AS (SELECT k AS cnpj_basico, url AS website_url, st AS discovery_status FROM u WHERE rn = 1
  UNION ALL SELECT c_custkey, 'https://' || lower(c_mktsegment) || '.example.com', 'found' FROM customer
   WHERE c_custkey NOT IN (SELECT k FROM u))
"""


@query("upsert_discovery", f"WITH {SQL_UPSERT} SELECT * FROM merged")
def upsert_discovery(t: Tables):
    target, updates = discovery_tables(t)
    folder = scratch_folder(t.spark, "discovery")
    R.upsert(target, folder, "cnpj_basico", "updated_at", "serper_id")
    R.upsert(updates, folder, "cnpj_basico", "updated_at", "serper_id")
    return t.spark.read.parquet(folder).select(
        "cnpj_basico", F.coalesce("website_url", F.lit("")).alias("website_url"), "discovery_status"
    )


@query("merge_latest", f"WITH {SQL_UPSERT} SELECT * FROM merged")
def merge_latest(t: Tables):
    target, updates = discovery_tables(t)
    return R.merge_latest(target, updates, "cnpj_basico", "updated_at", "serper_id").select(
        "cnpj_basico", F.coalesce("website_url", F.lit("")).alias("website_url"), "discovery_status"
    )


@query(
    "lookup_discovery",
    f"""WITH {SQL_UPSERT} SELECT DISTINCT s_suppkey AS cnpj_basico, coalesce(discovery_status, 'none') AS discovery_status
    FROM supplier LEFT JOIN merged ON cnpj_basico = s_suppkey""",
)
def lookup_discovery(t: Tables):
    target, updates = discovery_tables(t)
    table = R.merge_latest(target, updates, "cnpj_basico", "updated_at", "serper_id")
    asked = t.supplier.select(F.col("s_suppkey").alias("cnpj_basico"))
    return R.lookup(asked, table, "cnpj_basico").select(
        "cnpj_basico", F.coalesce("discovery_status", F.lit("none")).alias("discovery_status")
    )


SQL_PREFIX = """
p AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 14, '0') AS cnpj, o_orderdate AS updated_at, o_orderstatus AS st FROM orders),
q AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN lpad(CAST(p_partkey AS VARCHAR), 14, '0') ELSE substr(lpad(CAST(p_partkey AS VARCHAR), 14, '0'), 1, 12) END AS prefix FROM part),
j AS (SELECT q.prefix, p.* FROM q JOIN p ON p.cnpj = q.prefix OR starts_with(p.cnpj, q.prefix))
"""


def prefix_tables(t: Tables):
    profiles = t.orders.select(
        F.lpad(F.col("o_orderkey").cast("string"), 14, "0").alias("cnpj"),
        F.col("o_orderdate").alias("updated_at"),
        F.col("o_orderstatus").alias("st"),
    )
    full = F.lpad(F.col("p_partkey").cast("string"), 14, "0")
    asked = t.part.select(
        F.when(F.col("p_partkey") % 2 == 0, full).otherwise(F.substring(full, 1, 12)).alias("prefix")
    ).distinct()
    return asked, profiles


@query("prefix_join", f"WITH {SQL_PREFIX} SELECT prefix, cnpj, st FROM j")
def prefix_join(t: Tables):
    asked, profiles = prefix_tables(t)
    return R.prefix_join(asked, profiles, "prefix", "cnpj").select("prefix", "cnpj", "st")


@query(
    "profile_prefix_lookup",
    f"WITH {SQL_PREFIX} SELECT prefix, cnpj, st FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY updated_at DESC, cnpj DESC) AS rn FROM j) WHERE rn = 1",
)
def profile_prefix_lookup(t: Tables):
    asked, profiles = prefix_tables(t)
    return R.profile_prefix_lookup(asked, profiles, "prefix", "cnpj", "updated_at").select("prefix", "cnpj", "st")


REQUEST_KEY = "CASE c_custkey % 4 WHEN 0 THEN lpad(CAST(c_custkey AS STRING), 8, '0') WHEN 1 THEN lpad(CAST(c_custkey AS STRING), 9, '0') WHEN 2 THEN lpad(CAST(c_custkey AS STRING), 8, 'x') ELSE '' END"
REQUEST_URL = "CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE 'https://c.example.com' END"


@query(
    "validate_requests",
    f"""SELECT c_custkey, length(k) = 8 AND trim(u) <> '' AS accepted,
      CASE WHEN length(k) <> 8 THEN 'key must have 8 characters' WHEN trim(u) = '' THEN 'website_url is required' ELSE '' END AS reject_reason
    FROM (SELECT c_custkey, {REQUEST_KEY} AS k, {REQUEST_URL} AS u FROM customer)""",
)
def validate_requests(t: Tables):
    requests = t.customer.select(
        "c_custkey", F.expr(REQUEST_KEY).alias("cnpj_basico"), F.expr(REQUEST_URL).alias("website_url")
    )
    return R.validate_requests(requests, needs_url=True).select(
        "c_custkey", "accepted", F.coalesce("reject_reason", F.lit("")).alias("reject_reason")
    )


LEGAL_NAME = """CASE c_custkey % 6 WHEN 0 THEN c_name || ' LTDA' WHEN 1 THEN ' ' || upper(c_name) || ' S.A. ' WHEN 2 THEN c_name || ' MERCADO EIRELI'
  WHEN 3 THEN c_name || ' EPP S/A' WHEN 4 THEN '' ELSE c_name END"""
TRADE_NAME = "CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN lower(c_name) || ' ' WHEN 2 THEN 'Loja ' || c_name ELSE '' END"


def company_names(t: Tables):
    city = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return t.customer.join(city, "c_nationkey", "left").select(
        "c_custkey",
        F.expr(LEGAL_NAME).alias("legal"),
        F.expr(TRADE_NAME).alias("trade"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("n_name")).alias("city"),
    )


SQL_NAMES = f"""
names AS (SELECT c_custkey, trim({LEGAL_NAME}) AS legal, trim({TRADE_NAME}) AS trade,
   CASE WHEN c_custkey % 7 <> 0 THEN n_name ELSE '' END AS city FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey),
bare AS (SELECT *, trim(replace(replace(replace(replace(replace(replace(legal, ' LTDA', ''), ' S.A.', ''), ' EIRELI', ''), ' ME', ''), ' EPP', ''), ' S/A', '')) AS clean FROM names)
"""


@query(
    "search_queries",
    f"""WITH {SQL_NAMES},
    q AS (SELECT c_custkey, 1 AS pos, trim(trade || ' ' || city || ' site oficial') AS query FROM bare WHERE trade <> ''
    UNION ALL SELECT c_custkey, CASE WHEN trade = '' THEN 1 ELSE 2 END, trim(clean || ' ' || city || ' site oficial') FROM bare
      WHERE clean <> '' AND (trade = '' OR upper(clean) <> upper(trade)))
    SELECT c_custkey, CAST(pos AS BIGINT) AS pos, query FROM q""",
)
def search_queries(t: Tables):
    queries = D.search_queries(F.col("legal"), F.col("trade"), F.col("city"))
    return company_names(t).select("c_custkey", F.posexplode(queries).alias("p", "query")).select(
        "c_custkey", (F.col("p") + 1).cast("long").alias("pos"), "query"
    )


@query(
    "search_query_single",
    f"""WITH {SQL_NAMES} SELECT c_custkey, CASE WHEN trade <> '' THEN trim(trade || ' ' || city || ' site oficial')
      WHEN clean <> '' THEN trim(clean || ' ' || city || ' site oficial') WHEN city <> '' THEN 'site oficial ' || city ELSE 'site oficial' END AS query FROM bare""",
)
def search_query_single(t: Tables):
    q = D.search_query_single(F.col("legal"), F.col("trade"), F.col("city"))
    return company_names(t).select("c_custkey", q.alias("query"))


@query(
    "query_key",
    "SELECT c_custkey, md5(lower(c_name) || ':' || (c_custkey % 3 * 10)) AS key FROM customer",
)
def query_key(t: Tables):
    padded = F.concat(F.lit("  "), F.upper("c_name"), F.lit("\t"))
    return t.customer.select(
        "c_custkey", D.query_key(padded, F.col("c_custkey") % 3 * 10).alias("key")
    )


# Hits by page: some on listed domains, in each form the filter must see.
HIT_LINKS = """array(url, CASE page_id % 6 WHEN 0 THEN 'https://www.facebook.com/x' WHEN 1 THEN 'm.facebook.com/y' WHEN 2 THEN 'http://sub.olx.com.br'
  WHEN 3 THEN 'https://notfacebook.com/' WHEN 4 THEN 'https://mobile.X.com/z' ELSE 'https://www.m.youtube.com' END, url)"""
SQL_HITS = """
hits AS (SELECT page_id, unnest([0, 1, 2]) AS rank, unnest([url, CASE page_id % 6 WHEN 0 THEN 'https://www.facebook.com/x' WHEN 1 THEN 'm.facebook.com/y' WHEN 2 THEN 'http://sub.olx.com.br'
  WHEN 3 THEN 'https://notfacebook.com/' WHEN 4 THEN 'https://mobile.X.com/z' ELSE 'https://www.m.youtube.com' END, url]) AS link FROM pages),
judged AS (SELECT *, rank = 1 AND page_id % 6 <> 3 AS blocked FROM hits)
"""


def page_hits(t: Tables):
    return t.pages.select("page_id", F.posexplode(F.expr(HIT_LINKS)).alias("rank", "link"))


@query("domain_blacklist", f"WITH {SQL_HITS} SELECT page_id, rank::BIGINT AS rank, link, blocked FROM judged")
def domain_blacklist(t: Tables):
    return page_hits(t).select(
        "page_id", F.col("rank").cast("long").alias("rank"), "link", D.is_blocked(F.col("link")).alias("blocked")
    )


@query("blacklist_anti", f"WITH {SQL_HITS} SELECT page_id, rank::BIGINT AS rank, link FROM judged WHERE NOT blocked")
def blacklist_anti(t: Tables):
    kept = D.drop_blocked(page_hits(t), "link", D.blocked_table(t.spark))
    return kept.withColumn("rank", F.col("rank").cast("long"))


@query(
    "filter_search_results",
    f"WITH {SQL_HITS} SELECT page_id, CAST(min(rank) AS BIGINT) AS rank, link FROM judged WHERE NOT blocked GROUP BY page_id, link",
)
def filter_search_results(t: Tables):
    kept = D.filter_search_results(page_hits(t), "page_id")
    return kept.withColumn("rank", F.col("rank").cast("long"))


@query(
    "union_queries",
    """SELECT o_custkey AS cnpj_basico, o_orderkey AS query_no, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'part ' || l_partkey, 'https://s' || l_suppkey || '.example.com/', l_returnflag) - 1 AS BIGINT) AS rank,
      'https://s' || l_suppkey || '.example.com/' AS link FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'""",
)
def union_queries(t: Tables):
    searches = order_results(t).select(
        "cnpj_basico", F.substring("query_used", 2, 20).cast("long").alias("query_no"), "results"
    )
    status = t.orders.select(F.col("o_orderkey").alias("query_no"), (F.col("o_orderstatus") != "P").alias("ok"))
    return D.union_queries(searches.join(status, "query_no")).select(
        "cnpj_basico", "query_no", F.col("rank").cast("long").alias("rank"), "link"
    )


# Candidate sites per customer; which of them fits the name follows from the id.
SITE_NAME = "CASE c_custkey % 4 WHEN 0 THEN 'AR Engenharia ' || c_custkey WHEN 1 THEN 'Alianza Manutenção' WHEN 2 THEN 'ASST Serviços' ELSE c_name END"
SITE_LINKS = """array('https://www.facebook.com/page', 'https://guia' || c_nationkey || '.example.com/x',
  CASE c_custkey % 4 WHEN 0 THEN 'https://www.arengenharia' || c_custkey || '.eng.br/' WHEN 1 THEN 'http://allianzautomacao.com.br'
   WHEN 2 THEN 'https://asst.com.br/sobre' ELSE 'https://other.example.com' END, 'https://late.example.com')"""


def site_hits(t: Tables):
    rows = t.customer.select(
        "c_custkey", F.expr(SITE_NAME).alias("name"), F.posexplode(F.expr(SITE_LINKS)).alias("rank", "link")
    )
    return D.filter_search_results(rows, "c_custkey")


SQL_MATCH = """
match AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'https://www.arengenharia' || c_custkey || '.eng.br/' WHEN 1 THEN 'http://allianzautomacao.com.br'
   WHEN 2 THEN 'https://asst.com.br/sobre' END AS website_url FROM customer)
"""


@query("match_site", f"WITH {SQL_MATCH} SELECT * FROM match WHERE website_url IS NOT NULL")
def match_site(t: Tables):
    return D.match_site(site_hits(t), "c_custkey")


@query(
    "stage_chain",
    f"""WITH {SQL_MATCH}, s AS (SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer),
    f AS (SELECT c_custkey, n, CASE WHEN n > 0 THEN website_url END AS website_url FROM s JOIN match USING (c_custkey))
    SELECT c_custkey, coalesce(website_url, '') AS website_url, CASE WHEN website_url IS NULL THEN 'not_found' ELSE 'found' END AS discovery_status,
      CASE WHEN website_url IS NULL THEN 0.0 ELSE 0.9 END::DOUBLE AS confidence_score,
      CASE WHEN n = 0 THEN 'Nenhum resultado Serper encontrado' ELSE '' END AS reason FROM f""",
)
def stage_chain(t: Tables):
    requests = t.customer.select("c_custkey")
    searches = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("results_count")
    )
    hits = site_hits(t).join(searches.select("c_custkey"), "c_custkey", "left_semi")
    rows = D.discovery_rows(requests, searches, hits, D.match_site(hits, "c_custkey"), "c_custkey")
    return rows.select(
        "c_custkey",
        F.coalesce("website_url", F.lit("")).alias("website_url"),
        "discovery_status",
        F.coalesce("confidence_score", F.lit(0.0)).alias("confidence_score"),
        F.coalesce("llm_reasoning", F.lit("")).alias("reason"),
    )


ANSWER = """CASE event_id % 7 WHEN 0 THEN concat('{"site": "https://e', event_id, '.example.com", "site_oficial": "sim"}')
  WHEN 1 THEN concat('text ```json\n{"site": "https://e', event_id, '.example.com", "site_oficial": "sim"}\n``` end')
  WHEN 2 THEN concat('```\n[{"site": "https://e', event_id, '.example.com", "site_oficial": "sim"}]\n```')
  WHEN 3 THEN '{"site": "nao_encontrado", "site_oficial": "sim"}' WHEN 4 THEN '{"site": "https://n.example.com", "site_oficial": "nao"}'
  WHEN 5 THEN '{"site": "https://cut' ELSE '[]' END"""


@query(
    "discovery_parse",
    "SELECT event_id, CASE WHEN event_id % 7 < 3 THEN 'https://e' || event_id || '.example.com' ELSE '' END AS site FROM events",
)
def discovery_parse(t: Tables):
    site = D.discovery_answer(F.expr(ANSWER))
    return t.events.select("event_id", F.coalesce(site, F.lit("")).alias("site"))


RETRY_HEADER = """CASE event_id % 6 WHEN 0 THEN CAST(event_id % 90 AS STRING) WHEN 1 THEN ' 7.5 ' WHEN 2 THEN '-3' WHEN 3 THEN 'soon' WHEN 4 THEN '' END"""


@query(
    "retry_after",
    """WITH b AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN (event_id % 90)::DOUBLE WHEN 1 THEN 7.5 WHEN 2 THEN -3
       WHEN 5 THEN epoch(date_trunc('second', ts)) - 1705276800 END::DOUBLE AS w FROM events)
    SELECT event_id, CASE WHEN w > 0 THEN least(w, 60.0)::DOUBLE ELSE -1.0::DOUBLE END AS wait FROM b""",
)
def retry_after(t: Tables):
    stamp = F.date_format(F.date_trunc("second", "ts"), "EEE, dd MMM yyyy HH:mm:ss")
    header = F.when(F.col("event_id") % 6 == 5, F.concat(stamp, F.lit(" GMT"))).otherwise(F.expr(RETRY_HEADER))
    return t.events.select(
        "event_id", F.coalesce(D.retry_after(header, AS_OF), F.lit(-1.0)).alias("wait")
    )


PROBE_STATUS = "CASE event_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 301 WHEN 2 THEN 404 WHEN 3 THEN 503 WHEN 4 THEN 302 ELSE 204 END"


@query(
    "best_url",
    f"""WITH p AS (SELECT user_id AS base_url, 'https://v' || event_id || '.example.com' AS url, value AS time_ms, {PROBE_STATUS} AS status FROM events)
    SELECT base_url, url, time_ms, CAST(status AS BIGINT) AS status FROM (SELECT *, row_number() OVER (PARTITION BY base_url ORDER BY status >= 300, time_ms, url) AS rn FROM p WHERE status < 400) WHERE rn = 1""",
)
def best_url(t: Tables):
    probes = t.events.select(
        F.col("user_id").alias("base_url"),
        F.concat(F.lit("https://v"), F.col("event_id"), F.lit(".example.com")).alias("url"),
        F.col("value").alias("time_ms"),
        F.expr(PROBE_STATUS).cast("long").alias("status"),
    )
    return D.best_url(probes)


@query(
    "best_error",
    f"""WITH b AS (SELECT user_id AS base_url, event_id, lower({ERROR_MESSAGE}) AS m, {ERROR_KIND} AS k, {ERROR_MESSAGE} AS message FROM events WHERE event_type = 'error'),
    c AS (SELECT *, {SQL_PROBE_CLASS} AS error_class FROM b)
    SELECT base_url, error_class, message FROM (SELECT *, row_number() OVER (PARTITION BY base_url ORDER BY list_position(
      ['dns_error', 'ssl_error', 'connection_refused', 'connection_timeout', 'too_many_redirects', 'blocked', 'server_error', 'http_error', 'unknown'], error_class), event_id) AS rn FROM c) WHERE rn = 1""",
)
def best_error(t: Tables):
    message = F.expr(ERROR_MESSAGE)
    errors = t.events.where("event_type = 'error'").select(
        F.col("user_id").alias("base_url"),
        F.col("event_id").alias("ord"),
        message.alias("message"),
        A.probe_error_class(message, F.expr(ERROR_KIND)).alias("error_class"),
    )
    return D.best_error(errors, A.probe_error_priority(F.col("error_class")))


@query(
    "retry_failed_rows",
    """SELECT doc_id, CAST(CASE WHEN length(text) // 3 <= 500 OR length(text) // 3 <= 1500 THEN length(text) ELSE 0 END AS BIGINT) AS chars,
      CAST(CASE WHEN length(text) // 3 <= 500 THEN 1 WHEN length(text) // 3 <= 1500 THEN 2 ELSE 0 END AS BIGINT) AS attempt FROM documents""",
)
def retry_failed_rows(t: Tables):
    def within(limit: int):
        ok = K.estimate_tokens(F.col("text")) <= limit
        return lambda rows: rows.select("doc_id", F.col("text").alias("content"), ok.alias("ok"))

    out = D.retry_failed(t.documents.select("doc_id", "text"), "doc_id", within(500), within(1500))
    return out.select(
        "doc_id", F.length("content").cast("long").alias("chars"), F.col("attempt").cast("long").alias("attempt")
    )

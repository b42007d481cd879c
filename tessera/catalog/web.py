"""Pages, links, protections and sites over the pages table.

The given pages hold no error pages, challenges or asset links. Queries that
need them extend every page by a rule on its id; no row is left out, and the
check SQL applies the same rule.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.registry import Tables, query
from tessera.catalog.text import SQL_WS
from tessera.functions import html as H, urls as U
from tessera.functions.text import once
from tessera.operators import access as A, links as N, sites as S
from tessera.plans.site_chunks import pages_from_responses
from tessera.session import staged

SQL_NETLOC = "regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.\\-]*:)?//([^/?#]*)', 1)"
SQL_SITE = f"lower({SQL_NETLOC})"


def sql_path(url: str) -> str:
    return (
        f"regexp_replace(regexp_extract({url}, '^(?:[a-zA-Z][a-zA-Z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '')"
    )


def sql_query(url: str) -> str:
    return f"regexp_extract({url}, '^[^?#]*\\?([^#]*)', 1)"


# The check has its own lists: elements by name, entities that the pages or the added
# markup hold, and tags whose quoted values may hold ">".
SQL_ELEMENTS = ["script", "style", "noscript", "svg", "iframe"]
SQL_ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "\'\'", "&ccedil;": "ç", "&otilde;": "õ", "&#233;": "é", "&#xE9;": "é",
    "&nbsp;": "\u00a0", "&euro;": "€", "&hellip;": "…", "&middot;": "·", "&copy;": "©", "&copy": "©",
}
SQL_TAG = "(?s)<[/!?a-zA-Z](?:=\\s*\"[^\"]*\"|=\\s*\'\'[^\'\']*\'\'|[^>])*?>"


def sql_clean(column: str, gap: str) -> str:
    out = f"regexp_replace({column}, '(?s)<!--.*?-->', {gap}, 'g')"
    for name in SQL_ELEMENTS:
        out = f"regexp_replace({out}, '(?is)<{name}(?:\\s[^>]*)?>.*?</{name}\\s*>', {gap}, 'g')"
    return out


def sql_html_text(column: str) -> str:
    out = f"regexp_replace({sql_clean(column, 'chr(10)')}, '{SQL_TAG}', chr(10), 'g')"
    for entity, char in SQL_ENTITIES.items():
        out = f"replace({out}, '{entity}', '{char}')"
    out = f"regexp_replace({out}, '&amp;?', '&', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '^{SQL_WS}+', ''), '{SQL_WS}+$', '')"
    return f"regexp_replace({out}, '{SQL_WS}*[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]{SQL_WS}*', chr(10), 'g')"


SQL_SITE_PAGES = f"""
sp AS (SELECT {SQL_SITE} AS site, page_id AS page_ord, url, {sql_html_text('html')} AS content FROM pages),
ok AS (SELECT * FROM sp WHERE length(content) >= 100)
"""
SQL_BLOCK = "'--- PAGE START: ' || url || ' ---' || chr(10) || content || chr(10) || '--- PAGE END ---'"


def site_pages(t: Tables):
    """Every page as (site, page_ord, url, content, status_code, error)."""
    status = A.page_status(H.html_text(F.col("html")))
    return once(t.pages, "s", status).select(
        U.url_domain(F.col("url")).alias("site"),
        F.col("page_id").alias("page_ord"),
        "url",
        "s.content",
        "s.status_code",
        "s.error",
    )


# Markup put at the end of every page, with what the given pages lack.
EXTRA_MARKUP = (
    '<p title="a>b" data-x=1>Solu&ccedil;&otilde;es &#233; &#xE9;&nbsp;&euro;5 &amp;lt; &copy 2024</p>'
    '<svg><path d="M0"></svg><noscript><iframe src="x"></noscript><b>fim&hellip;</b> &unknown;'
)


@query("html_text", f"SELECT page_id, {sql_html_text('(html || ' + repr(EXTRA_MARKUP) + ')')} AS text FROM pages")
def html_text(t: Tables):
    return t.pages.select("page_id", H.html_text(F.concat("html", F.lit(EXTRA_MARKUP))).alias("text"))


# Anchors put at the end of every page, so that each kind of reference occurs.
EXTRA_ANCHORS = (
    '<a href="/files/a.pdf">a</a><a href="/x.PNG">b</a><a href="#top">c</a>'
    '<a href="javascript:go()">d</a><a href="?page=2&amp;q=1">e</a><a href="sobre/equipe">f</a>'
    '<a href="../up/./blog">g</a><a href="//other.example.org/z">h</a>'
    '<a class=x href=/contato>i</a><a href="mailto:a@b.example.com">j</a>'
    "<a href='/show?img=a.png'>k</a><a href=\"/doc.docx,\">l</a>"
    '<a data-href="/track" href="/real">m</a><script>x="<a href=/in-script>"</script>'
    '<noscript><a href="/in-noscript">n</a></noscript><a title="see href=/quoted" href="/after">o</a>'
)
SQL_EXTRA = EXTRA_ANCHORS.replace("'", "''")


# The check takes an anchor apart into attribute names and values and picks the first href.
SQL_ATTRIBUTE = r"""regexp_extract_all(tag, '(?i)\s([^\s"''>=/]+)\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', {part})"""


def sql_links() -> str:
    """Resolved links by page, with the kind of each."""
    return f"""
src AS (SELECT page_id, url, html || '{SQL_EXTRA}' AS html FROM pages),
tags AS (SELECT page_id, url, unnest(regexp_extract_all({sql_clean('html', "' '")},
   '(?i)<a\\s(?:"[^"]*"|''[^'']*''|[^>"''])*>')) AS tag FROM src),
attrs AS (SELECT page_id, url, tag, {SQL_ATTRIBUTE.format(part=1)} AS names, {SQL_ATTRIBUTE.format(part=2)} AS texts FROM tags),
raw AS (SELECT page_id, url, texts[list_position(list_transform(names, lambda x: lower(x)), 'href')] AS h FROM attrs
   WHERE list_contains(list_transform(names, lambda x: lower(x)), 'href')),
hr AS (SELECT DISTINCT page_id, url, regexp_replace(trim(replace(regexp_replace(regexp_replace(h, '^["'']', ''), '["'']$', ''), '&amp;', '&')), ',+$', '') AS h FROM raw),
parts AS (SELECT *, regexp_extract(url, '^([a-z]+)://', 1) AS sch, {SQL_NETLOC} AS host,
    {sql_path('url')} AS bpath FROM hr WHERE NOT starts_with(h, '#') AND NOT starts_with(lower(h), 'javascript:')),
joined AS (SELECT DISTINCT page_id, url, host, regexp_replace(CASE
    WHEN h = '' THEN url
    WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.\\-]*:') THEN h
    WHEN starts_with(h, '//') THEN sch || ':' || h
    WHEN starts_with(h, '/') THEN sch || '://' || host || h
    WHEN starts_with(h, '?') THEN sch || '://' || host || bpath || h
    WHEN h = '../up/./blog' THEN sch || '://' || host || regexp_replace(regexp_extract(bpath, '^(.*/)', 1), '[^/]*/$', '') || 'up/blog'
    ELSE sch || '://' || host || regexp_extract(bpath, '^(.*/)', 1) || h END, ',+$', '') AS link FROM parts),
kinds AS (SELECT *, lower({sql_path('link')}) AS p, lower({sql_query('link')}) AS q,
    regexp_extract(link, '^(?:[a-zA-Z][a-zA-Z0-9+.\\-]*:)?//([^/?#]*)', 1) AS lhost FROM joined
    WHERE NOT (contains(link, '#') AND regexp_replace(link, '#.*$', '') = regexp_replace(url, '#.*$', ''))),
links AS (SELECT page_id, url, link, CASE
    WHEN regexp_matches(p, '\\.(pdf|doc|docx|ppt|pptx)$') THEN 'document'
    WHEN regexp_matches(p, '\\.(png|jpg|jpeg|gif|svg|webp|ico|bmp|tiff|zip|rar|tar|gz|xls|xlsx|csv|txt|xml|json|js|css|mp4|mp3|avi|mov|wmv|flv|webm|woff|woff2|ttf|eot|otf)$') THEN NULL
    WHEN lhost = host AND NOT regexp_matches(q, '\\.(png|jpg|jpeg|gif|svg)') THEN 'page' END AS kind FROM kinds)
"""


def page_links(t: Tables):
    extended = F.concat(F.col("html"), F.lit(EXTRA_ANCHORS))
    return t.pages.select("page_id", "url", N.extract_links(extended, F.col("url")).alias("found"))


@query("extract_links", f"WITH {sql_links()} SELECT page_id, kind, link FROM links WHERE kind IS NOT NULL")
def extract_links(t: Tables):
    found = page_links(t)
    docs = F.transform("found.documents", lambda x: F.struct(F.lit("document").alias("kind"), x.alias("link")))
    pages = F.transform("found.pages", lambda x: F.struct(F.lit("page").alias("kind"), x.alias("link")))
    return found.select("page_id", F.inline(F.concat(docs, pages)))


@query(
    "distinct_links",
    f"""WITH {sql_links()} SELECT page_id, CAST(count(*) FILTER (kind = 'document') AS BIGINT) AS documents,
    CAST(count(*) FILTER (kind = 'page') AS BIGINT) AS pages FROM links GROUP BY page_id""",
)
def distinct_links(t: Tables):
    return page_links(t).select(
        "page_id",
        F.size("found.documents").cast("long").alias("documents"),
        F.size("found.pages").cast("long").alias("pages"),
    )


@query(
    "page_model",
    f"""WITH {sql_links()}, n AS (SELECT page_id, count(*) FILTER (kind = 'page') AS links, count(*) FILTER (kind = 'document') AS documents FROM links GROUP BY page_id)
    SELECT {SQL_SITE} AS site, page_id AS page_ord, CAST(length({sql_html_text(f"(html || '{SQL_EXTRA}')")}) AS BIGINT) AS chars,
      links, documents, '' AS error FROM pages JOIN n USING (page_id)""",
)
def page_model(t: Tables):
    responses = t.pages.withColumn("html", F.concat("html", F.lit(EXTRA_ANCHORS)))
    pages = pages_from_responses(responses)
    return pages.select(
        "site",
        "page_ord",
        F.length("content").cast("long").alias("chars"),
        F.size("links").cast("long").alias("links"),
        F.size("document_links").cast("long").alias("documents"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


# Links put beside the extracted ones, so that every filter rule has work.
EXTRA_LINKS = [
    "/wp-content/uploads/logo.ico", "/assets/page", "/view?file=A.JPG", "/report.pdf,", "/sobre",
    "/produtos?p=2", "/blog/page/2", "/politica-privacidade", "/login", "/a/b/c/d", "/style.css",
]
SQL_EXTRA_LINKS = "[" + ", ".join(f"'{x}'" for x in EXTRA_LINKS) + "]"
SQL_MORE = f"""
more AS (SELECT page_id, url, link FROM links WHERE kind = 'page'
   UNION ALL SELECT page_id, url, sch || '://' || host || unnest({SQL_EXTRA_LINKS}) FROM
     (SELECT DISTINCT page_id, url, sch, host FROM parts)),
usable AS (SELECT DISTINCT page_id, url, regexp_replace(link, ',+$', '') AS link FROM more),
html_links AS (SELECT * FROM (SELECT *, lower({sql_path('link')}) AS p, lower({sql_query('link')}) AS q FROM usable)
   WHERE NOT regexp_matches(p, '\\.(pdf|doc|docx|ppt|pptx)$')
     AND NOT regexp_matches(p, '\\.(png|jpg|jpeg|gif|svg|webp|ico|bmp|tiff|zip|rar|tar|gz|xls|xlsx|csv|txt|xml|json|js|css|mp4|mp3|avi|mov|wmv|flv|webm|woff|woff2|ttf|eot|otf)$')
     AND NOT regexp_matches(q, '\\.(png|jpg|jpeg|gif|svg|webp)')),
scored AS (SELECT page_id, link,
    CAST(CASE WHEN low THEN -100 ELSE 0 END + CASE WHEN high THEN 50 ELSE 0 END
      - len(string_split({sql_path('link')}, '/')) + CASE WHEN paging AND NOT low THEN 30 ELSE 0 END AS BIGINT) AS score
  FROM (SELECT *, regexp_matches(lower(link), 'login|signin|cart|policy|blog|news|politica-privacidade|termos') AS low,
      regexp_matches(lower(link), 'quem-somos|sobre|institucional|portfolio|produto|servico|solucoes|atuacao|tecnologia|catalogo|clientes|cases|projetos|obras|certificacoes|premios|parceiros|equipe|time|lideranca|contato|fale-conosco|unidades') AS high,
      regexp_matches(lower(link), 'page|p=|pagina|nav') AS paging
    FROM html_links WHERE regexp_replace(link, '/+$', '') <> regexp_replace(url, '/+$', ''))),
ranked AS (SELECT page_id, link, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, link) AS rank
  FROM scored WHERE score > -80)
"""


def candidate_links(t: Tables):
    root = F.concat(U.scheme(F.col("url")), F.lit("://"), U.netloc(F.col("url")))
    extra = F.array(*[F.concat(root, F.lit(x)) for x in EXTRA_LINKS])
    return page_links(t).select("page_id", "url", F.concat("found.pages", extra).alias("links"))


@query("filter_non_html_links", f"WITH {sql_links()}, {SQL_MORE} SELECT page_id, link FROM html_links")
def filter_non_html_links(t: Tables):
    return candidate_links(t).select(
        "page_id", F.explode(N.filter_non_html_links(F.col("links"))).alias("link")
    )


@query(
    "prioritize_links",
    f"WITH {sql_links()}, {SQL_MORE} SELECT page_id, CAST(rank AS BIGINT) AS rank, link, score FROM ranked",
)
def prioritize_links(t: Tables):
    ranked = N.prioritize_links(N.filter_non_html_links(F.col("links")), F.col("url"))
    return candidate_links(t).select("page_id", F.posexplode(ranked).alias("pos", "r")).select(
        "page_id",
        (F.col("pos") + 1).cast("long").alias("rank"),
        "r.link",
        F.col("r.score").cast("long").alias("score"),
    )


@query(
    "select_links",
    f"""WITH {sql_links()}, {SQL_MORE}, n AS (SELECT page_id, count(*) AS n FROM html_links GROUP BY page_id)
    SELECT page_id, link FROM html_links JOIN n USING (page_id) WHERE n <= 12
    UNION ALL SELECT page_id, link FROM ranked JOIN n USING (page_id) WHERE n > 12 AND rank <= 12""",
)
def select_links(t: Tables):
    chosen = N.select_links(F.col("links"), F.col("url"), max_links=12)
    return candidate_links(t).select("page_id", F.explode(chosen).alias("link"))


@query(
    "rescue_links",
    f"""WITH {sql_links()}, {SQL_MORE}, short AS (SELECT page_id FROM pages WHERE length({sql_html_text('html')}) < 500)
    SELECT page_id, CAST(rank AS BIGINT) AS rank, link FROM ranked WHERE rank <= 3 AND page_id IN (SELECT page_id FROM short)""",
)
def rescue_links(t: Tables):
    texts = t.pages.select("page_id", H.html_text(F.col("html")).alias("text"))
    pages = candidate_links(t).join(texts, "page_id")
    picked = N.rescue_links(F.col("text"), F.col("links"), F.col("url"), F.lit(0))
    return pages.select("page_id", F.posexplode(picked).alias("pos", "link")).select(
        "page_id", (F.col("pos") + 1).cast("long").alias("rank"), "link"
    )


@query(
    "fetch_batches",
    f"WITH {sql_links()}, {SQL_MORE} SELECT page_id, CAST((rank - 1) // 4 AS BIGINT) AS batch, link FROM ranked",
)
def fetch_batches(t: Tables):
    ordered = N.target_subpages(F.col("links"), F.col("url"), N.subpage_cap(F.lit(False)))
    return candidate_links(t).select("page_id", F.inline(N.fetch_batches(ordered, 4)))


@query(
    "index_to_url",
    f"""WITH {sql_links()},
    sorted AS (SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY link) AS place FROM links WHERE kind = 'page'),
    picks AS (SELECT page_id, unnest([3, 1, page_id % 9]) AS place, unnest([0, 1, 2]) AS ord FROM pages)
    SELECT page_id, CAST(ord AS BIGINT) AS ord, link FROM picks JOIN sorted USING (page_id, place)
    WHERE page_id % 5 <> 4""",
)
def index_to_url(t: Tables):
    # Answers in each accepted form, one kind per page; every fifth is no JSON.
    answer = F.expr(
        """CASE page_id % 5
        WHEN 0 THEN concat('[3, "1", ', page_id % 9, ', 9999, "x"]')
        WHEN 1 THEN concat('{"links": [3, 1, ', page_id % 9, ']}')
        WHEN 2 THEN concat('{"note": "n", "selected": [3, 1, ', page_id % 9, ', null]}')
        WHEN 3 THEN concat('{"note": "n", "other": [3, 1, ', page_id % 9, ']}')
        ELSE 'no json' END"""
    )
    picked = N.index_to_url(answer, F.col("found.pages"))
    # Positions that do not exist are dropped, so the order is read from the value.
    places = F.array(F.lit(3), F.lit(1), (F.col("page_id") % 9).cast("int"))
    base = page_links(t).select(
        "page_id", picked.alias("picked"), places.alias("places"), F.col("found.pages").alias("pages")
    )
    valid = F.filter(
        F.transform("places", lambda p, i: F.struct(p.alias("p"), i.alias("i"))),
        lambda s: (s["p"] >= 1) & (s["p"] <= F.size("pages")),
    )
    return base.select("page_id", F.inline(F.arrays_zip(F.transform(valid, lambda s: s["i"]).alias("ord"), F.col("picked").alias("link")))).select(
        "page_id", F.col("ord").cast("long").alias("ord"), "link"
    ).where(F.col("link").isNotNull())


@query(
    "url_domain",
    f"SELECT page_id, {SQL_SITE} AS site FROM pages",
)
def url_domain(t: Tables):
    return t.pages.select("page_id", U.url_domain(F.col("url")).alias("site"))


@query(
    "url_join",
    f"""SELECT page_id, ref, CASE ref
       WHEN '/a/b' THEN sch || '://' || host || '/a/b'
       WHEN '//h.example.com/x' THEN sch || '://h.example.com/x'
       WHEN 'https://o.example.com/' THEN ref
       WHEN '?q=1' THEN sch || '://' || host || p || '?q=1'
       WHEN 'c/d.html' THEN sch || '://' || host || regexp_extract(p, '^(.*/)', 1) || 'c/d.html'
       WHEN '/a/../b/./c' THEN sch || '://' || host || '/b/c' END AS joined
    FROM (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS sch, {SQL_NETLOC} AS host, {sql_path('url')} AS p,
      unnest(['/a/b', '//h.example.com/x', 'https://o.example.com/', '?q=1', 'c/d.html', '/a/../b/./c']) AS ref FROM pages)""",
)
def url_join(t: Tables):
    refs = ["/a/b", "//h.example.com/x", "https://o.example.com/", "?q=1", "c/d.html", "/a/../b/./c"]
    pairs = t.pages.select("page_id", "url", F.explode(F.array(*[F.lit(r) for r in refs])).alias("ref"))
    return pairs.select("page_id", "ref", U.url_join(F.col("url"), F.col("ref")).alias("joined"))


def sql_encoded(parts: str, sep: str) -> str:
    return f"array_to_string(list_transform(string_split({parts}, '{sep}'), lambda x: url_encode(x)), '{sep}')"


@query(
    "normalize_url",
    f"""WITH u AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) || '://' || {SQL_NETLOC} AS root, {sql_path('url')} AS p,
      {sql_query('url')} AS q FROM pages),
    e AS (SELECT *, {sql_encoded('p', '/')} AS ep, array_to_string(list_transform(string_split(q, '&'), lambda x: CASE WHEN contains(x, '=')
        THEN url_encode(split_part(x, '=', 1)) || '=' || url_encode(substr(x, strpos(x, '=') + 1)) ELSE url_encode(x) END), '&') AS eq FROM u)
    SELECT page_id, root || ep || CASE WHEN q <> '' THEN '?' || eq ELSE '' END AS same,
      root || ep || CASE WHEN q <> '' THEN '?' || eq || '%2F%C3%A9%20f%3Fk%3D%C3%BC%20v' ELSE '' END AS extended FROM e""",
)
def normalize_url(t: Tables):
    # Quoted, with commas and a fragment behind; queries get letters to encode.
    has_query = U.query(F.col("url")) != ""
    bare = F.regexp_replace("url", "#.*$", "")
    rough = F.concat(F.lit(' "'), bare, F.lit('",, '))
    extended = F.when(has_query, F.concat(bare, F.lit("/é f?k=ü v,"))).otherwise(bare)
    return t.pages.select(
        "page_id", U.normalize_url(rough).alias("same"), U.normalize_url(extended).alias("extended")
    )


SQL_VARIATIONS = f"""
v AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS sch, {SQL_NETLOC} AS host,
   replace({SQL_NETLOC}, 'www.', '') AS bare, CASE WHEN {sql_path('url')} = '' THEN '/' ELSE {sql_path('url')} END AS p FROM pages),
forms AS (SELECT DISTINCT page_id, url, regexp_replace(unnest([
   'https://www.' || bare || p, 'https://' || bare || p, 'http://www.' || bare || p, 'http://' || bare || p,
   sch || '://' || host || p]), '/+$', '') AS variation FROM v)
"""


@query(
    "url_variations",
    f"""WITH {SQL_VARIATIONS} SELECT page_id, variation,
       CAST(row_number() OVER (PARTITION BY page_id ORDER BY NOT starts_with(variation, 'https'), NOT contains(variation, 'www.')) AS BIGINT) AS rank
    FROM forms""",
)
def url_variations(t: Tables):
    return t.pages.select(
        "page_id", F.posexplode(U.url_variations(F.col("url"))).alias("pos", "variation")
    ).select("page_id", "variation", (F.col("pos") + 1).cast("long").alias("rank"))


@query(
    "url_difference",
    f"WITH {SQL_VARIATIONS} SELECT page_id, variation FROM forms WHERE variation <> url",
)
def url_difference(t: Tables):
    left = F.array_except(U.url_variations(F.col("url")), F.array(F.col("url")))
    return t.pages.select("page_id", F.explode(left).alias("variation"))


# One response per page: body, header and status follow from the page id.
RESPONSE_BODY = """html || CASE page_id % 13
  WHEN 1 THEN ' CloudFlare: Just a moment... ' WHEN 2 THEN ' cloudflare ' WHEN 3 THEN ' Checking your browser '
  WHEN 4 THEN ' g-recaptcha ' WHEN 5 THEN ' Access Denied by firewall ' WHEN 6 THEN ' firewall '
  WHEN 7 THEN ' Too many requests ' WHEN 8 THEN ' unusual traffic ' WHEN 9 THEN ' ray id: 7 ' ELSE '' END"""
RESPONSE_HEADER = """CASE page_id % 7 WHEN 1 THEN 'CF-Ray' WHEN 2 THEN 'X-WAF-Rule' WHEN 3 THEN 'Retry-After' ELSE 'server' END"""
RESPONSE_STATUS = "CASE page_id % 9 WHEN 0 THEN 429 WHEN 1 THEN 403 WHEN 2 THEN 503 ELSE 200 END"
SQL_PROTECTION = f"""
resp AS (SELECT page_id, url, lower({RESPONSE_BODY}) AS low, lower({RESPONSE_HEADER}) AS hdr, {RESPONSE_STATUS} AS status FROM pages),
flags AS (SELECT *,
  regexp_matches(low, 'cf-browser-verification|cf_chl_opt|just a moment|checking your browser|ray id:')
    AND (hdr IN ('cf-ray', 'cf-cache-status', 'cf-request-id') OR contains(low, 'cloudflare')) AS cloudflare,
  regexp_matches(low, 'recaptcha|hcaptcha|h-captcha|challenge-form|captcha-container|verify you are human|prove you''re not a robot') AS captcha,
  starts_with(hdr, 'x-waf-') OR contains(low, 'access denied')::INT + contains(low, '403 forbidden')::INT
   + contains(low, 'blocked by security')::INT + contains(low, 'firewall')::INT + contains(low, 'security check')::INT
   + contains(low, 'blocked request')::INT + contains(low, 'web application firewall')::INT + contains(low, 'waf')::INT >= 2 AS waf,
  hdr = 'retry-after' OR regexp_matches(low, 'rate limit|too many requests|request limit exceeded|slow down|retry after') AS limited,
  regexp_matches(low, 'bot detected|automated access|suspicious activity|unusual traffic|please verify') AS bot FROM resp),
prot AS (SELECT page_id, url, status, CASE WHEN status = 429 THEN 'rate_limit' WHEN status = 403 AND limited THEN 'rate_limit'
  WHEN status = 403 AND waf THEN 'waf' WHEN cloudflare THEN 'cloudflare' WHEN captcha THEN 'captcha' WHEN waf THEN 'waf'
  WHEN limited THEN 'rate_limit' WHEN bot THEN 'bot_detection' ELSE 'none' END AS protection FROM flags)
"""


def responses(t: Tables):
    return t.pages.select(
        "page_id",
        "url",
        F.expr(RESPONSE_BODY).alias("body"),
        F.create_map(F.expr(RESPONSE_HEADER), F.lit("1")).alias("headers"),
        F.expr(RESPONSE_STATUS).alias("status"),
    )


def protections(t: Tables):
    kind = A.protection_type(F.col("headers"), F.col("body"), F.col("status"))
    return responses(t).select("page_id", "url", "status", kind.alias("protection"))


@query("protection_type", f"WITH {SQL_PROTECTION} SELECT page_id, protection FROM prot")
def protection_type(t: Tables):
    return protections(t).select("page_id", "protection")


@query(
    "protection_advice",
    f"""WITH {SQL_PROTECTION} SELECT page_id, protection, protection IN ('cloudflare', 'captcha', 'bot_detection') AS blocking,
    protection <> 'captcha' AS can_retry,
    CAST(CASE protection WHEN 'cloudflare' THEN 5 WHEN 'waf' THEN 3 WHEN 'rate_limit' THEN 60 WHEN 'bot_detection' THEN 10 ELSE 0 END AS BIGINT) AS delay_seconds,
    protection IN ('cloudflare', 'waf', 'bot_detection') AS change_strategy,
    CASE protection WHEN 'cloudflare' THEN 'aggressive' WHEN 'waf' THEN 'robust' WHEN 'bot_detection' THEN 'aggressive' ELSE '' END AS recommended_strategy
    FROM prot""",
)
def protection_advice(t: Tables):
    out = A.with_protection_advice(protections(t).select("page_id", "protection"))
    return out.withColumns(
        {
            "delay_seconds": F.col("delay_seconds").cast("long"),
            "recommended_strategy": F.coalesce("recommended_strategy", F.lit("")),
        }
    )


@query(
    "cloudflare_challenge",
    f"""WITH b AS (SELECT page_id, lower({RESPONSE_BODY}) AS low FROM pages)
    SELECT page_id, contains(low, 'cloudflare') AND regexp_matches(low, 'just a moment\\.\\.\\.|cf-browser-verification|challenge-running|cf_chl_opt|checking your browser') AS challenge FROM b""",
)
def cloudflare_challenge(t: Tables):
    return responses(t).select("page_id", A.is_challenge_page(F.col("body")).alias("challenge"))


# Short texts come from the conversations; some get an error phrase by id.
ERROR_TEXT = """text || CASE (conv_id + turn) % 5 WHEN 1 THEN ' Page Not Found' WHEN 2 THEN ' item not found'
  WHEN 3 THEN ' Cloudflare: checking your browser' ELSE '' END"""
SQL_MISSING = """length(c) <= 1000 AND (regexp_matches(lower(c), '404 not found|page not found|página não encontrada|erro 404|não encontramos a página|página inexistente|error 404|file not found')
   OR (length(c) < 200 AND contains(lower(c), 'not found')))"""


@query(
    "soft_404",
    f"WITH b AS (SELECT conv_id, turn, {ERROR_TEXT} AS c FROM conversations) SELECT conv_id, turn, {SQL_MISSING} AS soft_404 FROM b",
)
def soft_404(t: Tables):
    return t.conversations.select("conv_id", "turn", A.is_soft_404(F.expr(ERROR_TEXT)).alias("soft_404"))


@query(
    "page_success",
    f"""WITH b AS (SELECT conv_id, turn, {ERROR_TEXT} AS c FROM conversations),
    f AS (SELECT *, c = '' OR ({SQL_MISSING}) AS missing, contains(lower(c), 'cloudflare') AND contains(lower(c), 'checking your browser') AS challenge FROM b)
    SELECT conv_id, turn, CAST(CASE WHEN missing OR challenge THEN 0 ELSE length(c) END AS BIGINT) AS chars,
      CAST(CASE WHEN missing THEN 404 ELSE 200 END AS BIGINT) AS status_code,
      CASE WHEN missing THEN 'Soft 404' WHEN challenge THEN 'Cloudflare' ELSE '' END AS error,
      NOT missing AND NOT challenge AND length(c) >= 100 AS success FROM f""",
)
def page_success(t: Tables):
    s = t.conversations.select("conv_id", "turn", A.page_status(F.expr(ERROR_TEXT)).alias("s"))
    return s.select(
        "conv_id",
        "turn",
        F.length("s.content").cast("long").alias("chars"),
        F.col("s.status_code").cast("long").alias("status_code"),
        F.coalesce("s.error", F.lit("")).alias("error"),
        A.page_success(F.col("s.content"), F.col("s.error")).alias("success"),
    )


# Every page in one of four builds: as given, with framework marks, with both,
# or reduced to its head and an empty shell.
BUILT_HTML = """CASE page_id % 4 WHEN 1 THEN html || '<script src="main.js"></script><div data-v-1 id="__next">React</div>'
  WHEN 2 THEN regexp_replace(html, '(?s)<body.*', '') || '<body><div id="root"></div></body>'
  WHEN 3 THEN html || '<p>please wait</p>' ELSE html END"""


@query(
    "site_type",
    f"""WITH b AS (SELECT page_id, {BUILT_HTML} AS h FROM pages),
    x AS (SELECT page_id, lower(h) AS low, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
       h, '(?s)<!--.*?-->', chr(1), 'g'), '(?is)<script(?:\\s[^>]*)?>.*?</script\\s*>', chr(10), 'g'),
       '(?is)<style(?:\\s[^>]*)?>.*?</style\\s*>', chr(10), 'g'), '(?s)<[/!?a-zA-Z][^>]*>', chr(1), 'g') AS bare FROM b),
    n AS (SELECT page_id, low, list_sum(list_transform(string_split(replace(replace(replace(replace(bare, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), chr(1)),
       lambda s: length(regexp_replace(regexp_replace(s, '^{SQL_WS}+', ''), '{SQL_WS}+$', '')))) AS n FROM x)
    SELECT page_id, CASE WHEN regexp_matches(low, '<div id="root"></div>|<div id="app"></div>|<div id="__next"></div>|loading\\.\\.\\.|please wait|javascript required') AND n < 500 THEN 'spa'
      WHEN contains(low, 'react')::INT + contains(low, '__next')::INT + contains(low, '__nuxt')::INT + contains(low, 'ng-app')::INT
       + contains(low, 'ng-controller')::INT + contains(low, 'data-v-')::INT + contains(low, 'vue-')::INT + contains(low, 'ember')::INT
       + contains(low, '_app.js')::INT + contains(low, 'main.js')::INT + contains(low, 'bundle.js')::INT >= 2 THEN 'hybrid' ELSE 'static' END AS site_type FROM n""",
)
def site_type(t: Tables):
    return t.pages.select("page_id", A.site_type(F.expr(BUILT_HTML)).alias("site_type"))


# Latency stands in for response time; kinds follow from the event id.
EVENT_PROTECTION = """CASE event_id % 8 WHEN 1 THEN 'cloudflare' WHEN 2 THEN 'waf' WHEN 3 THEN 'captcha' WHEN 4 THEN 'rate_limit' WHEN 5 THEN 'bot_detection' ELSE 'none' END"""
EVENT_SITE_TYPE = """CASE event_id % 5 WHEN 1 THEN 'spa' WHEN 2 THEN 'hybrid' WHEN 3 THEN 'unknown' ELSE 'static' END"""


def fetch_profile(t: Tables):
    return t.events.select(
        "event_id",
        F.expr(EVENT_PROTECTION).alias("protection"),
        F.expr(EVENT_SITE_TYPE).alias("kind"),
        (F.col("value") * 40).alias("ms"),
    )


@query(
    "fetch_strategy",
    f"""WITH b AS (SELECT event_id, {EVENT_PROTECTION} AS p, {EVENT_SITE_TYPE} AS k, value * 40 AS ms FROM events)
    SELECT event_id, CASE WHEN p = 'cloudflare' THEN 'aggressive' WHEN p IN ('waf', 'bot_detection') THEN 'robust'
      WHEN p = 'rate_limit' THEN 'standard' WHEN k = 'spa' THEN 'robust' WHEN k = 'hybrid' THEN 'standard'
      WHEN ms < 1000 THEN 'fast' WHEN ms > 3000 THEN 'robust' ELSE 'standard' END AS strategy FROM b""",
)
def fetch_strategy(t: Tables):
    best = A.fetch_strategy(F.col("protection"), F.col("kind"), F.col("ms"))
    return fetch_profile(t).select("event_id", best.alias("strategy"))


@query(
    "strategy_list",
    f"""WITH b AS (SELECT event_id, {EVENT_PROTECTION} AS p, {EVENT_SITE_TYPE} AS k, value * 40 AS ms FROM events),
    base AS (SELECT *, CASE WHEN p = 'cloudflare' THEN 'aggressive,robust,standard,fast' WHEN p = 'waf' THEN 'robust,aggressive,standard,fast'
       WHEN p = 'captcha' THEN 'aggressive,robust,fast,standard' WHEN p = 'rate_limit' THEN 'standard,robust,fast,aggressive'
       WHEN p = 'bot_detection' THEN 'aggressive,robust,standard,fast' WHEN k = 'static' THEN 'fast,standard,robust,aggressive'
       WHEN k = 'spa' THEN 'robust,aggressive,standard,fast' WHEN k = 'hybrid' THEN 'standard,robust,aggressive,fast'
       ELSE 'standard,fast,robust,aggressive' END AS s FROM b)
    SELECT event_id, CASE WHEN ms > 5000 THEN 'robust,' || array_to_string(list_filter(string_split(s, ','), lambda x: x <> 'robust'), ',')
       WHEN ms < 500 AND k = 'static' THEN 'fast,' || array_to_string(list_filter(string_split(s, ','), lambda x: x <> 'fast'), ',')
       ELSE s END AS strategies,
      CASE split_part(s, ',', 1) WHEN 'fast' THEN 'fast,standard,robust' WHEN 'standard' THEN 'standard,fast,robust'
        WHEN 'robust' THEN 'robust,standard,aggressive' ELSE 'aggressive,robust,standard' END AS subpage FROM base""",
)
def strategy_list(t: Tables):
    p, k = F.col("protection"), F.col("kind")
    plain = A.strategy_list(p, k, F.lit(1000.0))
    return fetch_profile(t).select(
        "event_id",
        F.array_join(A.strategy_list(p, k, F.col("ms")), ",").alias("strategies"),
        F.array_join(A.subpage_strategies(F.get(plain, F.lit(0))), ",").alias("subpage"),
    )


# Error texts by event id, one for each class and some for none.
ERROR_MESSAGE = """CASE event_id % 16 WHEN 0 THEN 'Read timeout after 8s' WHEN 1 THEN 'Cloudflare challenge' WHEN 2 THEN 'HTTP 403'
  WHEN 3 THEN 'captcha wall' WHEN 4 THEN 'Rate limit hit' WHEN 5 THEN 'empty reply' WHEN 6 THEN 'SSL handshake failed'
  WHEN 7 THEN 'DNS lookup failed' WHEN 8 THEN 'Connection refused' WHEN 9 THEN 'connection reset by peer'
  WHEN 10 THEN 'too many redirects' WHEN 11 THEN 'soft 404' WHEN 12 THEN 'could not resolve host'
  WHEN 13 THEN 'broken pipe' WHEN 14 THEN 'odd failure' ELSE '' END"""
ERROR_KIND = "CASE event_id % 3 WHEN 0 THEN 'HTTPError' ELSE 'OSError' END"
SQL_SCRAPE_CLASS = """CASE WHEN m = '' THEN 'unknown' WHEN contains(m, 'timeout') THEN 'timeout' WHEN contains(m, 'cloudflare') THEN 'cloudflare'
  WHEN contains(m, '403') OR contains(m, 'waf') THEN 'waf' WHEN contains(m, 'captcha') THEN 'captcha'
  WHEN contains(m, 'rate') AND contains(m, 'limit') THEN 'rate_limit' WHEN contains(m, 'empty') OR contains(m, '404') THEN 'empty_content'
  WHEN contains(m, 'ssl') OR contains(m, 'certificate') THEN 'ssl_error' WHEN contains(m, 'dns') OR contains(m, 'resolve') THEN 'dns_error'
  WHEN contains(m, 'connect') THEN 'connection_error' ELSE 'unknown' END"""
SQL_PROBE_CLASS = """CASE WHEN regexp_matches(m, 'nodename nor servname|name or service not known|getaddrinfo failed|dns|resolve') THEN 'dns_error'
  WHEN regexp_matches(m, 'connection refused|errno 111|errno 61') THEN 'connection_refused'
  WHEN regexp_matches(m, 'timeout|timed out|time out') THEN 'connection_timeout'
  WHEN regexp_matches(m, 'connection reset|broken pipe|connection aborted') THEN 'connection_refused'
  WHEN regexp_matches(m, 'ssl|cert|handshake') THEN 'ssl_error' WHEN regexp_matches(m, 'redirect|too many|47') THEN 'too_many_redirects'
  WHEN contains(lower(k), 'http') THEN 'http_error' ELSE 'unknown' END"""


@query(
    "fetch_error_class",
    f"""WITH b AS (SELECT event_id, lower({ERROR_MESSAGE}) AS m, {ERROR_KIND} AS k FROM events)
    SELECT event_id, {SQL_SCRAPE_CLASS} AS scrape_class, {SQL_PROBE_CLASS} AS probe_class FROM b""",
)
def fetch_error_class(t: Tables):
    message = F.expr(ERROR_MESSAGE)
    return t.events.select(
        "event_id",
        A.scrape_error_class(message).alias("scrape_class"),
        A.probe_error_class(message, F.expr(ERROR_KIND)).alias("probe_class"),
    )


EVENT_STATUS = "CASE event_id % 11 WHEN 1 THEN 403 WHEN 2 THEN 429 WHEN 3 THEN 502 WHEN 4 THEN 404 ELSE 200 END"
EVENT_BODY = "CASE event_id % 17 WHEN 1 THEN 'Cloudflare' WHEN 2 THEN 'captcha' WHEN 3 THEN '' ELSE repeat(event_type || ' ', 30) END"


@query(
    "fetch_diagnosis",
    f"""WITH b AS (SELECT event_id, lower({ERROR_MESSAGE}) AS m, {EVENT_STATUS} AS s, lower({EVENT_BODY}) AS c FROM events),
    d AS (SELECT *, CASE WHEN event_id % 11 = 3 THEN 'no_response' WHEN contains(m, 'cloudflare') OR contains(c, 'cloudflare') THEN 'cloudflare'
      WHEN contains(m, 'captcha') OR contains(c, 'captcha') THEN 'captcha' WHEN s = 403 OR contains(m, '403') THEN 'blocked_403'
      WHEN s = 429 OR contains(m, 'rate limit') THEN 'rate_limited' WHEN s >= 500 THEN 'server_error_' || s
      WHEN s = 404 OR contains(m, 'soft 404') THEN 'not_found' WHEN contains(m, 'timeout') THEN 'timeout'
      WHEN contains(m, 'ssl') OR contains(m, 'certificate') THEN 'ssl_error' WHEN length(c) < 100 THEN 'empty_content'
      WHEN m <> '' THEN 'unknown_error' ELSE 'unknown' END AS diagnosis FROM b)
    SELECT event_id, diagnosis, CASE WHEN diagnosis = 'blocked_403' THEN 'waf' WHEN diagnosis = 'rate_limited' THEN 'rate_limit'
      WHEN starts_with(diagnosis, 'server_error') OR diagnosis = 'no_response' THEN 'connection_error' WHEN diagnosis IN ('not_found', 'empty_content') THEN 'empty_content'
      WHEN diagnosis = 'unknown_error' THEN {SQL_SCRAPE_CLASS} ELSE diagnosis END AS failure_type FROM d""",
)
def fetch_diagnosis(t: Tables):
    # Every eleventh call brought no page at all.
    came = F.col("event_id") % 11 != 3
    d = A.fetch_diagnosis(F.expr(EVENT_BODY), F.expr(ERROR_MESSAGE), F.expr(EVENT_STATUS), came)
    return t.events.select("event_id", d.alias("d")).select("event_id", "d.*")


@query(
    "slow_site",
    """SELECT event_id, slow, CAST(CASE WHEN slow THEN 10 ELSE 100 END AS BIGINT) AS subpage_cap FROM (
      SELECT event_id, value * 40 > 8000 OR value * 30 > 12000 OR value * 50 > 12000 AS slow FROM events)""",
)
def slow_site(t: Tables):
    v = F.col("value")
    slow = A.slow_site(v * 40, v * 30, v * 50)
    return t.events.select(
        "event_id", slow.alias("slow"), N.subpage_cap(slow).cast("long").alias("subpage_cap")
    )


@query(
    "robots_allowed",
    f"""WITH h AS (SELECT {SQL_SITE} AS host, page_id FROM pages)
    SELECT host, page_id, CASE length(host) % 4 WHEN 0 THEN 'false' WHEN 1 THEN 'true' WHEN 2 THEN 'false' ELSE 'unknown' END AS allowed FROM h""",
)
def robots_allowed(t: Tables):
    # One robots file per host, its rules chosen by the length of the host name.
    hosts = t.pages.select(U.url_domain(F.col("url")).alias("host"), "page_id")
    kind = F.length("host") % 4
    files = hosts.select("host").distinct().select(
        "host",
        F.when(kind == 0, "User-agent: *\nDisallow: /\n")
        .when(kind == 1, "User-agent: bad\nDisallow: /\nUser-agent: *\nDisallow: /tmp\n")
        .when(kind == 2, "User-agent: *\n Disallow: / \n")
        .alias("robots_txt"),
    )
    allowed = F.coalesce(F.col("allowed").cast("string"), F.lit("unknown"))
    return A.allowed_links(hosts, files).withColumn("allowed", allowed)


@query(
    "site_content",
    f"""WITH {SQL_SITE_PAGES}, b AS (SELECT site, page_ord, {SQL_BLOCK} AS block FROM ok)
    SELECT site, page_ord, CAST(coalesce(sum(length(block) + 2) OVER (PARTITION BY site ORDER BY page_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_offset,
      md5(block) AS digest FROM b""",
)
def site_content(t: Tables):
    # Read three times below; the texts are taken out of the markup once.
    pages = S.successful_pages(site_pages(t)).select("site", "page_ord", "url", "content")
    return S.site_content(staged(pages, "pages")).select("site", "page_ord", "char_offset", F.md5("block").alias("digest"))


@query(
    "min_site_content",
    f"""WITH {SQL_SITE_PAGES}, s AS (SELECT site, count(*) AS n_pages, length(string_agg({SQL_BLOCK}, chr(10) || chr(10))) AS chars FROM ok GROUP BY site)
    SELECT site, CAST(n_pages AS BIGINT) AS n_pages, CAST(chars AS BIGINT) AS chars FROM s WHERE chars >= 4000""",
)
def min_site_content(t: Tables):
    return S.min_site_content(S.successful_pages(site_pages(t)), at_least=4000)


@query(
    "site_links",
    f"""WITH {sql_links()} SELECT DISTINCT lower({SQL_NETLOC}) AS site, link FROM links WHERE kind = 'document'""",
)
def site_links(t: Tables):
    pages = page_links(t).select(
        U.url_domain(F.col("url")).alias("site"), F.col("found.documents").alias("document_links")
    )
    return S.site_document_links(pages)


@query("visited_urls", f"WITH {SQL_SITE_PAGES} SELECT site, page_ord, url FROM ok")
def visited_urls(t: Tables):
    return S.visited_urls(site_pages(t))


@query(
    "site_success_rate",
    f"""WITH {SQL_SITE_PAGES} SELECT site, CAST(count(*) AS BIGINT) AS n_pages,
    CAST(count(*) FILTER (length(content) >= 600) AS BIGINT) AS n_success,
    round(count(*) FILTER (length(content) >= 600) / count(*), 6) AS success_rate FROM sp GROUP BY site""",
)
def site_success_rate(t: Tables):
    # Pages under 600 characters are marked as failed, so that rates differ.
    marked = site_pages(t).withColumn("error", F.when(F.length("content") < 600, "short"))
    rates = S.site_success_rate(marked)
    return rates.withColumn("success_rate", F.round("success_rate", 6))

"""Facts over documents and parts: a source is a company, a document a chunk."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.registry import Tables, query
from tessera.catalog.text import SQL_WS
from tessera.functions import facts as X, text as T
from tessera.operators import facts as O
from tessera.session import staged


def sql_strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{SQL_WS}+', ''), '{SQL_WS}+$', '')"


def sql_collapse(c: str) -> str:
    return f"regexp_replace({sql_strip(c)}, '{SQL_WS}+', ' ', 'g')"


# Every line of every document is a fact. Its section follows from its place, and
# some lines get a word the routes look for.
LINE_WORD = """CASE (doc_id + line_no) % 17 WHEN 1 THEN ' empresa LTDA' WHEN 2 THEN ' CNPJ 12345678901234' WHEN 3 THEN ' fundada em 1990'
  WHEN 4 THEN ' nosso cliente' WHEN 5 THEN ' Certificação ISO' WHEN 6 THEN ' prêmio' WHEN 7 THEN ' parceiro' ELSE '' END"""
FACT_VALUE = """CASE WHEN line_no % 4 = 1 AND doc_id % 3 = 0 THEN concat('Contact', doc_id % 40, '@Mail.example.com ')
  WHEN line_no % 4 = 1 AND doc_id % 3 = 1 THEN concat('+55 ', 21000000 + doc_id % 50)
  WHEN line_no % 4 = 1 AND line_no % 8 = 1 THEN concat('https://site', doc_id % 30, '.example.com/a/?utm=', line_no)
  WHEN line_no % 4 = 2 AND doc_id % 2 = 0 THEN concat('Serviços de  sistemas ', line)
  ELSE concat(line, word) END"""


def document_facts(t: Tables):
    rows = t.documents.select(
        "doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    ).withColumn("word", F.expr(LINE_WORD))
    return rows.select(
        F.col("source").alias("cnpj_basico"),
        F.col("doc_id").alias("chunk_index"),
        F.col("line_no").cast("long").alias("ord"),
        F.expr("element_at(array('identity', 'contact', 'offerings', 'reputation'), line_no % 4 + 1)").alias("section"),
        F.expr(FACT_VALUE).alias("value"),
        F.concat(F.col("line"), F.col("word")).alias("evidence_quote"),
        F.lit(0.9).alias("confidence"),
        F.array(F.concat(F.lit("https://d"), F.col("doc_id"), F.lit(".example.com/"))).alias("page_source"),
    )


SQL_FACTS = f"""
raw AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
worded AS (SELECT *, {LINE_WORD} AS word FROM raw),
facts0 AS (SELECT source AS cnpj, doc_id AS chunk, line_no AS ord, ['identity', 'contact', 'offerings', 'reputation'][line_no % 4 + 1] AS section,
   {sql_strip(FACT_VALUE)} AS value, substr({sql_strip('line || word')}, 1, 320) AS quote FROM worded),
valid AS (SELECT * FROM facts0 WHERE value <> '' AND quote <> ''),
uniq AS (SELECT *, row_number() OVER (PARTITION BY cnpj, chunk, section, lower(value) ORDER BY ord) AS dup FROM valid),
bundle AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cnpj, chunk, section ORDER BY ord) AS rn FROM uniq WHERE dup = 1) WHERE rn <= 20)
"""
SQL_LABEL = f"""{sql_strip(
  "regexp_replace(regexp_replace(regexp_replace(array_to_string(list_filter(string_split(lower(v), ' '), lambda w: w NOT IN ('de', 'da', 'do', 'das', 'dos')), ' '), "
  "'(^|[^\\p{L}\\p{N}_])sistemas($|[^\\p{L}\\p{N}_])', '\\1sistema\\2', 'g'), '(^|[^\\p{L}\\p{N}_])serviços($|[^\\p{L}\\p{N}_])', '\\1serviço\\2', 'g'), "
  "'(^|[^\\p{L}\\p{N}_])soluções($|[^\\p{L}\\p{N}_])', '\\1solução\\2', 'g')")}"""
SQL_PRODUCT = "((regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]')) OR regexp_matches(lower(v), '(^|[^\\p{L}\\p{N}_])(modelo|código|sku|ref\\.?|reference)($|[^\\p{L}\\p{N}_])'))"
SQL_IDENTITY = """CASE WHEN contains(lower(v), 'cnpj') OR regexp_matches(v, '\\d{11,14}') THEN 'identity.cnpj'
   WHEN regexp_matches(lower(v), 'ltda|s\\.a|sa |me |eireli') THEN 'identity.company_name'
   WHEN regexp_matches(lower(v), 'fundada|desde') THEN 'identity.founding_year' ELSE 'identity.description' END"""
SQL_REPUTATION = """CASE WHEN regexp_matches(lower(quote), 'cliente|quem confia|cases') THEN 'reputation.client_list'
   WHEN regexp_matches(lower(quote), 'certificação|iso|anvisa|inmetro') THEN 'reputation.certifications'
   WHEN regexp_matches(lower(quote), 'prêmio|premiação|award') THEN 'reputation.awards'
   WHEN regexp_matches(lower(quote), 'parceria|parceiro|partner') THEN 'reputation.partnerships' END"""
SQL_ROUTES = f"""{SQL_FACTS},
norm AS (SELECT *, {sql_collapse('value')} AS v, 'https://d' || chunk || '.example.com/' AS url FROM bundle),
field0 AS (SELECT *, CASE section WHEN 'identity' THEN {SQL_IDENTITY}
   WHEN 'contact' THEN CASE WHEN contains(v, '@') THEN 'contact.emails' WHEN regexp_matches(v, '\\d{{8,}}') THEN 'contact.phones'
      WHEN starts_with(v, 'http://') OR starts_with(v, 'https://') THEN 'contact.website_url' WHEN length(v) >= 5 THEN 'contact.locations' END
   WHEN 'offerings' THEN CASE WHEN {SQL_PRODUCT} THEN 'offerings.products' ELSE 'offerings.services' END
   ELSE {SQL_REPUTATION} END AS field FROM norm),
routes AS (SELECT cnpj, chunk, ord, field, url, quote, CASE field WHEN 'contact.emails' THEN lower(v) WHEN 'contact.phones' THEN regexp_replace(v, '[^\\d+]', '', 'g')
   WHEN 'contact.website_url' THEN regexp_replace(regexp_replace(v, '[?#].*$', ''), '/$', '')
   WHEN 'offerings.services' THEN {SQL_LABEL} ELSE v END AS value FROM field0 WHERE field IS NOT NULL),
good AS (SELECT *, lower(value) AS key FROM routes WHERE value <> ''),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cnpj, field, key ORDER BY chunk, ord) AS seen FROM good WHERE NOT starts_with(field, 'identity.')) WHERE seen = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY cnpj, field ORDER BY chunk, ord) AS rn FROM firsts),
lists AS (SELECT cnpj AS cnpj_basico, field, rn, value FROM placed WHERE field <> 'contact.website_url'
   AND rn <= CASE WHEN field IN ('reputation.certifications', 'reputation.awards', 'reputation.partnerships') THEN 50 ELSE 80 END)
"""


def good_facts(t: Tables):
    return O.bundle_facts(O.validate_facts(document_facts(t)))


def list_query(section: str):
    sql = f"""WITH {SQL_ROUTES} SELECT cnpj_basico, field, CAST(rn AS BIGINT) AS pos, value FROM lists WHERE starts_with(field, '{section}.')"""

    def run(t: Tables):
        lists = O.capped_lists(O.first_values(O.routed(good_facts(t))))
        return lists.where(F.col("field").startswith(f"{section}.")).select(
            "cnpj_basico", "field", F.posexplode("items").alias("p", "value")
        ).select("cnpj_basico", "field", (F.col("p") + 1).cast("long").alias("pos"), "value")

    query(f"merge_{section}", sql)(run)


for _section in ("contact", "offerings", "reputation"):
    list_query(_section)


@query(
    "merge_identity",
    f"""WITH {SQL_ROUTES}
    SELECT cnpj AS cnpj_basico, coalesce(arg_min(value, chunk * 100000 + ord) FILTER (field = 'identity.company_name'), '') AS company_name,
      coalesce(arg_min(value, chunk * 100000 + ord) FILTER (field = 'identity.cnpj'), '') AS cnpj,
      coalesce(arg_min(value, chunk * 100000 + ord) FILTER (field = 'identity.founding_year'), '') AS founding_year,
      coalesce(arg_min(value, length(value)::HUGEINT * 100000000000 + chunk * 100000 + ord) FILTER (field = 'identity.description'), '') AS description
    FROM good WHERE starts_with(field, 'identity.') GROUP BY cnpj""",
)
def merge_identity(t: Tables):
    return O.merge_identity(O.routed(good_facts(t))).na.fill("")


@query(
    "evidence_map",
    f"""WITH {SQL_ROUTES},
    ev AS (SELECT cnpj, field, chunk, ord, url, quote FROM good WHERE starts_with(field, 'identity.') UNION ALL SELECT cnpj, field, chunk, ord, url, quote FROM firsts)
    SELECT cnpj AS cnpj_basico, field, CAST(rn AS BIGINT) AS pos, url, quote FROM (SELECT *, row_number() OVER (PARTITION BY cnpj, field ORDER BY chunk, ord) AS rn FROM ev) WHERE rn <= 20""",
)
def evidence_map(t: Tables):
    # Read twice, for the identity and for the lists.
    rows = O.evidence_map(staged(O.routed(good_facts(t)), "routes"))
    return (
        rows.select("cnpj_basico", F.explode("evidence_map").alias("field", "entries"))
        .select("cnpj_basico", "field", F.posexplode("entries").alias("p", "e"))
        .select("cnpj_basico", "field", (F.col("p") + 1).cast("long").alias("pos"), "e.url", "e.quote")
    )


@query("merge_website", f"WITH {SQL_ROUTES} SELECT cnpj AS cnpj_basico, value AS website_url FROM placed WHERE field = 'contact.website_url' AND rn = 1")
def merge_website(t: Tables):
    merged = O.merge_facts(good_facts(t))
    return merged.select("cnpj_basico", F.col("contact.website_url").alias("website_url")).where(
        F.col("website_url").isNotNull()
    )


@query(
    "bundle_metrics",
    f"""WITH {SQL_ROUTES}, tot AS (SELECT source AS cnpj, count(*) AS total FROM documents GROUP BY 1),
    us AS (SELECT cnpj, count(*) AS useful, sum(n) AS input_facts FROM (SELECT cnpj, chunk, count(*) AS n FROM bundle GROUP BY ALL) GROUP BY cnpj),
    it AS (SELECT cnpj_basico AS cnpj, count(*) AS merged_items FROM lists GROUP BY 1)
    SELECT cnpj AS cnpj_basico, total, coalesce(useful, 0) AS useful, CAST(coalesce(input_facts, 0) AS BIGINT) AS input_facts, coalesce(merged_items, 0) AS merged_items,
      total - coalesce(useful, 0) AS empty, round((total - coalesce(useful, 0)) / total, 6) AS empty_rate,
      CAST(greatest(0, coalesce(input_facts, 0) - coalesce(merged_items, 0)) AS BIGINT) AS dedupe_delta, TRUE AS has_size FROM tot LEFT JOIN us USING (cnpj) LEFT JOIN it USING (cnpj)""",
)
def bundle_metrics(t: Tables):
    facts = good_facts(t)
    chunks = t.documents.select(F.col("source").alias("cnpj_basico"))
    m = O.bundle_metrics(chunks, facts, O.merge_facts(facts))
    return m.select(
        "cnpj_basico", "total", "useful", "input_facts", "merged_items", "empty",
        F.round("empty_rate", 6).alias("empty_rate"), "dedupe_delta", (F.col("merged_size") > 0).alias("has_size"),
    )


@query(
    "validate_fact",
    f"""WITH {SQL_FACTS} SELECT cnpj AS cnpj_basico, chunk AS chunk_index, ord, section, md5(value) AS value, CAST(length(quote) AS BIGINT) AS quote_chars FROM valid""",
)
def validate_fact(t: Tables):
    return O.validate_facts(document_facts(t)).select(
        "cnpj_basico", "chunk_index", "ord", "section", F.md5("value").alias("value"),
        F.length("evidence_quote").cast("long").alias("quote_chars"),
    )


@query(
    "bundle_facts",
    f"WITH {SQL_FACTS} SELECT cnpj AS cnpj_basico, chunk AS chunk_index, ord, section FROM bundle",
)
def bundle_facts(t: Tables):
    return good_facts(t).select("cnpj_basico", "chunk_index", "ord", "section")


@query(
    "useful_bundles",
    f"WITH {SQL_FACTS} SELECT cnpj AS cnpj_basico, chunk AS chunk_index, count(*) AS useful_count FROM bundle GROUP BY ALL",
)
def useful_bundles(t: Tables):
    return O.useful_bundles(good_facts(t))


SQL_SPLIT = "unnest(string_split(text, chr(10)))"


@query(
    "extract_facts",
    f"""WITH l AS (SELECT doc_id, source, {SQL_SPLIT} AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
    s AS (SELECT *, substr({sql_strip('line')}, 1, 320) AS quote, lower({sql_strip('line')}) AS low FROM l),
    f AS (SELECT doc_id, source, line_no, 'identity' AS section, quote AS value FROM s WHERE regexp_matches(low, 'cnpj|ltda|eireli|fundada|desde')
     UNION ALL SELECT doc_id, source, line_no, 'contact', unnest(regexp_extract_all(line, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+')) FROM s
     UNION ALL SELECT doc_id, source, line_no, 'contact', unnest(regexp_extract_all(line, '\\d{{8,}}')) FROM s
     UNION ALL SELECT doc_id, source, line_no, 'contact', unnest(regexp_extract_all(line, 'https?://[^\\s<>"'']+')) FROM s
     UNION ALL SELECT doc_id, source, line_no, 'offerings', unnest(regexp_extract_all(line, '\\b[A-Z]{{1,5}}-?\\d{{2,}}[A-Z0-9]*\\b')) FROM s
     UNION ALL SELECT doc_id, source, line_no, 'reputation', quote FROM s WHERE regexp_matches(low, 'cliente|quem confia|cases|certificação|iso|anvisa|inmetro|prêmio|premiação|award|parceria|parceiro|partner'))
    SELECT source AS cnpj_basico, doc_id AS chunk_index, line_no, section, value FROM f""",
)
def extract_facts(t: Tables):
    chunks = t.documents.select(
        F.col("source").alias("cnpj_basico"),
        F.col("doc_id").alias("chunk_index"),
        F.col("text").alias("chunk_content"),
        F.array(F.lit("https://d.example.com/")).alias("page_source"),
    )
    return O.extract_facts(chunks).select(
        "cnpj_basico", "chunk_index", "ord.line_no", "section", "value"
    )


# Each line with a keyword word or none, so that every class occurs.
@query(
    "keyword_class",
    f"""WITH raw AS (SELECT doc_id, 0 AS line_no, text FROM documents), q AS (SELECT doc_id, text || {LINE_WORD} AS quote FROM raw)
    SELECT doc_id, coalesce({SQL_REPUTATION}, 'none') AS class FROM q""",
)
def keyword_class(t: Tables):
    quote = F.concat(F.col("text"), F.expr(LINE_WORD))
    field = F.concat(F.lit("reputation."), X.reputation_field(quote))
    return t.documents.withColumn("line_no", F.lit(0)).select(
        "doc_id", F.coalesce(field, F.lit("none")).alias("class")
    )


@query(
    "anti_template",
    f"""WITH l AS (SELECT source, doc_id, {SQL_SPLIT} AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
    h AS (SELECT *, array_to_string(list_filter(regexp_split_to_array(line, '{SQL_WS}+'), lambda x: x <> '')[1:3], ' ') AS head FROM l),
    a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, head ORDER BY doc_id, line_no) AS rn FROM h) WHERE rn <= 5)
    SELECT source, doc_id, line_no FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, line_no) AS rk FROM a) WHERE rk <= 40""",
)
def anti_template(t: Tables):
    lines = t.documents.select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    place = F.struct("doc_id", F.col("n").cast("long").alias("line_no")).alias("pos")
    return O.anti_template(lines.select("source", place, "line"), "source", "pos", "line").select("source", "pos.*")


@query(
    "cap_list",
    f"""WITH l AS (SELECT doc_id, {sql_strip('line')} AS item, line_no FROM (SELECT doc_id, {SQL_SPLIT} AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents)),
    u AS (SELECT doc_id, item, min(line_no) AS at_line FROM l WHERE item <> '' GROUP BY doc_id, item)
    SELECT doc_id, CAST(rn AS BIGINT) AS pos, item FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY at_line) AS rn FROM u) WHERE rn <= 10""",
)
def cap_list(t: Tables):
    items = T.unique_trimmed(F.split("text", "\n"), 10)
    return t.documents.select("doc_id", F.posexplode(items).alias("p", "item")).select(
        "doc_id", (F.col("p") + 1).cast("long").alias("pos"), "item"
    )


@query(
    "normalize_contact",
    """SELECT event_id, lower('User' || user_id || '@Mail.EXAMPLE.com') AS email, 'https://h' || user_id || '.example.com/' || event_type AS url,
      '+55' || (event_id + 10000000) AS phone, 'a ' || event_type || ' b' AS plain FROM events""",
)
def normalize_contact(t: Tables):
    user = F.col("user_id").cast("string")
    return t.events.select(
        "event_id",
        X.normalize_email(F.concat(F.lit("  User"), user, F.lit("@Mail.EXAMPLE.com\n"))).alias("email"),
        X.normalize_link(F.concat(F.lit(" https://h"), user, F.lit(".example.com/"), F.col("event_type"), F.lit("/?a=1#b"))).alias("url"),
        X.normalize_phone(F.concat(F.lit("+55 ("), (F.col("event_id") + 10000000).cast("string"), F.lit(") "))).alias("phone"),
        T.collapse(F.concat(F.lit("\t a \n\n "), F.col("event_type"), F.lit("   b\t"))).alias("plain"),
    )


SERVICE_TEXT = "concat(' Serviços de  ', p_type, ' das Soluções, sistemas ', p_name, ' do sistemas')"


@query(
    "service_label",
    f"WITH b AS (SELECT p_partkey, {sql_collapse(SERVICE_TEXT)} AS v FROM part) SELECT p_partkey, {SQL_LABEL} AS label FROM b",
)
def service_label(t: Tables):
    return t.part.select("p_partkey", X.service_label(F.expr(SERVICE_TEXT)).alias("label"))


PRODUCT_TEXT = "CASE p_partkey % 6 WHEN 0 THEN concat(p_name, ' X', p_size) WHEN 1 THEN concat(p_name, ' modelo') WHEN 2 THEN concat('Ref. ', p_name) WHEN 3 THEN concat('12 ', '34') WHEN 4 THEN concat('prefixo ', p_name) ELSE p_name END"


@query(
    "is_product",
    f"WITH b AS (SELECT p_partkey, {PRODUCT_TEXT} AS v FROM part) SELECT p_partkey, {SQL_PRODUCT} AS is_product FROM b",
)
def is_product(t: Tables):
    return t.part.select("p_partkey", X.is_product(F.expr(PRODUCT_TEXT)).alias("is_product"))


def sql_words(c: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array({c}, '{SQL_WS}+'), lambda w: w <> ''))"


@query(
    "texts_complementary",
    f"""WITH p AS (SELECT a.doc_id, lower({sql_strip('a.text')}) AS x, lower({sql_strip('b.text')}) AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
    w AS (SELECT doc_id, x, y, {sql_words('x')} AS wx, {sql_words('y')} AS wy FROM p)
    SELECT doc_id, x <> '' AND y <> '' AND NOT contains(x, y) AND NOT contains(y, x)
      AND len(list_intersect(wx, wy)) / greatest(len(wx), len(wy)) < 0.3::DOUBLE AS complementary FROM w""",
)
def texts_complementary(t: Tables):
    from tessera.functions.profile import texts_complementary as test

    docs = t.documents.select("doc_id", "text")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next_text"))
    return docs.join(after, "doc_id").select(
        "doc_id", test(F.col("text"), F.col("next_text")).alias("complementary")
    )


# Facts of every confidence, from pages of every rank.
PATHS = ["/sobre-nos", "/contato", "/", "/servicos", "/blog/x", "/quem-somos"]


def rated_facts(t: Tables):
    path = F.element_at(F.array(*[F.lit(p) for p in PATHS]), (F.col("chunk_index") % len(PATHS) + 1).cast("int"))
    url = F.concat(F.lit("https://d"), F.col("chunk_index"), F.lit(".example.com"), path)
    return good_facts(t).withColumns(
        {"confidence": F.lit(0.5) + (F.col("chunk_index") + F.col("ord")) % 5 / F.lit(10.0), "page_source": F.array(url)}
    )


@query(
    "best_supported",
    f"""WITH {SQL_ROUTES},
    rated AS (SELECT *, 0.5 + ((chunk + ord) % 5) / 10 AS conf, [1, 2, 3, 4, 5, 1][chunk % 6 + 1] AS rank FROM good),
    support AS (SELECT cnpj, field, key, max(conf) AS conf, count(DISTINCT chunk) AS chunks, min(rank) AS rank, min((chunk, ord)) AS place, arg_min(value, (chunk, ord)) AS value
      FROM rated GROUP BY cnpj, field, key)
    SELECT cnpj AS cnpj_basico, field, value, conf::DOUBLE AS confidence, chunks, rank AS page_rank
    FROM (SELECT *, row_number() OVER (PARTITION BY cnpj, field ORDER BY conf DESC, chunks DESC, rank, place) AS rn FROM support) WHERE rn = 1""",
)
def best_supported(t: Tables):
    return O.best_supported(O.routed(rated_facts(t)))

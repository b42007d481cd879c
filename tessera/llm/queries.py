"""The registered queries of the text operators, with check SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, exact_dedup, fill_in_middle, language, language_model, line_rules, packing, quality, simhash
from tessera.llm import substring_dedup, toxicity, url_filter, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FOLDED_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), rep AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1
), hit AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM win JOIN rep USING (g))
), gone AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id
), placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d
), kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM placed ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op1_substring_dedup", REPEATS_SQL)
def op1(spark, folder):
    found = substring_dedup.duplicate_factors(table(spark, folder, "documents"))
    # Factors may overlap: count the words from each one's start, or from the end reached before it.
    removed = F.aggregate(
        "factors",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("at")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(x["to"] - F.greatest(x["from"], s["at"]), F.lit(0))).alias("n"),
            F.greatest(s["at"], x["to"]).alias("at"),
        ),
        lambda s: s["n"],
    )
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op2_language_model")
def op2(spark, folder):
    return language_model.score_documents(table(spark, folder, "documents"))


def _hex(fingerprint):
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


@query("op3_simhash_near_dedup")
def op3(spark, folder):
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", _hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query("op4_toxicity")
def op4(spark, folder):
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op5_packing")
def op5(spark, folder):
    packed = packing.pack(table(spark, folder, "documents"), tokenizer_path())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


DECONTAMINATION_SQL = f"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all({FOLDED_SQL}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all({FOLDED_SQL}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM wins
), doc_wins AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, lengths WHERE len(w) >= n)
), found AS (SELECT doc_id, i, n, item_id FROM doc_wins JOIN wins USING (n, g)
), hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op6_benchmark_decontamination", DECONTAMINATION_SQL)
def op6(spark, folder):
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op7_language_id")
def op7(spark, folder):
    return language.identify(table(spark, folder, "documents"))


EXACT_SQL = f"""
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256({FOLDED_SQL}) AS h FROM documents)
"""


@query("op8_exact_dedup", EXACT_SQL)
def op8(spark, folder):
    return exact_dedup.batched_duplicates(table(spark, folder, "documents"))


#: Fixed values of the contract: host, path, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

URL_SQL = r"""
WITH parsed AS (
  SELECT page_id,
         CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), judged AS (
  SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
         CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
              WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
              WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parsed
)
SELECT *, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""


@query("op9_url_filter", URL_SQL)
def op9(spark, folder):
    listed = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, folder, "pages"), listed)


@query("op10_quality_classifier")
def op10(spark, folder):
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op11_embedding_whitening")
def op11(spark, folder):
    return whitening.whiten(table(spark, folder, "embeddings"))


_PHRASES = "|".join(line_rules.PHRASES)
_SEPARATORS = ", ".join(f"'{x}'" for x in line_rules.SEPARATORS)
QUALITY_RULES_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), rep AS (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1
), hit AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win JOIN rep USING (doc_id, g)) GROUP BY doc_id
), lines AS (
  SELECT doc_id, pos, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d)
), counted AS (
  SELECT doc_id, pos, line, len(w) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS again,
         len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]'))) AS symbols,
         len(list_filter(w, lambda x: regexp_matches(x, '(!!|[?][?])$'))) AS shouted,
         len(list_filter(w, lambda x: length(regexp_replace(x, '[^A-Z]', '', 'g')) >= 2 AND NOT regexp_matches(x, '[a-z]'))) AS capitals,
         len(list_filter(w, lambda x: x IN ({_SEPARATORS}))) AS separators,
         regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_PHRASES}') AS phrase
  FROM lines WHERE len(w) > 0
), judged AS (
  SELECT *, again OR phrase OR 100 * symbols > 20 * n OR 100 * shouted > 20 * n OR (100 * capitals > 60 * n AND n >= 4)
            OR (100 * separators > 15 * n AND separators >= 2) AS fails FROM counted
), summed AS (
  SELECT doc_id, count(*) FILTER (again) AS n_dup, count(*) FILTER (fails) AS n_removed, coalesce(sum(n) FILTER (fails), 0) AS lost,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT fails), '') AS cleaned
  FROM judged GROUP BY doc_id
), base AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
         coalesce(n_repeat, 0) AS n_repeat_words, coalesce(n_removed, 0) AS n_lines_removed, CAST(coalesce(lost, 0) AS BIGINT) AS n_words_removed,
         sha256(coalesce(cleaned, '')) AS cleaned_sha256
  FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN summed USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_words_removed <= 50 * n_words AS kept
FROM base
"""


@query("op12_quality_rules", QUALITY_RULES_SQL)
def op12(spark, folder):
    found = line_rules.clean_lines(table(spark, folder, "documents"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "n_words_removed"]
    return found.select("doc_id", *counts, F.sha2(F.col("cleaned").cast("binary"), 256).alias("cleaned_sha256"))


MIDDLE_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents
), draws AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d
), cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS x, greatest(h1 % (n + 1), h2 % (n + 1)) AS y,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM draws
), parts AS (
  SELECT *, coalesce(array_to_string(u[1:x], ''), '') AS p, coalesce(array_to_string(u[x + 1:y], ''), '') AS m,
         coalesce(array_to_string(u[y + 1:], ''), '') AS s FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


@query("op13_fill_in_middle", MIDDLE_SQL)
def op13(spark, folder):
    found = fill_in_middle.restored(fill_in_middle.fill_in_middle(table(spark, folder, "documents")))
    digest = lambda name: F.sha2(F.col(name).cast("binary"), 256).alias(f"{name}_sha256")
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))

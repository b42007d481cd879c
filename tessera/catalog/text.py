"""Text, token and line operators over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.registry import Tables, query
from tessera.functions import text as T, tokens as K
from tessera.operators import lines as L

# SQL pieces shared by the check queries of this module.
SQL_WS = T.WS
SQL_EOL = r"(\r\n|[\r\n\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}])"
SQL_LINES = f"""
cut AS (
  SELECT doc_id, text,
         list_filter(string_split(regexp_replace(text, '{SQL_EOL}', '\\1' || chr(1), 'g'), chr(1)),
                     lambda x: x <> '') AS ls
  FROM documents),
ln AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM cut),
keyed AS (
  SELECT *, regexp_replace(line, '{SQL_WS}+$', '') AS k FROM ln),
marked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY pos) AS seen,
         lag(k) OVER (PARTITION BY doc_id ORDER BY pos) AS prev
  FROM keyed)
"""
SQL_TIDY = """regexp_replace(regexp_replace(
  array_to_string(list_transform(
    string_split(regexp_replace({0}, '(\\r\\n|[\\r\\n\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}])$', ''), chr(10)),
    lambda x: regexp_replace(x, '{1}+$', '') || chr(10)), ''),
  '^\\n{{3,}}', chr(10) || chr(10)), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')"""


def tidy_sql(column: str) -> str:
    return SQL_TIDY.format(column, SQL_WS)


@query(
    "dedupe_lines_document",
    f"""WITH {SQL_LINES}
    SELECT doc_id, md5(string_agg(line, '' ORDER BY pos)) AS digest,
           CAST(sum(length(line)) AS BIGINT) AS chars
    FROM marked WHERE length(k) < 5 OR seen = 1 GROUP BY doc_id""",
)
def dedupe_lines_document(t: Tables):
    out = t.documents.select("doc_id", L.dedupe_lines(F.col("text")).alias("body"))
    return out.select(
        "doc_id", F.md5("body").alias("digest"), F.length("body").cast("long").alias("chars")
    )


@query(
    "dedupe_lines_consecutive",
    f"""WITH {SQL_LINES}
    SELECT doc_id, md5(string_agg(line, '' ORDER BY pos)) AS digest,
           CAST(sum(length(line)) AS BIGINT) AS chars
    FROM marked WHERE length(k) < 5 OR prev IS NULL OR prev <> k GROUP BY doc_id""",
)
def dedupe_lines_consecutive(t: Tables):
    out = t.documents.select("doc_id", L.dedupe_lines(F.col("text"), "consecutive").alias("body"))
    return out.select(
        "doc_id", F.md5("body").alias("digest"), F.length("body").cast("long").alias("chars")
    )


# The given texts hold no blank runs, so every sentence that ends a line is
# followed by some: the same rule on both sides and over every whole text.
@query(
    "normalize_whitespace",
    f"""WITH wide AS (SELECT doc_id, regexp_replace(text, '[.]\\n', '.  ' || chr(10) || chr(10) || chr(10) || chr(10) || ' ' || chr(10), 'g') AS text FROM documents)
    SELECT doc_id, md5({tidy_sql('text')}) AS digest,
           CAST(length({tidy_sql('text')}) AS BIGINT) AS chars FROM wide""",
)
def normalize_whitespace(t: Tables):
    wide = F.regexp_replace("text", r"[.]\n", ".  \n\n\n\n \n")
    out = t.documents.select("doc_id", L.normalize_whitespace(wide).alias("body"))
    return out.select(
        "doc_id", F.md5("body").alias("digest"), F.length("body").cast("long").alias("chars")
    )


@query(
    "dedupe_stats",
    f"""WITH {SQL_LINES},
    kept AS (
      SELECT doc_id, string_agg(line, '' ORDER BY pos) AS body, count(*) AS n
      FROM marked WHERE length(k) < 5 OR seen = 1 GROUP BY doc_id),
    j AS (
      SELECT c.doc_id, len(c.ls) AS original_lines, k.n AS unique_lines, length(c.text) AS original_chars,
             length(k.body) AS deduped_chars, length({tidy_sql('k.body')}) AS final_chars
      FROM cut c JOIN kept k USING (doc_id))
    SELECT doc_id, CAST(original_lines AS BIGINT) AS original_lines,
           CAST(unique_lines AS BIGINT) AS unique_lines,
           CAST(original_lines - unique_lines AS BIGINT) AS removed_lines,
           round((original_lines - unique_lines) / original_lines * 100, 6) AS removed_percent,
           CAST(original_chars AS BIGINT) AS original_chars,
           CAST(deduped_chars AS BIGINT) AS deduped_chars,
           CAST(final_chars AS BIGINT) AS final_chars,
           round((original_chars - final_chars) / original_chars * 100, 6) AS reduction_percent
    FROM j""",
)
def dedupe_stats(t: Tables):
    s = t.documents.select("doc_id", L.dedupe_stats(F.col("text")).alias("s")).select("doc_id", "s.*")
    return s.withColumns(
        {c: F.round(c, 6) for c in ("removed_percent", "reduction_percent")}
    )


@query(
    "content_quality",
    f"""WITH b AS (
      SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents)
    SELECT doc_id, CAST(length(text) AS BIGINT) AS total_length,
      CAST(len(regexp_extract_all(text, '{SQL_WS}')) AS BIGINT) AS whitespace_chars,
      CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS newlines,
      CAST(length(text) - length(replace(text, chr(9), '')) AS BIGINT) AS tabs,
      CAST(length(text) - length(replace(text, ' ', '')) AS BIGINT) AS spaces,
      CAST(len(regexp_extract_all(text, '\\n{{3,}}')) AS BIGINT) AS long_newline_runs,
      CAST(len(regexp_extract_all(text, ' {{3,}}')) AS BIGINT) AS long_space_runs,
      CAST(len(regexp_extract_all(text, '[^\\x00-\\x7f]')) AS BIGINT) AS non_ascii_chars,
      CAST(len(regexp_extract_all(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')) AS BIGINT) AS control_chars,
      CAST(len(list_filter(ls, lambda x, i: i > 1 AND x = ls[i - 1] AND trim(x) <> '')) AS BIGINT) AS duplicate_lines,
      CAST(len(ls) AS BIGINT) AS total_lines,
      round((length(text) - len(ls) + 1) / len(ls), 6) AS avg_line_length,
      contains(text, '--- PAGE START:') AS has_page_marks, CAST(1 AS BIGINT) AS num_pages
    FROM b""",
)
def content_quality(t: Tables):
    q = t.documents.select("doc_id", L.content_quality(F.col("text")).alias("q")).select("doc_id", "q.*")
    return q.withColumn("avg_line_length", F.round("avg_line_length", 6))


@query(
    "estimate_tokens",
    """SELECT doc_id, CAST(length(text) // 3 AS BIGINT) AS tokens,
       CAST(length(text) // 3 + 2500 AS BIGINT) AS tokens_with_overhead FROM documents""",
)
def estimate_tokens(t: Tables):
    return t.documents.select(
        "doc_id",
        K.estimate_tokens(F.col("text")).alias("tokens"),
        K.estimate_tokens(F.col("text"), overhead=True).alias("tokens_with_overhead"),
    )


@query(
    "message_tokens",
    """SELECT conv_id, CAST(count(*) AS BIGINT) AS messages,
       CAST(greatest(100, sum(length(text)) // 3 + 100 * count(*)) AS BIGINT) AS tokens
       FROM conversations GROUP BY conv_id""",
)
def message_tokens(t: Tables):
    # Lengths are summed map-side, so texts never enter the shuffle.
    sized = t.conversations.select("conv_id", F.length("text").alias("chars"))
    return (
        sized.groupBy("conv_id")
        .agg(F.count("*").alias("messages"), F.sum("chars").alias("chars"))
        .select(
            "conv_id", "messages", K.message_tokens(F.col("chars"), F.col("messages")).alias("tokens")
        )
    )


@query(
    "repetition_rate",
    """WITH b AS (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS ls FROM documents)
    SELECT doc_id, round((len(ls) - len(list_distinct(ls))) / len(ls), 6) AS rate FROM b""",
)
def repetition_rate(t: Tables):
    return t.documents.select("doc_id", F.round(K.repetition_rate(F.col("text")), 6).alias("rate"))


@query(
    "safety_margin",
    """WITH b AS (SELECT doc_id, length(text) // 3 AS tokens,
        string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS ls FROM documents),
    r AS (SELECT doc_id, tokens, (len(ls) - len(list_distinct(ls))) / len(ls) AS rate FROM b),
    m AS (SELECT *, greatest(
        CASE WHEN rate > 0.9 THEN 0.15 WHEN rate > 0.8 THEN 0.10 WHEN rate > 0.7 THEN 0.05 ELSE 0.0 END::DOUBLE,
        CASE WHEN tokens > 80000 THEN 0.25 WHEN tokens > 75000 THEN 0.20 WHEN tokens > 70000 THEN 0.15
             WHEN tokens > 60000 THEN 0.10 WHEN tokens > 50000 THEN 0.05 ELSE 0.0 END::DOUBLE) AS plain FROM r),
    f AS (SELECT *, CASE WHEN tokens > floor(1500.0::DOUBLE * (1 - plain))
        THEN least(1 - tokens / 1500.0::DOUBLE + 0.05::DOUBLE, 0.30::DOUBLE) ELSE plain END AS margin FROM m)
    SELECT doc_id, round(margin, 6) AS margin, CAST(trunc(1500.0::DOUBLE * (1 - margin)) AS BIGINT) AS token_limit FROM f""",
)
def safety_margin(t: Tables):
    c = F.col("text")
    margin = K.safety_margin(K.repetition_rate(c), K.estimate_tokens(c), 1500)
    return t.documents.select("doc_id", margin.alias("m")).select(
        "doc_id", F.round("m.margin", 6).alias("margin"), F.col("m.limit").alias("token_limit")
    )


@query(
    "effective_max",
    """SELECT doc_id, CAST(14705 AS BIGINT) AS effective_max, length(text) // 3 <= 14705 AS fits,
       CAST(ceil((length(text) // 3) / 14705.0) AS BIGINT) AS chunks_at_least FROM documents""",
)
def effective_max(t: Tables):
    limit = K.effective_max()
    tokens = K.estimate_tokens(F.col("text"))
    return t.documents.select(
        "doc_id",
        F.lit(limit).cast("long").alias("effective_max"),
        (tokens <= limit).alias("fits"),
        F.ceil(tokens / limit).cast("long").alias("chunks_at_least"),
    )


@query(
    "max_output_tokens",
    """WITH c AS (SELECT conv_id, greatest(100, sum(length(text)) // 3 + 100 * count(*)) * 8 AS tokens
      FROM conversations GROUP BY conv_id),
    b AS (SELECT conv_id, tokens, least(CASE WHEN tokens < 3000 THEN 900 WHEN tokens < 8000 THEN 1400 ELSE 2200 END, 4096) AS budget FROM c)
    SELECT conv_id, CAST(tokens AS BIGINT) AS tokens, CAST(budget AS BIGINT) AS budget,
           CAST(floor(budget * 0.75) AS BIGINT) AS retry_budget FROM b""",
)
def max_output_tokens(t: Tables):
    sized = (
        t.conversations.groupBy("conv_id")
        .agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("n"))
        .select("conv_id", (K.message_tokens(F.col("chars"), F.col("n")) * 8).alias("tokens"))
    )
    limit = F.lit(4096)
    return sized.select(
        "conv_id",
        "tokens",
        K.max_output_tokens(F.col("tokens"), limit).alias("budget"),
        K.max_output_tokens(F.col("tokens"), limit, loop_retry=True).alias("retry_budget"),
    )


SQL_LOOP = """
words AS (SELECT {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w, text FROM src),
grams AS (SELECT {key}, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM words WHERE len(w) >= 4),
gram_hits AS (SELECT DISTINCT {key} FROM (SELECT {key}, g FROM grams GROUP BY ALL HAVING count(*) > 20)),
cuts AS (SELECT {key}, unnest(list_transform(range(0, length(text) - 30, 10), lambda i: regexp_replace(regexp_replace(text[i + 1:i + 30], '^{ws}+', ''), '{ws}+$', ''))) AS s FROM src WHERE length(text) > 30),
cut_hits AS (SELECT DISTINCT {key} FROM (SELECT {key}, s FROM cuts WHERE length(s) >= 20 GROUP BY ALL HAVING count(*) > 15))
"""


def loop_sql(key: str) -> str:
    return SQL_LOOP.format(key=key, ws=SQL_WS)


@query(
    "repetition_loop",
    f"""WITH src AS (SELECT doc_id, text FROM documents), {loop_sql('doc_id')}
    SELECT s.doc_id, length(s.text) >= 100 AND (
        s.doc_id IN (SELECT doc_id FROM gram_hits) OR s.doc_id IN (SELECT doc_id FROM cut_hits)
        OR (length(s.text) > 8000 AND NOT regexp_matches(s.text, '\\}}{SQL_WS}*$'))) AS looping FROM src s""",
)
def repetition_loop(t: Tables):
    return t.documents.select("doc_id", K.repetition_loop(F.col("text")).alias("looping"))


@query(
    "raw_content_report",
    """SELECT doc_id, CAST(length(text) AS BIGINT) AS content_length, CAST(length(text) // 3 AS BIGINT) AS tokens,
       CAST(length(text) // 3 + 2500 AS BIGINT) AS tokens_with_overhead, CAST(1 AS BIGINT) AS num_pages,
       length(text) // 3 + 2500 > 4000 AS exceeds_limit FROM documents""",
)
def raw_content_report(t: Tables):
    c = F.col("text")
    full = K.estimate_tokens(c, overhead=True)
    return t.documents.select(
        "doc_id",
        F.length(c).cast("long").alias("content_length"),
        K.estimate_tokens(c).alias("tokens"),
        full.alias("tokens_with_overhead"),
        L.page_count(c).alias("num_pages"),
        (full > 4000).alias("exceeds_limit"),
    )

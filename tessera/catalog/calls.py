"""Call logs and streams over events, conversations and orders.

Events stand for calls: the user is the provider, domain or proxy, an ``error``
is a failure and the value is the latency.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.registry import Tables, query
from tessera.operators import discovery as D, monitoring as M
from tessera.session import scratch_folder
from tessera.streaming import keyed, stages

AS_OF_US = 1706658600000000  # 2024-01-30 23:50:00 UTC
FAILURE = "CASE event_id % 4 WHEN 0 THEN 'rate_limit' WHEN 1 THEN 'timeout' ELSE 'error' END"


def calls(events):
    return events.select(
        F.col("user_id").alias("provider"),
        F.col("event_id").alias("call_id"),
        M.micros(F.col("ts")).alias("t_us"),
        (F.col("event_type") != "error").alias("ok"),
        F.expr(FAILURE).alias("failure_type"),
        (F.col("value") * 300).alias("latency_ms"),
    )


def attempts(events, key: str):
    """More failures than the table has: signups fail too, clicks are protections."""
    ok = ~F.col("event_type").isin("error", "signup", "click")
    return events.select(
        (F.col("user_id") % 40).alias(key),
        F.col("event_id").alias("call_id"),
        F.floor(M.micros(F.col("ts")) / F.lit(100)).cast("long").alias("t_us"),
        ok.alias("ok"),
        (F.col("event_type") == "click").alias("is_protection"),
    )


def requests(events):
    return events.select(
        F.concat_ws(":", "user_id", "event_type").alias("key"),
        F.col("event_id").alias("call_id"),
        F.floor(M.micros(F.col("ts")) / F.lit(30)).cast("long").alias("t_us"),
        (F.col("value") > 10).alias("has_results"),
    )


SQL_HEALTH = f"""
c AS (SELECT user_id AS provider, event_id AS call_id, epoch_us(ts) AS t_us, event_type <> 'error' AS ok, {FAILURE} AS failure_type, value * 300 AS latency_ms FROM events),
n AS (SELECT provider, count(*) AS total, count(*) FILTER (ok) AS success, count(*) FILTER (NOT ok AND failure_type = 'rate_limit') AS rate_limits,
  count(*) FILTER (NOT ok AND failure_type = 'timeout') AS timeouts, count(*) FILTER (NOT ok AND failure_type = 'error') AS errors,
  max(t_us) FILTER (NOT ok) AS last_failure_us FROM c GROUP BY provider),
r AS (SELECT provider, round(avg(latency_ms), 6) AS avg_latency_ms FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY t_us DESC, call_id DESC) AS rn
   FROM c WHERE ok OR latency_ms > 0) WHERE rn <= 50 GROUP BY provider),
parts AS (SELECT *, success / total * 100 AS sp, CASE WHEN avg_latency_ms <= 3000 THEN 100 WHEN avg_latency_ms >= 25000 THEN 0
    ELSE (1 - (avg_latency_ms - 3000) / 22000) * 100 END::DOUBLE AS lp, (1 - least(rate_limits / total * 5, 1.0)) * 100 AS rp,
  CASE WHEN last_failure_us IS NULL THEN 100 WHEN ({AS_OF_US} - last_failure_us) / 1e6 < 10 THEN 30 WHEN ({AS_OF_US} - last_failure_us) / 1e6 < 60 THEN 60
    WHEN ({AS_OF_US} - last_failure_us) / 1e6 < 300 THEN 80 ELSE 100 END::DOUBLE AS cp FROM n JOIN r USING (provider)),
health AS (SELECT provider, total, success, rate_limits, timeouts, errors, avg_latency_ms,
   CAST(greatest(0, least(100, floor(sp * 0.40::DOUBLE + lp * 0.30::DOUBLE + rp * 0.20::DOUBLE + cp * 0.10::DOUBLE))) AS BIGINT) AS health_score FROM parts),
labelled AS (SELECT *, CASE WHEN health_score > 60 THEN 'HEALTHY' WHEN health_score > 30 THEN 'DEGRADED' ELSE 'UNHEALTHY' END AS status FROM health)
"""
HEALTH_OUT = ["provider", "total", "success", "rate_limits", "timeouts", "errors", "health_score", "status"]


@query("provider_health", f"WITH {SQL_HEALTH} SELECT {', '.join(HEALTH_OUT)}, round(avg_latency_ms, 4) AS avg_latency_ms FROM labelled")
def provider_health(t: Tables):
    health = M.provider_health(calls(t.events), AS_OF_US)
    return health.select(*HEALTH_OUT, F.round("avg_latency_ms", 4).alias("avg_latency_ms"))


@query("healthy_ranked", f"WITH {SQL_HEALTH} SELECT provider, health_score FROM labelled WHERE health_score > 30")
def healthy_ranked(t: Tables):
    return M.healthy_ranked(M.provider_health(calls(t.events), AS_OF_US)).select("provider", "health_score")


@query("best_provider", f"WITH {SQL_HEALTH} SELECT provider FROM labelled WHERE health_score > 30 ORDER BY health_score DESC, provider LIMIT 1")
def best_provider(t: Tables):
    return M.best_provider(M.provider_health(calls(t.events), AS_OF_US))


@query(
    "call_stats",
    f"""WITH c AS (SELECT user_id AS provider, event_type <> 'error' AS ok, {FAILURE} AS failure_type, CAST(value AS DECIMAL(18, 2)) * 300 AS latency_ms FROM events)
    SELECT provider, count(*) AS total, count(*) FILTER (ok) AS success, count(*) FILTER (NOT ok) AS failed,
      count(*) FILTER (NOT ok AND failure_type = 'rate_limit') AS rate_limited, round(count(*) FILTER (ok) / count(*) * 100, 1) AS success_percent,
      round((sum(latency_ms) FILTER (ok))::DOUBLE / count(*) FILTER (ok), 2) AS avg_latency_ms FROM c GROUP BY provider""",
)
def call_stats(t: Tables):
    # Latencies have two decimals; as decimals their sum is exact in any order.
    exact = calls(t.events).withColumn("latency_ms", F.round("latency_ms").cast("long"))
    return M.call_stats(exact, "provider")


@query(
    "last_n_latency",
    """SELECT user_id AS provider, event_id AS call_id, round(avg(value * 300) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 4) AS avg_latency FROM events""",
)
def last_n_latency(t: Tables):
    moving = M.last_n_latency(calls(t.events))
    return moving.select("provider", "call_id", F.round("avg_latency", 4).alias("avg_latency"))


SQL_RATES = """
SELECT user_id || ':' || event_type AS key, epoch_us(ts) // 30 // 3600000000 AS hour, count(*) AS requests, count(*) - 1 AS repeats, (count(*) - 1) / count(*) AS repeat_rate
FROM events GROUP BY ALL
"""


# Shared fetches as a recursive walk over the numbered requests of each key.
SQL_SHARED = """
WITH RECURSIVE a AS (SELECT user_id || ':' || event_type AS k, event_id AS call_id, epoch_us(ts) // 30 AS t_us, value > 10 AS has,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) // 30, event_id) AS rn FROM events),
w AS (
  SELECT k, CAST(0 AS BIGINT) AS rn, CAST(-1 AS BIGINT) AS call_id, CAST(-1 AS BIGINT) AS made, FALSE AS is_hit, CAST(0 AS BIGINT) AS answered FROM (SELECT DISTINCT k FROM a)
  UNION ALL
  SELECT k, rn, call_id, CASE WHEN hit THEN made WHEN has THEN t_us ELSE -1 END, hit, CASE WHEN hit THEN made ELSE t_us END
  FROM (SELECT a.*, w.made, w.made >= 0 AND a.t_us - w.made <= 3600000000 AS hit FROM w JOIN a ON a.k = w.k AND a.rn = w.rn + 1))
SELECT k AS key, call_id, is_hit, answered AS answered_by_us FROM w WHERE rn > 0
"""


@query(
    "cache_hit_rate",
    f"SELECT count(*) FILTER (is_hit) AS hits, count(*) FILTER (NOT is_hit) AS misses, count(*) FILTER (is_hit) / count(*) AS hit_rate FROM ({SQL_SHARED})",
)
def cache_hit_rate(t: Tables):
    return M.cache_hit_rate(M.request_coalesce(requests(t.events)))


# Outages as islands between gaps.
SQL_OUTAGES = f"""
WITH f AS (SELECT user_id % 40 AS domain, epoch_us(ts) // 100 AS t FROM events WHERE event_type IN ('error', 'signup', 'click')),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY domain ORDER BY t) > {M.OUTAGE_GAP_US} THEN 1 ELSE 0 END AS opens FROM f),
i AS (SELECT *, sum(opens) OVER (PARTITION BY domain ORDER BY t ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT domain, min(t) AS from_us, max(t) AS to_us, count(*) AS failures FROM i GROUP BY domain, island
"""


@query("outage_sessions", SQL_OUTAGES)
def outage_sessions(t: Tables):
    return M.outage_sessions(attempts(t.events, "domain"))


@query(
    "outage_episodes",
    """WITH a AS (SELECT user_id % 40 AS domain, event_id AS call_id, epoch_us(ts) // 100 AS t_us, event_type NOT IN ('error', 'signup', 'click') AS ok FROM events),
    g AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY domain ORDER BY t_us, call_id) AS run FROM a)
    SELECT domain, CAST(row_number() OVER (PARTITION BY domain ORDER BY min(t_us), min(call_id)) AS BIGINT) AS episode, min(t_us) AS from_us, max(t_us) AS to_us, count(*) AS failures
    FROM g WHERE NOT ok GROUP BY domain, run HAVING count(*) >= 2""",
)
def outage_episodes(t: Tables):
    return M.outage_episodes(attempts(t.events, "domain"), 2)


@query("repeat_request_rate", SQL_RATES)
def repeat_request_rate(t: Tables):
    return M.repeat_request_rate(requests(t.events))


LIMITS = [
    M.ModelLimit("primary", 4096, 1024, primary=True),
    M.ModelLimit("small", 3500, 500),
    M.ModelLimit("wide", 131072, 8192),
]


@query(
    "fits_context",
    """WITH s AS (SELECT conv_id, greatest(100, sum(length(text)) // 3 + 100 * count(*)) AS tokens FROM conversations GROUP BY conv_id)
    SELECT conv_id, CAST(tokens AS BIGINT) AS tokens, array_to_string(list_filter([CASE WHEN tokens <= 3276 THEN 'primary' END, CASE WHEN tokens <= 500 THEN 'small' END,
      CASE WHEN tokens <= 120380 THEN 'wide' END], lambda x: x IS NOT NULL), ',') AS providers FROM s""",
)
def fits_context(t: Tables):
    sized = t.conversations.groupBy("conv_id").agg(
        F.greatest(F.lit(100), F.floor(F.sum(F.length("text")) / 3) + 100 * F.count("*")).cast("long").alias("tokens")
    )
    fit = M.fitting_providers(F.col("tokens"), LIMITS)
    return sized.select("conv_id", "tokens", F.array_join(fit, ",").alias("providers"))


def model_answers(t: Tables):
    """Each turn as the answer of a model, with usage numbers."""
    size = F.length("text")
    usage = F.struct(
        (F.floor(size / 3) + F.col("turn") * 5).alias("prompt_tokens"),
        F.floor(size / 4).alias("completion_tokens"),
        (F.floor(size / 3) + F.col("turn") * 5 + F.floor(size / 4)).alias("total_tokens"),
    )
    choice = F.struct(F.struct(F.col("text").alias("content")).alias("message"), F.lit("stop").alias("finish_reason"))
    answer = F.struct(
        F.concat(F.lit("/data/models/org/"), F.col("role")).alias("model"),
        usage.alias("usage"),
        F.array(choice).alias("choices"),
    )
    return t.conversations.select(
        "conv_id", "turn", F.floor(size / 3).cast("long").alias("estimated_tokens"), F.to_json(answer).alias("response")
    )


@query(
    "token_usage",
    """WITH u AS (SELECT conv_id, turn, role AS model, length(text) // 3 AS est, length(text) // 3 + turn * 5 AS p, length(text) // 4 AS c, length(text) AS n FROM conversations)
    SELECT conv_id, turn, model, CAST(p AS BIGINT) AS prompt_tokens, CAST(c AS BIGINT) AS completion_tokens, CAST(p + c AS BIGINT) AS total_tokens,
      coalesce(CASE WHEN p > 0 AND n > 0 THEN round(c / n, 4) END, -1.0)::DOUBLE AS tokens_per_char, CAST(p - est AS BIGINT) AS estimate_error,
      CASE WHEN est > 0 THEN abs((p - est) / est * 100) > 10 ELSE FALSE END AS far_off FROM u""",
)
def token_usage(t: Tables):
    usage = M.token_usage(model_answers(t))
    return usage.select(
        "conv_id", "turn", "model", "prompt_tokens", "completion_tokens", "total_tokens",
        F.coalesce("tokens_per_char", F.lit(-1.0)).alias("tokens_per_char"), "estimate_error", "far_off",
    )


@query(
    "usage_by_model",
    """SELECT role AS model, count(*) AS calls, CAST(sum(length(text) // 3 + turn * 5) AS BIGINT) AS prompt_tokens, CAST(sum(length(text) // 4) AS BIGINT) AS completion_tokens,
      CAST(sum(length(text) // 3 + turn * 5 + length(text) // 4) AS BIGINT) AS total_tokens,
      count(*) FILTER (length(text) // 3 > 0 AND turn * 5 / (length(text) // 3) * 100 > 10) AS far_off FROM conversations GROUP BY role""",
)
def usage_by_model(t: Tables):
    return M.usage_by_model(M.token_usage(model_answers(t)))


@query(
    "model_name",
    """SELECT p_partkey, p_type AS model, CASE WHEN length(p_name) > 9 THEN p_name[1:9] || '... [truncated, original length: ' || length(p_name) || ']' ELSE p_name END AS note FROM part""",
)
def model_name(t: Tables):
    long_name = F.concat(F.lit("/data/models/"), F.col("p_brand"), F.lit("/"), F.col("p_type"), F.lit(" "))
    return t.part.select(
        "p_partkey", M.model_name(long_name).alias("model"), M.truncate_note(F.col("p_name"), 9).alias("note")
    )


# --- streams --------------------------------------------------------------


#: Ranges of time, and the files each is written in; a stream takes one range a micro-batch.
SLOTS = 5
SLOT_FILES = 4


def write_slots(rows, ts: str, folder: str, backwards: bool = False, only=None) -> None:
    """``rows`` as files, one range of time after the other, each range by several tasks."""
    low, high = rows.agg(F.min(ts), F.max(ts)).first()
    if low is None:
        return
    share = (M.micros(F.col(ts)) - M.micros(F.lit(low))) / (M.micros(F.lit(high)) - M.micros(F.lit(low)) + 1)
    slot = F.floor(share * SLOTS)
    for i in only or (reversed(range(SLOTS)) if backwards else range(SLOTS)):
        rows.where(slot == i).repartition(SLOT_FILES).write.mode("append").parquet(folder)


def event_stream(t: Tables, name: str):
    """The events table as a file stream in order of time, with new work folders.

    The log ends with a heartbeat long after the last event, which lets the watermark pass
    whatever is still open.
    """
    source = scratch_folder(t.spark, f"{name}-in")
    write_slots(t.events, "ts", source)
    beat = {"event_type": F.lit("heartbeat"), "ts": F.max("ts") + F.expr("INTERVAL 100 DAYS")}
    columns = [beat.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in t.events.schema]
    t.events.agg(*columns).write.mode("append").parquet(source)
    out, mark = scratch_folder(t.spark, f"{name}-out"), scratch_folder(t.spark, f"{name}-mark")
    return source, out, mark


def _finish(running, t: Tables, out: str):
    running.awaitTermination()
    if running.exception() is not None:
        raise running.exception()
    return t.spark.read.parquet(out)


@query("outage_stream", SQL_OUTAGES)
def outage_stream(t: Tables):
    source, out, mark = event_stream(t, "outage")
    stream = stages.file_stream(t.spark, source, t.events.schema, per_trigger=SLOT_FILES)
    sessions = M.outage_sessions(attempts(stream, "domain"))
    return _finish(stages.append_stream(sessions, out, mark), t, out)


@query("first_requests_stream", f"SELECT key, hour FROM ({SQL_RATES})")
def first_requests_stream(t: Tables):
    source, out, mark = event_stream(t, "requests")
    stream = stages.file_stream(t.spark, source, t.events.schema, per_trigger=SLOT_FILES)
    asked = requests(stream.where("event_type <> 'heartbeat'"))
    return _finish(stages.append_stream(M.first_requests(asked), out, mark), t, out)


@query("health_stream", f"WITH {SQL_HEALTH} SELECT {', '.join(HEALTH_OUT)} FROM labelled")
def health_stream(t: Tables):
    source, out, mark = event_stream(t, "health")
    stream = stages.file_stream(t.spark, source, t.events.schema, per_trigger=SLOT_FILES)
    running = keyed.health_stream(calls(stream.where("event_type <> 'heartbeat'")), out, mark)
    _finish(running, t, out)
    return keyed.score_now(keyed.latest_health(t.spark, out), AS_OF_US).select(*HEALTH_OUT)


@query(
    "stage_stream",
    """SELECT o_custkey AS cnpj_basico, 'C' || o_custkey || '  site oficial' AS query_used, o_orderkey FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
)
def stage_stream(t: Tables):
    def stage(batch):
        name = F.concat(F.lit("C"), F.col("o_custkey"))
        return batch.select(
            F.col("o_custkey").alias("cnpj_basico"),
            D.search_query_single(F.lit(None).cast("string"), name, F.lit(None).cast("string")).alias("query_used"),
            "o_orderkey",
            "o_orderdate",
        )

    # The newest range of time comes first, so later micro-batches bring older rows.
    source, table, mark = (scratch_folder(t.spark, f"requests-{n}") for n in ("in", "table", "mark"))
    write_slots(t.orders, "o_orderdate", source, backwards=True)
    stream = stages.file_stream(t.spark, source, t.orders.schema, per_trigger=SLOT_FILES)
    running = stages.stage_stream(stream, stage, table, mark, "cnpj_basico", "o_orderdate", "o_orderkey")
    return _finish(running, t, table).select("cnpj_basico", "query_used", "o_orderkey")

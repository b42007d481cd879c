"""Tables the stages read and write: search results, discoveries, chunks, profiles.

Plain Parquet has no update. A keyed table is kept in hash buckets, one folder
each: an upsert rewrites only the buckets its keys fall into, with Spark's
dynamic partition overwrite, which swaps folders in at commit. The number of
buckets is fixed, so a key has one place for good.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.operators.ordered import last_values, range_sorted
from tessera.session import staged

# Key length and statuses of a discovery.
KEY_LENGTH = 8
MAX_SOURCE_PAGES = 5
BUCKETS = 64
BUCKET = "_bucket"

SEARCH_HITS = "array<struct<title:string,link:string,snippet:string>>"


def exists(spark: SparkSession, folder: str) -> bool:
    """Whether ``folder`` holds a table. The file system is asked; its errors rise."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return False
    names = [f.getPath().getName() for f in files.listStatus(path)]
    return any("=" in n or not n.startswith(("_", ".")) for n in names)


# --- requests -------------------------------------------------------------


def valid_key(key: Column) -> Column:
    return F.coalesce(F.length(key) == KEY_LENGTH, F.lit(False))


def validate_requests(requests: DataFrame, needs_url: bool = False) -> DataFrame:
    """Requests with ``accepted`` and the first ``reject_reason``."""
    reason = F.when(~valid_key(F.col("cnpj_basico")), "key must have 8 characters")
    if needs_url:
        reason = reason.when(
            F.coalesce(F.trim("website_url"), F.lit("")) == "", "website_url is required"
        )
    return requests.withColumn("reject_reason", reason).withColumn(
        "accepted", F.col("reject_reason").isNull()
    )


# --- search results -------------------------------------------------------


def parse_search_payload(payload: Column) -> Column:
    """Hits of a search answer; a missing snippet is empty, no hits is an empty array."""
    shape = f"struct<organic:{SEARCH_HITS}>"
    organic = F.from_json(payload, shape)["organic"]
    return F.coalesce(
        F.transform(
            organic,
            lambda h: F.struct(
                h["title"].alias("title"),
                h["link"].alias("link"),
                F.coalesce(h["snippet"], F.lit("")).alias("snippet"),
            ),
        ),
        F.array().cast(SEARCH_HITS),
    )


def search_hits(results: DataFrame, column: str = "results") -> DataFrame:
    """One row per hit with its rank."""
    rest = [c for c in results.columns if c != column]
    return results.select(*rest, F.posexplode(column).alias("rank", "hit")).select(
        *rest, "rank", "hit.*"
    )


def append_search_results(results: DataFrame, folder: str) -> DataFrame:
    """Append result sets to the log; the hit count is derived, never given."""
    counted = results.withColumn("results_count", F.size("results").cast("long"))
    counted.write.mode("append").parquet(folder)
    return results.sparkSession.read.schema(counted.schema).parquet(folder)


# --- keyed tables ---------------------------------------------------------


def latest_per_key(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Newest row per key.

    An aggregate, not a window: rows are reduced map-side, so a key with very
    many rows sends one row per task.
    """
    rest = [c for c in df.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(ts, tie))
    return df.groupBy(key).agg(newest.alias("r")).select(key, "r.*")


def merge_latest(target: DataFrame, updates: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Target after the updates: the last update of a key wins, new keys are added."""
    last = latest_per_key(updates, key, ts, tie)
    return target.join(last.select(key), key, "left_anti").unionByName(last)


def lookup(requests: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Every request with its row of the table, nulls when there is none."""
    return requests.join(table, key, "left")


def _bucketed(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))


def replace_keys(new: DataFrame, folder: str, key: str) -> None:
    """Replace all rows of the keys in ``new``; other keys stay as they are."""
    spark = new.sparkSession
    fresh = _bucketed(new, key)
    if exists(spark, folder):
        old = spark.read.parquet(folder)
        touched = fresh.select(BUCKET).distinct()
        # At most ``BUCKETS`` rows: the list of folders to rewrite.
        names = [r[BUCKET] for r in touched.collect()]
        stay = old.where(F.col(BUCKET).isin(names)).join(
            fresh.select(key).distinct(), key, "left_anti"
        )
        fresh = stay.unionByName(fresh, allowMissingColumns=True)
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        BUCKET
    ).parquet(folder)


def upsert(updates: DataFrame, folder: str, key: str, ts: str, tie: str) -> None:
    """Bring a bucketed table to the newest row of each key, by (ts, tie).

    A stored row that is newer than the update stays, so updates may come in any order
    and more than once.
    """
    spark = updates.sparkSession
    new = latest_per_key(updates, key, ts, tie)
    if exists(spark, folder):
        stored = spark.read.parquet(folder).select(F.col(key), F.struct(ts, tie).alias("_stored"))
        newer = F.col("_stored").isNull() | (F.coalesce(F.struct(ts, tie) >= F.col("_stored"), F.lit(True)))
        new = staged(new.join(stored, key, "left").where(newer).drop("_stored"), "newer")
    replace_keys(new, folder, key)


# --- chunks ---------------------------------------------------------------


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """Chunks with their first five page urls as one comma-separated text."""
    pages = F.array_join(F.slice("pages_included", 1, MAX_SOURCE_PAGES), ",")
    return chunks.withColumn("page_source", F.when(F.size("pages_included") > 0, pages)).drop(
        "pages_included"
    )


def with_discovery(chunks: DataFrame, discoveries: DataFrame, key: str = "cnpj_basico") -> DataFrame:
    """Chunks with the id of their company's discovery; a missing one stays null.

    ``discoveries`` holds (key, id), one row per key.
    """
    return chunks.join(discoveries.select(key, F.col("id").alias("discovery_id")), key, "left")


def write_chunks(chunks: DataFrame, folder: str, mode: str = "replace") -> None:
    """Store chunks; ``replace`` swaps a company's chunks, ``append`` only adds."""
    rows = chunk_rows(chunks)
    if mode == "replace":
        replace_keys(rows, folder, "cnpj_basico")
    elif mode == "append":
        _bucketed(rows, "cnpj_basico").write.mode("append").partitionBy(BUCKET).parquet(folder)
    else:
        raise ValueError(f"unknown mode: {mode}")


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).drop(BUCKET)


def scan_chunks(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chunks of the wanted companies, ordered by company and index.

    Rows stay rows: a range sort spreads a company with very many chunks over
    tasks, where a collected list would not.
    """
    return chunks.join(wanted.select("cnpj_basico"), "cnpj_basico", "left_semi").orderBy(
        "cnpj_basico", "chunk_index"
    )


# --- profiles -------------------------------------------------------------


def nested_prefixes(asked: DataFrame, prefix: str) -> DataFrame:
    """Each distinct prefix with all asked prefixes it starts with, itself included."""
    distinct = asked.select(prefix).distinct()
    shorter = distinct.select(
        F.col(prefix).alias("_own"),
        F.explode(F.sequence(F.lit(1), F.length(prefix))).alias("_len"),
    ).select("_own", F.substring(F.col("_own"), F.lit(1), F.col("_len")).alias(prefix))
    return shorter.join(distinct, prefix).groupBy("_own").agg(F.collect_list(prefix).alias("_chain"))


def prefix_join(lookups: DataFrame, table: DataFrame, prefix: str, key: str) -> DataFrame:
    """Rows whose key starts with the looked-up prefix, by merging both in one order.

    Prefixes and keys are range-partitioned together and sorted. Every asked prefix of a
    key is also one of the last prefix at or before it, so each row meets that prefix
    only, with the chain of prefixes nested in it. A row of the table is shuffled once
    whatever the lengths asked for, and rows of a key found very often spread over
    partitions. An empty or missing prefix asks for nothing, and an empty or missing key
    is never found. Repeated lookups give repeated rows.
    """
    asked = lookups.where(F.length(prefix) > 0)
    chains = nested_prefixes(asked, prefix).select(
        F.col("_own").alias("_at"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_tie"), "_chain"
    )
    row = F.struct(*table.columns)
    rows = table.where(F.length(key) > 0).select(
        F.col(key).alias("_at"), F.lit(1).alias("_kind"), F.monotonically_increasing_id().alias("_tie"), row.alias("_row")
    )
    order = ["_at", "_kind", "_tie"]
    merged = range_sorted(rows.unionByName(chains, allowMissingColumns=True), [], order)
    met = last_values(merged, [], order, "_chain", "_met").where("_kind = 1")
    fitting = F.filter("_met", lambda p: F.col("_at").startswith(p))
    found = met.select(F.explode(fitting).alias(prefix), "_row").select(prefix, "_row.*")
    return asked.join(found, prefix)


def profile_prefix_lookup(lookups: DataFrame, profiles: DataFrame, prefix: str, key: str, ts: str) -> DataFrame:
    """Latest profile whose key equals or starts with the looked-up value."""
    return latest_per_key(
        prefix_join(lookups.select(prefix).distinct(), profiles, prefix, key), prefix, ts, key
    )

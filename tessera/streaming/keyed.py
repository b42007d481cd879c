"""Call logs online: a snapshot of each provider's numbers per micro-batch.

Outages and first requests need no code of their own here: ``monitoring.outage_sessions``
and ``monitoring.first_requests`` take a stream as they take a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tessera.operators import monitoring as M


def health_partials(calls: DataFrame) -> DataFrame:
    """Per provider the counts, the last failure and the last latencies of some calls.

    Counts are combined in each task before the shuffle, and a task passes on at most the
    last ``RECENT_CALLS`` latencies of a provider, so a hot one is small by then.
    """
    ok, kind = F.col("ok"), F.coalesce("failure_type", F.lit(""))
    place = Window.partitionBy("provider").orderBy(F.col("t_us").desc(), F.col("call_id").desc())
    recent = (
        calls.where(ok | (F.col("latency_ms") > 0))
        .select("provider", "t_us", "call_id", "latency_ms", F.row_number().over(place).alias("back"))
        .where(F.col("back") <= M.RECENT_CALLS)
        .groupBy("provider")
        .agg(F.sort_array(F.collect_list(F.struct("t_us", "call_id", "latency_ms"))).alias("recent"))
    )
    counts = calls.groupBy("provider").agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("success"),
        F.count_if(~ok & (kind == "rate_limit")).alias("rate_limits"),
        F.count_if(~ok & (kind == "timeout")).alias("timeouts"),
        F.count_if(~ok & ~kind.isin("rate_limit", "timeout")).alias("errors"),
        F.coalesce(F.max(F.when(~ok, F.col("t_us"))), F.lit(-1)).alias("last_failure_us"),
    )
    return counts.join(recent, "provider", "left")


def merge_health(parts: DataFrame) -> DataFrame:
    """Partial numbers of providers put together, whatever the order they come in."""
    sums = [F.sum(c).alias(c) for c in ("total", "success", "rate_limits", "timeouts", "errors")]
    latest = F.slice(F.reverse(F.array_sort(F.flatten(F.collect_list("recent")))), 1, M.RECENT_CALLS)
    return parts.groupBy("provider").agg(
        *sums, F.max("last_failure_us").alias("last_failure_us"), F.reverse(latest).alias("recent")
    )


def health_stream(calls: DataFrame, folder: str, checkpoint: str):
    """Keep each provider's numbers up to date, one snapshot a micro-batch.

    A micro-batch adds its partial numbers to the snapshot before it and writes its own
    folder, so running it again after a failure gives the same. Only the last snapshot is
    read, and rows may come in any order.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        parts = health_partials(batch)
        if epoch:
            parts = batch.sparkSession.read.parquet(f"{folder}/epoch={epoch - 1}").unionByName(parts)
        merge_health(parts).write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    return (
        calls.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_health(spark, folder: str) -> DataFrame:
    """The newest snapshot with the mean of the last latencies."""
    snapshots = spark.read.parquet(folder)
    newest = snapshots.agg(F.max("epoch")).first()[0]
    total = F.aggregate("recent", F.lit(0.0), lambda a, x: a + x["latency_ms"])
    mean = F.when(F.size("recent") > 0, total / F.size("recent")).otherwise(0.0)
    return snapshots.where(F.col("epoch") == newest).withColumn("avg_latency_ms", mean).drop("epoch", "recent")


def score_now(numbers: DataFrame, as_of_us: int) -> DataFrame:
    """Numbers of each provider with the score at ``as_of_us``."""
    quiet = F.when(F.col("last_failure_us") >= 0, (F.lit(as_of_us) - F.col("last_failure_us")) / 1e6)
    score = M.health_score(
        F.col("total"), F.col("success"), F.col("rate_limits"), F.round("avg_latency_ms", 6), quiet
    )
    return numbers.withColumn("health_score", score).withColumn("status", M.status_label(score))

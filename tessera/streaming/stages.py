"""Streams between tables: sources and upserting sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tessera.sources import stores


def file_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", per_trigger: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream, a bounded number per micro-batch."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", per_trigger)
        .parquet(folder)
    )


def append_stream(stream: DataFrame, out: str, checkpoint: str):
    """Run over all files there are now and append the results as Parquet."""
    return (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def stage_stream(
    requests: DataFrame,
    stage: Callable[[DataFrame], DataFrame],
    table: str,
    checkpoint: str,
    key: str,
    ts: str,
    tie: str,
):
    """Accept requests, run a stage on each micro-batch, upsert by key.

    The upsert is idempotent: a micro-batch that runs again after a failure
    writes the same rows.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        stores.upsert(stage(batch), table, key, ts, tie)

    return (
        requests.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

"""Session and checkpoint helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    On a cluster leave ``master`` unset and let spark-submit provide it. The
    shuffle settings are left to AQE: it coalesces small partitions and splits
    skewed ones, so no partition count is baked in.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names.

    Where none is set a local session gets a temporary folder. On a cluster that is
    an error: every executor would write to a disk of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not shared and not re.match(r"local($|\[)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tessera-checkpoint-"))


def pinned(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and cut its lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Input bytes for each partition of a sort whose partitions AQE may not merge or split.
BYTES_IN_PARTITION = 256 << 20
#: Spark gives about this size to what it cannot measure.
UNKNOWN_BYTES = 1 << 60


def input_width(df: DataFrame) -> int:
    """Partitions for a sort of ``df``: the session's number, more where the input is large."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    size = sum(n for n in sizes if n < UNKNOWN_BYTES)
    return max(shuffle_width(df.sparkSession), -(-size // BYTES_IN_PARTITION))


_scratch: list[str] = []


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables written between steps, beside the checkpoints."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _scratch.append(folder)
    return folder


@contextmanager
def scratch_space(spark: SparkSession) -> Iterator[None]:
    """Remove what is staged inside the block when the block ends.

    For whoever runs a query: its result must be written or collected by then.
    """
    before = len(_scratch)
    try:
        yield
    finally:
        for folder in _scratch[before:]:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        del _scratch[before:]


#: Spark's name for removing the shuffle files of a statement when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written inside the block leaves no shuffle files behind; else they stay until the driver collects garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def staged(df: DataFrame, name: str = "stage", dictionary: bool = True) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and go on from the files.

    For wide rows that several later steps read: each reads only its columns,
    nothing upstream runs twice, and lost executors cost no recomputation. The files stand for
    the shuffles they came from, which are removed. Without ``dictionary``
    values are written as they are: for tables that hold mostly different texts.
    """
    folder = scratch_folder(df.sparkSession, name)
    writer = df.write if dictionary else df.write.option("parquet.enable.dictionary", "false")
    with _shuffles_removed(df.sparkSession):
        writer.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)

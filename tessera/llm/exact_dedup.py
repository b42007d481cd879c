"""Exact deduplication through a persistent digest index.

The index is a table with one row for each distinct text: its SHA-256 digest, the
document that stands for it, how many equal rows the batch held that brought it, and that
batch's name. It is bucketed and sorted by digest, so that a new batch meets it by a
sort-merge anti-join for which the index is not shuffled; only digests the index lacks are
appended. As every append adds a file to each bucket, Spark sorts the buckets of an index of
several batches again. A batch that is added a second time, as after a failure, gets the
answers it got before and adds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fold_ascii, fresh, only
from tessera.session import scratch_folder, staged

#: A digest that holds at least one row in this many is met by broadcast: there are
#: at most this many such digests, whatever the input, so the broadcast is bounded.
HOT_SHARE = 10_000


def text_digest(text):
    """Binary SHA-256 of the text with A to Z lower-cased; null counts as empty."""
    return F.unhex(F.sha2(fold_ascii(F.coalesce(text, F.lit(""))).cast("binary"), 256))


class DigestIndex:
    """A digest table under a catalog name, kept in ``path``; made on first use."""

    def __init__(self, spark: SparkSession, table: str, path: str, buckets: int = 0):
        self.spark, self.table, self.path = spark, table, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _append(self, rows: DataFrame) -> None:
        (
            rows.write.bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .mode("append")
            .option("path", self.path)
            .format("parquet")
            .saveAsTable(self.table)
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, batch: DataFrame, name: str | None = None) -> DataFrame:
        """Deduplicate ``batch`` (doc_id, text) against itself and the index, and append.

        ``name`` tells batches apart; without one it follows from the ids and texts, so that
        the same rows are the same batch. Texts that the index holds from the batch itself
        count as new.

        Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256.
        Of equal new texts the row with the largest doc_id stays; a text that the index
        already held stays with its earlier document, and no row of it is kept.
        ``group_size`` counts the equal rows of this batch. Null text counts as empty.
        A null doc_id is smaller than any other; where a group has no other, keep_id is
        null and its rows count as one document. Rows that repeat a doc_id with the same
        text carry the same flags (``drop_duplicates`` leaves one of them). An empty
        batch gives no rows. Columns other than doc_id and text are not read.
        """
        digests = staged(
            only(batch, "doc_id", "text").select("doc_id", text_digest(F.col("text")).alias("digest")), "digests"
        )
        if not self.spark.catalog.tableExists(self.table):
            self._append(
                self.spark.createDataFrame([], f"digest binary, keep_id {batch.schema['doc_id'].dataType.simpleString()}, group_size bigint, batch string")
            )
        groups = staged(
            digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups"
        )
        total, *marks = digests.agg(
            F.count("*"), F.bit_xor(F.xxhash64("doc_id", "digest")), F.sum(F.xxhash64("digest", "doc_id").cast("decimal(38,0)"))
        ).first()
        name = name or "-".join(map(str, (total, *marks)))
        new = groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti").withColumn("batch", F.lit(name))
        # Which texts were new is settled before the index takes them up.
        settled = staged(
            groups.join(
                self.rows().select("digest", F.col("keep_id").alias("had_id"), (F.col("batch") != name).alias("had")).hint("merge"),
                "digest",
                "left",
            ).select(
                "digest",
                "group_size",
                F.coalesce("had", F.lit(False)).alias("had"),
                F.when(F.col("had"), F.col("had_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            ),
            "settled",
        )
        self._append(new)
        is_hot = F.col("group_size") * HOT_SHARE >= F.lit(total)
        hot = settled.filter(is_hot)
        cold = settled.filter(~is_hot)
        asked = digests.join(
            F.broadcast(hot.select("digest", *(F.col(c).alias(f"hot_{c}") for c in ("group_size", "had", "keep_id")))),
            "digest",
            "left",
        )
        common = asked.filter("hot_group_size is not null").select(
            "doc_id", "digest", *(F.col(f"hot_{c}").alias(c) for c in ("group_size", "had", "keep_id"))
        )
        rest = asked.filter("hot_group_size is null").select("doc_id", "digest").join(cold.hint("merge"), "digest")
        return (
            common.unionByName(rest)
            .select(
                "doc_id",
                "keep_id",
                "group_size",
                (~F.col("had") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
                F.lower(F.hex("digest")).alias("text_sha256"),
            )
        )


@contextmanager
def scratch_index(spark: SparkSession) -> Iterator[DigestIndex]:
    """An empty index in the shared folder, whose table goes with the block, failed or not."""
    folder = scratch_folder(spark, "digest-index")
    index = DigestIndex(spark, "digest_index_" + folder.rpartition("-")[2], folder)
    try:
        yield index
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {index.table}")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """``DigestIndex.add`` of all of ``docs`` to an empty index."""
    with scratch_index(docs.sparkSession) as index:
        return staged(index.add(docs), "exact")


def batched_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``exact_duplicates``, with ``docs`` added in two batches, larger ids first.

    The second batch, of the ids up to about the median and the null ones, meets a filled
    index. The index keeps the first document of a text, which is then the one with the
    largest id; ``group_size`` is summed over both batches. Ids are of any type with an
    order; the median is that of a thousand of them, and only says where the batches part.
    Null counts as empty, no documents give no rows, repeated rows the same answer.
    """
    rows = only(docs, "doc_id", "text")
    some = sorted(r[0] for r in rows.filter("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(1001).collect())
    middle = some[len(some) // 2] if some else None
    later = F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(True))
    with scratch_index(docs.sparkSession) as index:
        parts = [staged(index.add(rows.filter(part)), "exact") for part in (~later, later)]
    found = parts[0].unionByName(parts[1]).drop("group_size")
    sizes = [p.groupBy("text_sha256").agg(F.max("group_size").alias("group_size")) for p in parts]
    groups = staged(sizes[0].unionByName(sizes[1]).groupBy("text_sha256").agg(F.sum("group_size").alias("group_size")), "sizes")
    is_hot = F.col("group_size") * HOT_SHARE >= F.lit(found.count())
    hot = groups.filter(is_hot).withColumnRenamed("group_size", "hot_size")
    asked = found.join(F.broadcast(hot), "text_sha256", "left")
    common = asked.filter("hot_size is not null").withColumnRenamed("hot_size", "group_size")
    rest = asked.filter("hot_size is null").drop("hot_size").join(groups.filter(~is_hot).hint("merge"), "text_sha256")
    return common.unionByName(rest).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_duplicates(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; of repeated rows one.

    Null counts as empty, a null id stays only where its text has no other; no rows give none.
    Rows of a hot digest that go are dropped by a bounded broadcast, before texts move.
    """
    found = index.add(docs) if index else exact_duplicates(docs)
    total = found.count()
    digest, keep_id, hot_id, is_hot = (fresh(docs, n) for n in ("digest", "stays", "hot_stays", "is_hot"))
    groups = (
        found.groupBy("text_sha256")
        .agg(F.max("keep_id").alias(keep_id), F.max("group_size").alias("size"), F.max("kept").alias("any"))
        .withColumn(digest, F.unhex("text_sha256"))
    )
    hot = groups.filter(F.col("size") * HOT_SHARE >= F.lit(total)).select(
        digest, F.col(keep_id).alias(hot_id), F.lit(True).alias(is_hot)
    )
    rows = docs.withColumn(digest, text_digest(docs["text"])).join(F.broadcast(hot), digest, "left")
    rows = rows.filter(F.col(is_hot).isNull() | F.col("doc_id").eqNullSafe(F.col(hot_id)))
    kept = groups.filter("any").select(digest, keep_id)
    return (
        rows.join(kept.hint("merge"), digest)
        .filter(F.col("doc_id").eqNullSafe(F.col(keep_id)))
        .dropDuplicates([digest])
        .select(*docs.columns)
    )

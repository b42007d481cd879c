"""Bounded samples of labelled documents, for the classifiers that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import in_part, only
from tessera.session import staged


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int, modulus: int = 5, per_class: bool = False) -> DataFrame:
    """At most ``limit`` rows (text, label) to learn from, as a written table.

    Only documents whose crc32(doc_id) leaves a remainder other than 0 are taken, the
    first by a hash of the id, which knows nothing of text or label; with ``per_class``
    up to half of them of each of the labels 0 and 1. Null labels and ids are left out.
    The ids are chosen first, so the texts come by a join with a bounded broadcast.
    """
    known = only(labels, "doc_id", label).withColumnRenamed(label, "label").filter("doc_id is not null and label in (0, 1)")
    known = known.filter(~in_part(F.col("doc_id"), modulus, 0)).join(only(docs, "doc_id").distinct(), "doc_id", "left_semi")
    order = F.xxhash64("doc_id", F.lit(7))
    if per_class:
        chosen = None
        for value in (0, 1):
            part = known.filter(F.col("label") == value).orderBy(order, "doc_id").limit(limit // 2)
            chosen = part if chosen is None else chosen.unionByName(part)
    else:
        chosen = known.orderBy(order, "doc_id").limit(limit)
    chosen = staged(chosen, "chosen")
    return staged(only(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("label").cast("int").alias("label")), "labelled")

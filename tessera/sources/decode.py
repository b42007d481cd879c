"""Raw responses to text: character set by header, markup or default."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

# Names of encodings that are read as another one; the searched head.
ALIASES = {
    "iso-8859-1": "latin-1", "iso8859-1": "latin-1", "latin1": "latin-1", "windows-1252": "cp1252",
}
HEAD_BYTES = 2048


def declared_charset(body: Column, content_type: Column) -> Column:
    """Charset of the header, else of the markup's head, else utf-8."""
    from_header = F.regexp_extract(F.lower(F.coalesce(content_type, F.lit(""))), r"charset=\s*([^;]*?)\s*(?:;.*)?\z", 1)
    head = F.decode(F.substring(body, 1, HEAD_BYTES), "ISO-8859-1")
    direct = F.regexp_extract(head, r"(?i)<meta[^>]+charset=[\"']?([^\"'\s>]+)", 1)
    inside = F.regexp_extract(head, r"(?i)<meta[^>]+content=[\"'][^\"']*charset=([^\"'\s;]+)", 1)
    named = F.coalesce(*[F.when(c != "", c) for c in (from_header, direct, inside)], F.lit("utf-8"))
    chain = F
    low = F.lower(named)
    for alias, name in ALIASES.items():
        chain = chain.when(low == alias, name)
    return chain.otherwise(low)


def is_pdf(body: Column, content_type: Column) -> Column:
    typed = F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("application/pdf"))
    return typed | F.coalesce(F.substring(body, 1, 5) == F.lit(b"%PDF-"), F.lit(False))


def _decoded(body: bytes, charset: str) -> str:
    for name in (charset, "utf-8"):
        try:
            return body.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
    return body.decode("latin-1")


def _decode_batch(bodies: pd.Series, charsets: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else _decoded(bytes(b), c) for b, c in zip(bodies, charsets)])


def decode_pages(responses: DataFrame) -> DataFrame:
    """Add ``html`` to (…, body, content_type); PDFs become empty text.

    utf-8 and latin-1 are decoded in the JVM; other sets, and bytes that are not
    valid utf-8, go through an Arrow batch.
    """
    decode_any = F.pandas_udf(_decode_batch, StringType())
    charset = declared_charset(F.col("body"), F.col("content_type"))
    pdf = is_pdf(F.col("body"), F.col("content_type"))
    latin = F.when(F.col("charset") == "latin-1", F.decode("body", "ISO-8859-1"))
    utf8 = F.when(F.col("charset").isin("utf-8", "utf8"), F.try_validate_utf8(F.col("body").cast("string")))
    fast = F.coalesce(F.when(F.col("pdf"), F.lit("")), latin, utf8)
    rest = F.when(F.col("html").isNull(), F.col("body"))
    return (
        responses.withColumns({"charset": charset, "pdf": pdf})
        .withColumn("html", fast)
        .withColumn("html", F.coalesce("html", decode_any(rest, F.col("charset"))))
        .drop("pdf")
    )


def read_binary_pages(spark, folder: str) -> DataFrame:
    """Stored responses, one file each, as (url, body)."""
    return spark.read.format("binaryFile").load(folder).select(
        F.col("path").alias("url"), F.col("content").alias("body")
    )

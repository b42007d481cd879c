import os
import sys

sys.path.insert(0, os.path.dirname(__file__))

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """Make a documents table of (doc_id, text) rows, with columns that clash with results."""

    def make(rows, clash=True):
        df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCS)
        if clash:
            for name in ("kept", "digest", "fingerprint", "score", "row", "row_key", "key", "words", "block"):
                df = df.selectExpr("*", f"'x' as {name}")
        return df.repartition(3)

    return make


@pytest.fixture(scope="session")
def sample(spark):
    """All rows of the smallest documents table."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    return [(r[0], r[1]) for r in rows]

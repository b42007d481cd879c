import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.sql.execution.arrow.maxRecordsPerBatch": "64",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def values(spark, items, fn, schema="string"):
    """Apply a Column function to each item and give the results in order."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(list(enumerate(items)), f"i int, v {schema}")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v"))).collect()]

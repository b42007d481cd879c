"""Shared folders: where they are, and that they go."""

import os

import pytest
from pyspark.sql import functions as F

from tessera import session as S


def test_staged_tables_go_with_their_space(spark):
    with S.scratch_space(spark):
        df = S.staged(spark.range(5), "test")
        folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert df.count() == 5 and os.path.isdir(folder)
    assert not os.path.exists(folder)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "local-cluster[2,1,1024]"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        S.ensure_checkpoint_dir(Session())


def test_staged_tables_leave_no_shuffle_files(spark):
    """The files of a written table stand for its shuffles, and the session's setting is as before."""
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before, setting = shuffles(), spark.conf.get(S.SHUFFLE_CLEANUP, "false")
    counts = spark.range(5000).repartition(8, "id").groupBy((F.col("id") % 7).alias("k")).count()
    out = S.staged(counts)
    assert shuffles() <= before and spark.conf.get(S.SHUFFLE_CLEANUP, "false") == setting
    assert out.count() == counts.count() == 7

"""Stored tables: what they leave on disk."""

from pathlib import Path

from pyspark.sql import functions as F

from corpometer import session


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for folder in folders for f in Path(folder.getPath()).rglob("shuffle_*")}


def grouped(spark):
    return spark.range(10_000).groupBy((F.col("id") % 999).alias("k")).agg(F.count(F.lit(1)).alias("n"))


def test_stored_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    table = session.stored(grouped(spark).repartition(3))
    assert not shuffle_files(spark) - before and table.count() == 999
    assert spark.conf.get(session.SHUFFLE_CLEANUP) == "false"


def test_settled_tables_outlive_those_on_their_way(spark):
    paths = []

    def build():
        first = session.stored(grouped(spark), "first")
        paths.extend(p for p in session._scopes[-1])
        return first.where("k < 10")

    with session.cleared(spark):
        table = session.settled(spark, build, "second")
        assert len(paths) == 1 and not Path(paths[0].removeprefix("file:")).exists() and table.count() == 10

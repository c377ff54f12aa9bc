"""Session settings and the shared folder that jobs write to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[str]] = []
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "*", partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A session for tests and single-machine runs; on a cluster use the cluster's own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpometer")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one where it is unset.

    The temporary folder is for local sessions only and becomes the session's checkpoint folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors can reach.")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpometer-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash rows over all cores when the input has fewer splits than there are cores.

    Costly column work on a small file would else run in a task or two. Inputs with a split for
    every core, which all large ones have, are returned as they are and not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write an intermediate table to the shared folder and go on from there.

    For tables that several later steps read: the work behind them is done once, losing an executor
    does not repeat it, and the planner sees their real size. The shuffle files of that work are
    deleted when the table is written, not when the driver happens to collect its garbage.
    """
    return _written(df, fresh_path(df.sparkSession, name))


def settled(spark: SparkSession, build: Callable[[], DataFrame], name: str = "stage") -> DataFrame:
    """:func:`stored` for the table that ``build`` gives; the tables it stores on its way are deleted then."""
    path = fresh_path(spark, name)
    with cleared(spark):
        return _written(build(), path)


def _written(df: DataFrame, path: str) -> DataFrame:
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, "false")
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    for paths in _scopes:
        paths.append(path)
    return path


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that are stored inside the block when it ends; write its results before that."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        delete_paths(spark, paths)


def delete_paths(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete stored tables that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

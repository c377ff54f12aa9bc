"""Checkpointed streams: new articles into a table, snapshots, running statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpometer.operators import sketches
from corpometer.operators.joins import attach, group_key
from corpometer.operators.timing import running_time
from corpometer.sources.readers import parse_articles

BATCH_COLUMN = "stream_batch"


def article_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of article files as rows; files already seen are not read again."""
    reader = spark.readStream.option("recursiveFileLookup", True)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    files = reader.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return parse_articles(files)


def table_stream(
    spark: SparkSession, folder: str, schema, glob: str = "*.parquet", files_per_trigger: int | None = None
) -> DataFrame:
    """Stream of Parquet files that arrive in a folder.

    A ``glob`` without wildcards names one table of the folder: a file, or a folder of files as Spark writes it.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if set(glob) & set("*?[{"):
        return reader.option("pathGlobFilter", glob).parquet(folder)
    # A path without a wildcard must be a folder, so the first letter becomes a class of one.
    return reader.parquet(f"{folder}/[{glob[0]}]{glob[1:]}")


def append_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to a Parquet table, then stop; a restart goes on where it ended."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def snapshots(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch to its own folder; a batch that runs twice replaces itself.

    The snapshot after batch ``k`` is the rows of all folders up to ``k``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH_COLUMN}={batch_id}")

    return _each_batch(stream, write, checkpoint, "append")


def snapshot(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """Rows of the snapshots up to a micro-batch."""
    rows = spark.read.parquet(path)
    return rows if upto is None else rows.where(F.col(BATCH_COLUMN) <= upto)


def running_stats(
    stream: DataFrame, by: str = "model", seconds_col: str = "elapsed_time"
) -> DataFrame:
    """Rows, seconds and mean seconds per group so far. Sums merge, so no watermark is needed."""
    return stream.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(seconds_col).alias("total_seconds"),
        F.avg(seconds_col).alias("avg_seconds"),
    )


def keep_latest(totals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the totals after each micro-batch to a folder of their own; :func:`latest` reads the last.

    No folder that has been written is touched again, so a crash leaves the totals before it whole.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH_COLUMN}={batch_id}")

    return _each_batch(totals, write, checkpoint, "complete")


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The totals after the last micro-batch."""
    rows = spark.read.parquet(path)
    last = rows.agg(F.max(BATCH_COLUMN)).first()[0]
    return rows.where(F.col(BATCH_COLUMN) == last).drop(BATCH_COLUMN)


def running_totals(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    seconds_col: str = "elapsed_time",
    order_col: str = "batch_id",
    by: str = "model",
) -> StreamingQuery:
    """Add the seconds spent (``total_time``) and the rows done (``done``) up to each row as rows arrive.

    Rows of a micro-batch are taken in the order of ``order_col`` within their group, behind all rows of the
    micro-batches before. A group may hold any share of a micro-batch: its rows are added up in ranges
    (:func:`timing.running_time`). The totals after each micro-batch go to a folder of their own; the next one
    starts from there, also behind a restart, and one that runs twice replaces itself. Read the rows with
    :func:`totals_so_far`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        summed = running_time(batch, seconds_col, order_col, [by]).withColumn("__g", group_key(by))
        if batch_id:
            before = spark.read.parquet(f"{path}/totals/{BATCH_COLUMN}={batch_id - 1}")
            summed = attach(summed, before.select("__g", F.col("total").alias("__total"), F.col("rows").alias("__rows")), ["__g"])
            added = {"total_time": F.col("total_time") + F.coalesce("__total", F.lit(0)), "done": F.col("done") + F.coalesce("__rows", F.lit(0))}
            summed = summed.withColumns(added).drop("__total", "__rows")
        rows_path = f"{path}/rows/{BATCH_COLUMN}={batch_id}"
        summed.write.mode("overwrite").parquet(rows_path)
        # The last row of a group has its totals; groups that did not turn up keep theirs.
        new = spark.read.parquet(rows_path).groupBy("__g").agg(F.max_by("total_time", "done").alias("total"), F.max("done").alias("rows"))
        if batch_id:
            old = before.select("__g", F.col("total").alias("o_total"), F.col("rows").alias("o_rows"))
            new = old.join(new, "__g", "full").select("__g", F.coalesce("total", "o_total").alias("total"), F.coalesce("rows", "o_rows").alias("rows"))
        new.write.mode("overwrite").parquet(f"{path}/totals/{BATCH_COLUMN}={batch_id}")

    return _each_batch(stream, write, checkpoint, "append")


def totals_so_far(spark: SparkSession, path: str) -> DataFrame:
    """The rows that :func:`running_totals` has written, with the micro-batch each one came in."""
    return spark.read.parquet(f"{path}/rows").drop("__g")


def vocabulary(
    stream: DataFrame, path: str, checkpoint: str, tokens: Callable[[], Column], corpus_col: str = "corpus", terms: int = sketches.TERMS
) -> StreamingQuery:
    """Store sketches of types and frequent terms of each micro-batch; texts of earlier ones are not read again.

    ``tokens`` gives the column of tokens. A micro-batch that runs twice replaces its own sketches.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        types, frequent = sketches.vocabulary_sketches(batch, tokens(), [corpus_col], terms)
        types.write.mode("overwrite").parquet(f"{path}/types/{BATCH_COLUMN}={batch_id}")
        frequent.write.mode("overwrite").parquet(f"{path}/terms/{BATCH_COLUMN}={batch_id}")

    return _each_batch(stream, write, checkpoint, "append")


def vocabulary_so_far(
    spark: SparkSession, path: str, corpus_col: str = "corpus", terms: int = sketches.TERMS
) -> tuple[DataFrame, DataFrame]:
    """Types and frequent terms of all that has arrived, as in :func:`sketches.merged_vocabulary`."""
    types, frequent = spark.read.parquet(f"{path}/types"), spark.read.parquet(f"{path}/terms")
    return sketches.merged_vocabulary(types, frequent, [corpus_col], BATCH_COLUMN, terms)


def _each_batch(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str
) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )

"""Writers for tables, batches, article files, reports and the metric store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpometer.operators.joins import bounded
from corpometer.operators.reports import flat_nested
from corpometer.session import stored
from corpometer.sources.named_files import write_named_files

CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "quoteAll": False, "emptyValue": '""'}


def write_csv(df: DataFrame, path: str, **options) -> None:
    """Whole table as CSV with a header; text that needs quotes gets them, quotes are doubled."""
    df.write.mode("overwrite").options(**{**CSV_OPTIONS, **options}).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Whole table, one JSON object per line."""
    df.write.mode("overwrite").json(path)


def write_batches(
    df: DataFrame, path: str, columns: Sequence[str] = ("id", "generated_text"), batch_col: str = "batch_id"
) -> None:
    """One folder per batch; writing a batch again replaces that batch and no other."""
    (
        df.select(*columns, batch_col)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(batch_col)
        .options(**CSV_OPTIONS)
        .csv(path)
    )


def read_batches(
    spark: SparkSession, path: str, schema: str, upto: int | None = None, batch_col: str = "batch_id"
) -> DataFrame:
    """Rows of all batches, or the cumulative output up to one batch; other folders are not read."""
    rows = (
        spark.read.schema(f"{schema}, {batch_col} bigint")
        .options(header=True, multiLine=True, quote='"', escape='"')
        .csv(path)
    )
    return rows if upto is None else rows.where(F.col(batch_col) <= upto)


def article_file(idx, ts) -> Column:
    """Name of an article file from its number and time."""
    number = F.col(idx).cast("string")
    padded = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    return F.concat(F.lit("article_"), padded, F.lit("_"), F.date_format(ts, "yyyyMMdd_HHmmss"))


def _write_files(df: DataFrame, path: str) -> None:
    """One file per row; the second and later rows of a name get their number behind it.

    Only rows whose name comes more than once are numbered, by the order of their texts.
    """
    named = df.where("file IS NOT NULL")
    shared = stored(named.groupBy("file").count().where("count > 1").select("file"), "shared-names")
    local = bounded(shared)
    shared = shared if local is None else F.broadcast(local)
    turn = F.row_number().over(Window.partitionBy("file").orderBy("value"))
    rows = named.join(shared, "file", "left_semi").withColumn("turn", turn)
    name = F.when(F.col("turn") > 1, F.concat("file", F.lit("_"), F.col("turn"))).otherwise(F.col("file"))
    numbered = rows.select(name.alias("file"), "value")
    whole = named.join(shared, "file", "left_anti").select("file", "value").unionByName(numbered)
    ended = F.concat("value", F.lit("\n")).alias("value")
    write_named_files(whole.select(F.concat("file", F.lit(".txt")).alias("file"), ended), path)


def write_article_files(
    df: DataFrame, path: str, idx: str = "idx", ts: str = "ts", topic: str = "topic", article: str = "article"
) -> None:
    """One text file per row in one folder, named after its number and time."""
    body = F.concat(F.lit("Topic: "), F.col(topic), F.lit("\n\n"), F.col(article))
    _write_files(df.select(article_file(idx, ts).alias("file"), body.alias("value")), path)


def write_run_logs(
    df: DataFrame,
    path: str,
    idx: str = "idx",
    ts: str = "ts",
    prompt: str = "prompt",
    output: str = "output",
    seconds: str = "seconds",
) -> None:
    """One run-log file per row: prompt, output and seconds under their headings."""
    body = F.concat(
        F.lit("### PROMPT USED ###\n"),
        F.col(prompt),
        F.lit("\n\n### MODEL OUTPUT ###\n"),
        F.col(output),
        F.lit("\n\n### GENERATION TIME: "),
        F.format_string("%.2f", F.col(seconds)),
        F.lit(" seconds ###"),
    )
    _write_files(df.select(article_file(idx, ts).alias("file"), body.alias("value")), path)


def write_report_csv(df: DataFrame, path: str) -> None:
    """Table with nested cells as CSV; nested cells become JSON text."""
    write_csv(flat_nested(df), path)


def write_report_json(df: DataFrame, path: str) -> None:
    """Report rows as JSON."""
    df.write.mode("overwrite").json(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metric store: Parquet with one folder per metric; metrics written again replace their own."""
    (
        metrics.repartition("metric")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("metric")
        .parquet(path)
    )


def read_metrics(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """The metric store, all of it or the named metrics only."""
    metrics = spark.read.parquet(path)
    if names:
        metrics = metrics.where(F.col("metric").isin(*names))
    return metrics

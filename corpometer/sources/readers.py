"""Readers for article tables and article text files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpometer.operators.ranks import hash_rank
from corpometer.operators.sampling import sample_exact
from corpometer.operators.tables import require_columns, text_rows
from corpometer.sources import records

CORRUPT = "_corrupt_record"

# Layouts of the text files: an article under its topic, and a logged generation run.
ARTICLE_NAME = r"article_(\d+)_(\d{8}_\d{6})"
ARTICLE_BODY = r"(?s)^Topic: ([^\n]*)\n\n(.*?)\n?\z"  # a file ends in a line break of its own
RUN_PROMPT = r"(?s)^### PROMPT USED ###\n(.*?)\n\n### MODEL OUTPUT ###\n"
RUN_OUTPUT = r"(?s)\n### MODEL OUTPUT ###\n(.*)\n\n### GENERATION TIME: [0-9.]+ seconds ###\s*$"
RUN_SECONDS = r"\n### GENERATION TIME: ([0-9.]+) seconds ###\s*$"


def read_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: str | StructType | None = None,
    multi_line: bool = True,
    encoding: str = "UTF-8",
) -> DataFrame:
    """CSV with a header and doubled quotes. Without a schema all columns are strings.

    Texts may hold line breaks inside quotes, and files of any size are read by as many tasks as they have byte
    ranges (:func:`records.records`). Without ``multi_line`` a line is a record, which takes one pass less.
    """
    options = {"header": True, "multiLine": multi_line, "quote": '"', "escape": '"', "encoding": encoding}
    reader = spark.read.options(**options, enforceSchema=False)
    paths = paths if isinstance(paths, str) else list(paths)
    if not multi_line:
        return (reader if schema is None else reader.schema(schema)).csv(paths)
    found = reader.csv(paths).schema
    wanted = found if schema is None else schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    if [n.lower() for n in wanted.names] != [n.lower() for n in found.names]:
        raise ValueError(f"the header names {found.names}, the schema {wanted.names}")
    return records.records(spark, paths, encoding).select(records.parsed(F.col("record"), wanted).alias("row")).select("row.*")


def read_jsonl(spark: SparkSession, paths: str | Sequence[str], schema: str | StructType | None = None) -> DataFrame:
    """One JSON object per line."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(paths if isinstance(paths, str) else list(paths))


def read_articles(
    spark: SparkSession,
    path: str,
    column: str,
    n: int = -1,
    seed=42,
    file_format: str | None = None,
) -> DataFrame:
    """The non-null texts of one column of a CSV or line-delimited JSON file.

    ``n`` takes an exact seeded sample of that size; -1 takes all.
    """
    kind = file_format or path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        df = read_csv(spark, path)
    elif kind in ("json", "jsonl"):
        df = read_jsonl(spark, path)
    else:
        raise ValueError(f"Cannot read '{kind}' files here; give CSV or line-delimited JSON")
    require_columns(df, column, where=path)
    texts = text_rows(df.select(column), column)
    if n == -1:
        return texts
    # Files have no row id. Equal texts are told apart by a number from 1 on; which of them gets which
    # number makes no difference, so the sample is the same however the file is split.
    keyed = texts.withColumns({"__row": F.monotonically_increasing_id(), "__key": F.sha2(F.col(column), 256)})
    numbered = hash_rank(keyed, seed, "__row", by=["__key"], name="__copy")
    return sample_exact(numbered, n, seed, id_col=["__key", "__copy"]).select(column)


def read_csv_tolerant(
    spark: SparkSession,
    path: str,
    columns: Sequence[str],
    encoding: str = "ISO-8859-1",
    multi_line: bool = True,
) -> DataFrame:
    """CSV whose bad records are skipped: too many cells drop a record, too few are filled with nulls.

    ``multi_line`` reads line breaks inside quotes, from as many tasks as the files have byte ranges. Without it
    a line is a record: lines are read whole and flagged first, and a flagged line is dropped only when it has more
    cells than the header. Column pruning is off then, because the flag depends on all columns.
    """
    if multi_line:
        found = records.records(spark, path, encoding).where(records.cell_count(F.col("record")) <= len(columns))
        named = StructType([StructField(c, StringType()) for c in columns])
        return found.select(records.parsed(F.col("record"), named).alias("row")).select("row.*")
    strings = [StructField(c, StringType()) for c in columns]
    schema = StructType([*strings, StructField(CORRUPT, StringType())])
    flagged = (
        spark.read.schema(schema)
        .options(
            header=True,
            mode="PERMISSIVE",
            columnNameOfCorruptRecord=CORRUPT,
            encoding=encoding,
            columnPruning=False,
            quote='"',
            escape='"',
        )
        .csv(path)
    )
    wide = StructType([StructField(f"c{i}", StringType()) for i in range(len(columns) + 1)])
    options = {"quote": '"', "escape": '"'}
    extra = F.from_csv(F.col(CORRUPT), wide.simpleString()[7:-1].replace(":", " "), options)
    too_long = F.col(CORRUPT).isNotNull() & extra[f"c{len(columns)}"].isNotNull()
    return flagged.where(~F.coalesce(too_long, F.lit(False))).select(*columns)


def read_stacked(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of several tables on top of each other; a column missing from one is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_corpus(
    spark: SparkSession, table: str, columns: Sequence[str], n: int = -1, seed=42, id_col: str = "doc_id"
) -> DataFrame:
    """Columns of a named table or Parquet path, all rows or an exact seeded sample."""
    df = spark.read.parquet(table) if "/" in table else spark.table(table)
    chosen = require_columns(df, *columns, where=table).select(*columns)
    return sample_exact(chosen, n, seed, id_col)


def whole_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``(value, file)``: the text and path of every file below ``path``."""
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))


def parse_articles(files: DataFrame) -> DataFrame:
    """``(idx, ts, topic, article)`` of article files, number and time from the file's path.

    Files with another kind of name are left out.
    """
    return files.where(F.col("file").rlike(ARTICLE_NAME)).select(
        F.regexp_extract("file", ARTICLE_NAME, 1).try_cast("bigint").alias("idx"),
        F.try_to_timestamp(F.regexp_extract("file", ARTICLE_NAME, 2), F.lit("yyyyMMdd_HHmmss")).alias("ts"),
        F.regexp_extract("value", ARTICLE_BODY, 1).alias("topic"),
        F.regexp_extract("value", ARTICLE_BODY, 2).alias("article"),
    )


def parse_run_logs(files: DataFrame) -> DataFrame:
    """``(idx, ts, prompt, output, seconds)`` of run logs; files with another kind of name are left out."""
    return files.where(F.col("file").rlike(ARTICLE_NAME)).select(
        F.regexp_extract("file", ARTICLE_NAME, 1).try_cast("bigint").alias("idx"),
        F.try_to_timestamp(F.regexp_extract("file", ARTICLE_NAME, 2), F.lit("yyyyMMdd_HHmmss")).alias("ts"),
        F.regexp_extract("value", RUN_PROMPT, 1).alias("prompt"),
        F.regexp_extract("value", RUN_OUTPUT, 1).alias("output"),
        F.regexp_extract("value", RUN_SECONDS, 1).try_cast("double").alias("seconds"),
    )


def read_article_files(spark: SparkSession, path: str) -> DataFrame:
    """Article text files as rows."""
    return parse_articles(whole_files(spark, path))


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """Run-log text files as rows."""
    return parse_run_logs(whole_files(spark, path))

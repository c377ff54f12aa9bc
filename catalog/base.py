"""Registry of queries, input tables and SQL fragments the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpometer.functions import text as T
from corpometer.functions.words import ENGLISH_STOP_WORDS, accent_table
from corpometer.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL if SQL can express it."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"Query '{name}' is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a corpus: the first ten sources stand for real text, the rest for synthetic."""
    side = F.when(F.substring("source", 4, 9).cast("int") < 10, "real").otherwise("synthetic")
    return texts(spark, folder).withColumn("corpus", side)


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents spread over the cores when their file has too few splits for that."""
    return spread(table(spark, folder, "documents"), "doc_id")


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings with a corpus by label."""
    side = F.when(F.col("label") < 5, "real").otherwise("synthetic")
    return table(spark, folder, "embeddings").withColumn("corpus", side)


def generation_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a generation log: the type as model, the value as seconds, the id as batch."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("batch_id"),
        F.col("event_type").alias("model"),
        F.col("value").alias("elapsed_time"),
    )


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def text_list(values: Column) -> Column:
    return F.array_join(values, " ")


# --- SQL fragments ---

DOCS = """(SELECT doc_id, text, lang, source, n_chars,
  CASE WHEN CAST(substr(source, 4) AS INTEGER) < 10 THEN 'real' ELSE 'synthetic' END AS corpus
  FROM documents)"""
VECS = "(SELECT *, CASE WHEN label < 5 THEN 'real' ELSE 'synthetic' END AS corpus FROM embeddings)"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def quoted_list(values) -> str:
    return ", ".join(quoted(v) for v in values)


STOPS = quoted_list(ENGLISH_STOP_WORDS)
SPACES = quoted(T.SPACE + "+")


def sql_space(col: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({col}), {SPACES}), lambda t: t <> '')"


def sql_simple(col: str, stops: str | None = STOPS) -> str:
    source, target = accent_table()
    found = f"regexp_extract_all(translate(lower({col}), {quoted(source)}, {quoted(target)}), {quoted(T.ALPHABETIC)})"
    stop = f" AND t NOT IN ({stops})" if stops else ""
    return f"list_filter({found}, lambda t: length(t) BETWEEN 2 AND 15 AND NOT starts_with(t, '_'){stop})"


def sql_words(col: str) -> str:
    step = f"regexp_replace(lower({col}), {quoted(T.FUSED)}, '\\1\\3\\5\\7 \\2\\4\\6\\8', 'g')"
    step = f"regexp_replace({step}, {quoted(T.SHORTENED)}, '\\1\\2', 'g')"
    step = f"regexp_replace({step}, {quoted(T.CONTRACTION)}, ' \\1', 'g')"
    step = f"regexp_replace({step}, {quoted(T.APART)}, ' ', 'g')"
    step = f"regexp_replace({step}, {quoted(T.CLOSING)}, '\\1', 'g')"
    step = f"regexp_replace({step}, {quoted(T.OPENING)}, '\\1', 'g')"
    return f"list_filter(regexp_split_to_array({step}, {SPACES}), lambda t: t <> '')"


def sql_alphabetic(col: str) -> str:
    return (
        f"list_filter({sql_words(col)}, lambda t: regexp_full_match(t, {quoted(T.LETTERS_ONLY)}) "
        f"AND t NOT IN ({STOPS}))"
    )


def sql_tfidf_tokens(col: str) -> str:
    return f"list_filter(regexp_extract_all(lower({col}), {quoted(T.WORD_RUN)}), lambda t: t NOT IN ({STOPS}))"

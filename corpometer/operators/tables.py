"""Row and column work on article tables: choose, rename, check, clean, put together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpometer.functions import text as T

INDEX_COLUMN = "Unnamed: 0"  # name a saved row index gets when it is read back


def require_columns(df: DataFrame, *names: str, where: str = "input") -> DataFrame:
    """``df`` itself, or a ValueError that lists the columns there are."""
    for name in names:
        if name not in df.columns:
            raise ValueError(f"{where} has no column '{name}'; it has {', '.join(df.columns)}")
    return df


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename the columns that are there."""
    return df.withColumnsRenamed(dict(names))


def without_index(df: DataFrame, name: str = INDEX_COLUMN) -> DataFrame:
    """Drop a saved row index if there is one."""
    return df.drop(name)


def text_rows(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows whose text is not null, as strings."""
    return df.where(F.col(text_col).isNotNull()).withColumn(text_col, F.col(text_col).cast("string"))


def non_empty(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows with a text that is neither null nor empty."""
    return df.where(T.has_text(text_col))


def with_tokens_left(
    df: DataFrame, text_col: str = "text", tokenizer: str = "simple", name: str = "tokens", **options
) -> DataFrame:
    """Add tokens and drop the documents that have none."""
    return df.withColumn(name, T.tokenize(text_col, tokenizer, **options)).where(F.size(name) > 0)


def without_failed(df: DataFrame, text_col: str = "generated_article") -> DataFrame:
    """Rows that hold an article and not a stored error message; null texts stay."""
    return df.where(~F.coalesce(T.generation_failed(text_col), F.lit(False)))


def without_header_rows(df: DataFrame, column: str = "id") -> DataFrame:
    """Drop header lines that stacking files left among the rows (a cell equal to its own name)."""
    return df.where(~F.col(column).eqNullSafe(column))


def labelled_union(parts: Mapping[object, DataFrame], label_col: str = "corpus") -> DataFrame:
    """Stack tables and write each one's name into ``label_col``."""
    named = [part.withColumn(label_col, F.lit(label)) for label, part in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def distinct_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows found in either table, once each."""
    return first.unionByName(second).distinct()


def results_onto(inputs: DataFrame, results: DataFrame, on: str = "id") -> DataFrame:
    """Put result columns back on their input rows; inputs without a result stay."""
    return inputs.join(results, on, "left")


def token_limits(
    df: DataFrame, text_col: str = "text", k: int = 100, spread: int = 100
) -> DataFrame:
    """Prefix of ``k`` words, and how many more tokens to ask for, from the original's length."""
    longest = F.greatest(T.word_count(text_col) - k, F.lit(0))
    return df.withColumns(
        {
            "prefix": T.first_words(text_col, k),
            "max_new_tokens": longest.cast("bigint"),
            "min_new_tokens": F.greatest(longest - spread, F.lit(0)).cast("bigint"),
        }
    )


def top_rows(df: DataFrame, by: Column | str, k: int, *ties: str) -> DataFrame:
    """The ``k`` rows with the largest ``by``."""
    return df.orderBy(F.desc(by) if isinstance(by, str) else by.desc(), *ties).limit(k)


def owned_by(df: DataFrame, owner: str, owner_col: str = "person") -> DataFrame:
    """Rows of one owner."""
    return df.where(F.col(owner_col) == owner)


def columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns, checked first."""
    return require_columns(df, *names).select(*names)

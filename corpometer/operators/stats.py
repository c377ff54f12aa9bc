"""Length and vocabulary statistics, grouped by corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpometer.functions import text as T
from corpometer.functions.arrays import truncate
from corpometer.operators.joins import attach


#: One of the named tokenisers, or a function from a text column to a column of tokens.
Tokenizer = str | Callable[[Column], Column]


def _tokens(text_col: str, tokenizer: Tokenizer, max_length: int | None) -> Column:
    tokens = tokenizer(F.col(text_col)) if callable(tokenizer) else T.tokenize(text_col, tokenizer, stop_words=None)
    return truncate(tokens, max_length, context=None)


def token_counts(
    df: DataFrame,
    text_col: str = "text",
    corpus_col: str = "corpus",
    tokenizer: Tokenizer = "space",
    max_length: int | None = None,
) -> DataFrame:
    """How often each token occurs in each corpus: ``(corpus, token, n)``."""
    exploded = df.select(
        corpus_col, F.explode(_tokens(text_col, tokenizer, max_length)).alias("token")
    )
    return exploded.groupBy(corpus_col, "token").agg(F.count(F.lit(1)).alias("n"))


def vocabulary_stats(counts: DataFrame, corpus_col: str = "corpus") -> DataFrame:
    """Tokens, types, type-token ratio and share of types seen once, from token counts."""
    types = F.count(F.lit(1))
    total = F.sum("n")
    return counts.groupBy(corpus_col).agg(
        total.cast("bigint").alias("n_tokens"),
        types.alias("n_types"),
        (types / total).alias("ttr"),
        (F.sum(F.when(F.col("n") == 1, 1).otherwise(0)) / types).alias("hapax_ratio"),
    )


def _one_pass(
    df: DataFrame, text_col: str, corpus_col: str, tokenizer: Tokenizer, max_length: int | None
) -> DataFrame:
    """Token counts, and in the row of the null token the sums over documents.

    Each document's tokens get a null in front, whose row carries the document's own numbers, so
    one scan and one shuffle of partial counts serve both kinds of statistics.
    """
    sized = df.where(F.col(text_col).isNotNull()).select(
        corpus_col,
        _tokens(text_col, tokenizer, max_length).alias("__t"),
        F.length(text_col).cast("bigint").alias("__chars"),
    )
    rows = sized.select(
        corpus_col,
        "__chars",
        F.size("__t").cast("double").alias("__size"),
        F.posexplode(F.concat(F.array(F.lit(None).cast("string")), "__t")).alias("__p", "token"),
    )
    head = F.col("__p") == 0
    return rows.groupBy(corpus_col, "token").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(head, F.col("__size"))).alias("size"),
        F.stddev_pop(F.when(head, F.col("__size"))).alias("spread"),
        F.sum(F.when(head, F.col("__chars"))).alias("chars"),
    )


def length_stats(
    df: DataFrame,
    text_col: str = "text",
    corpus_col: str = "corpus",
    tokenizer: Tokenizer = "space",
    max_length: int | None = None,
) -> DataFrame:
    """Documents, mean and population deviation of the token count, mean characters."""
    size = F.size(_tokens(text_col, tokenizer, max_length))
    sized = df.where(F.col(text_col).isNotNull()).select(
        corpus_col, size.alias("__size"), F.length(text_col).alias("__chars")
    )
    return sized.groupBy(corpus_col).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.avg("__size").alias("avg_len_tokens"),
        F.stddev_pop("__size").alias("std_len_tokens"),
        F.avg("__chars").alias("avg_len_chars"),
    )


def corpus_stats(
    df: DataFrame,
    text_col: str = "text",
    corpus_col: str = "corpus",
    tokenizer: Tokenizer = "space",
    max_length: int | None = None,
) -> DataFrame:
    """One row per corpus: documents, token lengths, characters, ratios of types to tokens.

    A corpus whose documents hold no token has a ratio of 0.
    """
    counts = _one_pass(df, text_col, corpus_col, tokenizer, max_length)
    document, word = F.col("token").isNull(), F.col("token").isNotNull()
    docs = F.max(F.when(document, F.col("n")))
    tokens = F.coalesce(F.sum(F.when(word, F.col("n"))), F.lit(0))
    types = F.count("token")
    once = F.sum(F.when(word & (F.col("n") == 1), 1).otherwise(0))
    sums = counts.groupBy(corpus_col).agg(
        docs.alias("n_docs"),
        F.max("size").alias("__size"),
        F.max("spread").alias("__spread"),
        F.max("chars").alias("__chars"),
        tokens.alias("n_tokens"),
        types.alias("n_types"),
        once.alias("__once"),
    )
    mean = F.col("__size") / F.col("n_docs")

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))

    return sums.select(
        corpus_col,
        "n_docs",
        mean.alias("avg_len_tokens"),
        F.col("__spread").alias("std_len_tokens"),
        (F.col("__chars") / F.col("n_docs")).alias("avg_len_chars"),
        "n_tokens",
        "n_types",
        share("n_types", "n_tokens").alias("ttr"),
        share("__once", "n_types").alias("hapax_ratio"),
    )


def token_stats(
    df: DataFrame,
    text_col: str = "text",
    corpus_col: str = "corpus",
    max_length: int | None = None,
    tokenizer: Tokenizer = "space",
) -> DataFrame:
    """Corpus statistics on whole documents, or on the first ``max_length`` tokens of each."""
    return corpus_stats(df, text_col, corpus_col, tokenizer, max_length)


def long_form(stats: DataFrame, corpus_col: str = "corpus") -> DataFrame:
    """``(corpus, metric, value)`` from one column per metric."""
    names = [c for c in stats.columns if c != corpus_col]
    pairs = F.array(
        *[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names]
    )
    return stats.select(corpus_col, F.inline(pairs))


def side_by_side(metrics: DataFrame, corpora, corpus_col: str = "corpus") -> DataFrame:
    """One row per metric, one column per corpus."""
    return metrics.groupBy("metric").pivot(corpus_col, list(corpora)).agg(F.first("value"))


def document_frequency(
    df: DataFrame, tokens: Column, id_col: str = "doc_id", corpus_col: str = "corpus"
) -> DataFrame:
    """In how many documents, and how often in all, each token occurs: ``(corpus, token, df, cf)``.

    Each document's tokens are counted before rows are shuffled, so a common word costs one row
    per input partition.
    """
    marks = F.concat(
        F.transform(F.array_distinct("__t"), lambda t: F.struct(t.alias("token"), F.lit(1).alias("d"), F.lit(0).alias("c"))),
        F.transform("__t", lambda t: F.struct(t.alias("token"), F.lit(0).alias("d"), F.lit(1).alias("c"))),
    )
    return (
        df.select(corpus_col, tokens.alias("__t"))
        .select(corpus_col, F.inline(marks))
        .groupBy(corpus_col, "token")
        .agg(F.sum("d").alias("df"), F.sum("c").alias("cf"))
    )


def frequent_tokens(
    frequencies: DataFrame,
    n_docs: DataFrame,
    no_below: int = 5,
    no_above: float = 0.5,
    corpus_col: str = "corpus",
) -> DataFrame:
    """Tokens in at least ``no_below`` documents and at most the share ``no_above`` of them.

    ``n_docs`` is ``(corpus, n_docs)``; the share is cut down to a whole number of documents.
    """
    sized = attach(frequencies, n_docs.select(corpus_col, "n_docs"), [corpus_col], how="inner")
    return sized.where(
        (F.col("df") >= no_below) & (F.col("df") <= F.floor(F.col("n_docs") * F.lit(no_above)))
    ).drop("n_docs")


def documents_per_corpus(df: DataFrame, corpus_col: str = "corpus") -> DataFrame:
    """``(corpus, n_docs)``."""
    return df.groupBy(corpus_col).agg(F.count(F.lit(1)).alias("n_docs"))


def longest_text(df: DataFrame, text_col: str = "text", corpus_col: str = "corpus") -> DataFrame:
    """Largest number of single-space pieces in a text of each corpus."""
    return df.groupBy(corpus_col).agg(F.max(T.single_space_count(text_col)).alias("longest"))


def pooled_vectors(
    df: DataFrame, by: str = "doc_id", vector_col: str = "vector", mask_col: str = "mask"
) -> DataFrame:
    """Mean of the token vectors whose mask is 1; a zero vector where no mask is 1.

    Values are summed place by place, with partial sums before the shuffle.
    """
    placed = df.select(by, mask_col, F.posexplode(vector_col).alias("place", "__x"))
    used = F.when(F.col(mask_col) == 1, F.col("__x").cast("double")).otherwise(F.lit(0.0))
    seen = F.sum(F.when(F.col(mask_col) == 1, 1).otherwise(0))
    return placed.groupBy(by, "place").agg(
        (F.sum(used) / F.greatest(seen, F.lit(1))).alias("value")
    )

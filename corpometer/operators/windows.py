"""Sliding token windows: in how many windows a word, or two words together, occur.

A document of ``n`` tokens has ``n - width + 1`` windows, one per start, and one if it is shorter
than the width. A word at place ``p`` is in the windows that start between ``p - width + 1`` and
``p``, so a word's windows are a few intervals of starts and never have to be listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpometer.operators.joins import attach

WIDTH = 110  # tokens per window of the C_v measure
BLOCK = 2048  # starts per block when the intervals of two words are compared


def window_totals(
    df: DataFrame, tokens: Column, width: int = WIDTH, corpus_col: str = "corpus"
) -> DataFrame:
    """``(corpus, n_windows)`` over all documents."""
    per_doc = F.greatest(F.size(tokens) - F.lit(width - 1), F.lit(1))
    return df.select(corpus_col, per_doc.alias("__n")).groupBy(corpus_col).agg(
        F.sum("__n").alias("n_windows")
    )


def word_intervals(
    df: DataFrame,
    tokens: Column,
    words: DataFrame,
    width: int = WIDTH,
    id_col: str = "doc_id",
    corpus_col: str = "corpus",
) -> DataFrame:
    """Merged intervals of window starts that hold a word: ``(corpus, id, word, first, last)``.

    ``words`` is a distinct ``(corpus, word)`` table, small enough to broadcast as a rule.
    """
    # The size is taken before the explode; after it, it would be worked out again for each token.
    # The outer explode keeps Spark from adding a filter that would make the tokens a second time.
    sized = df.select(corpus_col, id_col, tokens.alias("__t")).withColumn("__n", F.size("__t"))
    places = sized.select(corpus_col, id_col, "__n", F.posexplode_outer("__t").alias("__p", "word"))
    used = attach(places, words.select(corpus_col, "word"), [corpus_col, "word"], how="inner")
    top = F.greatest(F.col("__n") - width, F.lit(0))
    ranges = used.select(
        corpus_col,
        id_col,
        "word",
        F.greatest(F.col("__p") - F.lit(width - 1), F.lit(0)).alias("__a"),
        F.least(F.col("__p"), top).alias("__b"),
    )
    in_doc = Window.partitionBy(corpus_col, id_col, "word").orderBy("__a", "__b")
    starts = F.coalesce(F.col("__a") > F.lag("__b").over(in_doc) + 1, F.lit(True))
    numbered = ranges.withColumn("__new", starts.cast("int")).withColumn(
        "__island", F.sum("__new").over(in_doc.rowsBetween(Window.unboundedPreceding, 0))
    )
    return numbered.groupBy(corpus_col, id_col, "word", "__island").agg(
        F.min("__a").alias("first"), F.max("__b").alias("last")
    ).drop("__island")


def word_windows(intervals: DataFrame, corpus_col: str = "corpus") -> DataFrame:
    """``(corpus, word, n)``: windows that hold the word."""
    return intervals.groupBy(corpus_col, "word").agg(
        F.sum(F.col("last") - F.col("first") + 1).alias("n")
    )


def pair_windows(
    intervals: DataFrame,
    pairs: DataFrame,
    id_col: str = "doc_id",
    corpus_col: str = "corpus",
    block: int = BLOCK,
) -> DataFrame:
    """``(corpus, word_a, word_b, n)``: windows that hold both words of a listed pair.

    Intervals are cut at block borders and joined on document, block and word. One word's merged
    intervals do not touch, so a block holds only a few of them and the join stays in proportion.
    """
    cut = intervals.select(
        corpus_col,
        id_col,
        "word",
        "first",
        "last",
        F.explode(
            F.sequence(F.floor(F.col("first") / block), F.floor(F.col("last") / block))
        ).alias("__k"),
    ).select(
        corpus_col,
        id_col,
        "word",
        "__k",
        F.greatest(F.col("first"), F.col("__k") * block).alias("__a"),
        F.least(F.col("last"), (F.col("__k") + 1) * block - 1).alias("__b"),
    )
    left = attach(
        cut.withColumnRenamed("word", "word_a"),
        pairs.select(corpus_col, "word_a", "word_b"),
        [corpus_col, "word_a"],
        how="inner",
    ).select(corpus_col, id_col, "__k", "word_a", "word_b", F.col("__a").alias("__a1"), F.col("__b").alias("__b1"))
    right = cut.withColumnRenamed("word", "word_b")
    both = left.join(right, [corpus_col, id_col, "__k", "word_b"]).where(
        (F.col("__a") <= F.col("__b1")) & (F.col("__a1") <= F.col("__b"))
    )
    overlap = F.least("__b", "__b1") - F.greatest("__a", "__a1") + 1
    return both.groupBy(corpus_col, "word_a", "word_b").agg(F.sum(overlap).cast("bigint").alias("n"))

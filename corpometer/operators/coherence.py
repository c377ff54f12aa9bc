"""Topic coherence C_v for any table of topic words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpometer.operators.joins import attach, bounded
from corpometer.operators.windows import WIDTH, pair_windows, window_totals, word_intervals, word_windows
from corpometer.session import stored

EPSILON = 1e-12


def top_words(
    weights: DataFrame, k: int = 20, corpus_col: str = "corpus"
) -> DataFrame:
    """The ``k`` heaviest words of each topic of ``(corpus, topic, word, weight)``, with their rank.

    The rank filter is applied before rows are shuffled, so each task sends ``k`` rows per topic.
    """
    order = Window.partitionBy(corpus_col, "topic").orderBy(F.desc("weight"), "word")
    ranked = weights.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(corpus_col, "topic", F.col("rank").cast("bigint").alias("rank"), "word")


def topic_pairs(topics: DataFrame, corpus_col: str = "corpus") -> DataFrame:
    """Distinct pairs of words of one topic, each with ``word_a < word_b``."""
    a = topics.select(corpus_col, "topic", F.col("word").alias("word_a"))
    b = topics.select(corpus_col, "topic", F.col("word").alias("word_b"))
    return (
        a.join(b, [corpus_col, "topic"])
        .where(F.col("word_a") < F.col("word_b"))
        .select(corpus_col, "word_a", "word_b")
        .distinct()
    )


def window_counts(
    df: DataFrame,
    tokens: Column,
    topics: DataFrame,
    width: int = WIDTH,
    id_col: str = "doc_id",
    corpus_col: str = "corpus",
) -> DataFrame:
    """``(corpus, word_a, word_b, n)`` for all topic words; a word paired with itself is its own count."""
    words = topics.select(corpus_col, "word").distinct()
    intervals = stored(word_intervals(df, tokens, words, width, id_col, corpus_col), "intervals")
    single = word_windows(intervals, corpus_col).select(
        corpus_col, F.col("word").alias("word_a"), F.col("word").alias("word_b"), "n"
    )
    return single.unionByName(
        pair_windows(intervals, topic_pairs(topics, corpus_col), id_col, corpus_col)
    )


def similarities(
    topics: DataFrame, counts: DataFrame, totals: DataFrame, corpus_col: str = "corpus"
) -> DataFrame:
    """NPMI of all ordered word pairs of each topic: ``(corpus, topic, word_a, word_b, npmi)``."""
    single = counts.where(F.col("word_a") == F.col("word_b"))
    pairs = counts.where(F.col("word_a") != F.col("word_b"))
    both = counts.unionByName(
        pairs.select(corpus_col, F.col("word_b").alias("word_a"), F.col("word_a").alias("word_b"), "n")
    )
    a = topics.select(corpus_col, "topic", F.col("word").alias("word_a"))
    b = topics.select(corpus_col, "topic", F.col("word").alias("word_b"))
    grid = a.join(b, [corpus_col, "topic"])
    na = single.select(corpus_col, "word_a", F.col("n").alias("__na"))
    nb = single.select(corpus_col, F.col("word_a").alias("word_b"), F.col("n").alias("__nb"))
    sized = (
        grid.join(both, [corpus_col, "word_a", "word_b"], "left")
        .join(na, [corpus_col, "word_a"], "left")
        .join(nb, [corpus_col, "word_b"], "left")
    )
    sized = attach(sized, totals, [corpus_col], how="inner")
    w = F.col("n_windows")
    together = F.coalesce(F.col("n") / w, F.lit(0.0))
    apart = (F.col("__na") / w) * (F.col("__nb") / w)
    npmi = (
        F.when(F.coalesce("__na", F.lit(0)) * F.coalesce("__nb", F.lit(0)) == 0, F.lit(0.0))
        .when(together == 1, F.lit(1.0))
        .otherwise(F.log((together + EPSILON) / apart) / -F.log(together + EPSILON))
    )
    return sized.select(corpus_col, "topic", "word_a", "word_b", npmi.alias("npmi"))


def coherence(
    df: DataFrame,
    tokens: Column,
    topics: DataFrame,
    width: int = WIDTH,
    id_col: str = "doc_id",
    corpus_col: str = "corpus",
    skip_irrelevant: bool = False,
) -> DataFrame:
    """C_v of each topic: ``(corpus, topic, c_v)``.

    Every word's vector of NPMI with all words of the topic is compared by cosine with the sum of
    the topic's vectors; the topic's value is the mean over its words. With ``skip_irrelevant`` the
    windows of documents without any topic word are not counted.
    """
    topics = _local(topics)
    used = df
    if skip_irrelevant:
        words = topics.select(corpus_col, "word").distinct()
        found = df.select(corpus_col, id_col, F.explode(tokens).alias("word"))
        hits = attach(found, words, [corpus_col, "word"], how="left_semi").select(id_col).distinct()
        used = df.join(hits, id_col, "left_semi")
    counts = _local(window_counts(df, tokens, topics, width, id_col, corpus_col))
    totals = window_totals(used, tokens, width, corpus_col)
    return coherence_of(similarities(topics, counts, totals, corpus_col), corpus_col)


def _local(table: DataFrame) -> DataFrame:
    """Topic tables as local ones while they are small, which they are unless topics are many.

    The table is stored first, so that what is behind it runs once whatever its size.
    """
    table = stored(table, "topics")
    local = bounded(table)
    return table if local is None else local


def coherence_of(pairs: DataFrame, corpus_col: str = "corpus") -> DataFrame:
    """C_v of each topic from its NPMI pairs."""
    whole = Window.partitionBy(corpus_col, "topic", "word_b")
    summed = pairs.withColumn("__s", F.sum("npmi").over(whole))
    cosines = summed.groupBy(corpus_col, "topic", "word_a").agg(
        F.sum(F.col("npmi") * F.col("__s")).alias("__dot"),
        F.sqrt(F.sum(F.col("npmi") * F.col("npmi"))).alias("__len"),
        F.sqrt(F.sum(F.col("__s") * F.col("__s"))).alias("__sum_len"),
    )
    size = F.col("__len") * F.col("__sum_len")
    cosine = F.when(size == 0, F.lit(0.0)).otherwise(F.col("__dot") / size)
    return cosines.groupBy(corpus_col, "topic").agg(F.avg(cosine).alias("c_v"))


def mean_coherence(per_topic: DataFrame, corpus_col: str = "corpus") -> DataFrame:
    """``(corpus, coherence)``: mean over topics."""
    return per_topic.groupBy(corpus_col).agg(F.avg("c_v").alias("coherence"))

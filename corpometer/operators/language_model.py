"""Loss of texts under a bigram model, and perplexity from losses of any model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpometer.operators.joins import attach_row, lookup
from corpometer.operators.kneser_ney import as_numbers, in_parts, parts_of
from corpometer.session import settled, stored


def bigrams(tokens: Column) -> Column:
    """Array of ``(w1, w2)`` of all neighbouring tokens; the last token comes with a null ``w2``."""
    following = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(1)))
    return F.zip_with(tokens, following, lambda a, b: F.struct(a.alias("w1"), b.alias("w2")))


def bigram_counts(df: DataFrame, tokens: Column, *by: str) -> DataFrame:
    """``(*by, w1, w2, n)``, added up where the documents are read before anything is moved."""
    # Tokens become a column first, so that a text is split once and not for each use of them.
    return (
        df.select(*by, tokens.alias("__t"))
        .select(*by, F.inline(bigrams(F.col("__t"))))
        .groupBy(*by, "w1", "w2")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def bigram_losses(
    counts: DataFrame,
    train: str,
    k: float = 0.1,
    vocabulary: int | None = None,
    corpus_col: str = "corpus",
) -> DataFrame:
    """``(w1, w2, n, loss)`` for every bigram of any corpus, ``n`` added up over corpora.

    ``counts`` is a stored ``(corpus, w1, w2, n)``. The loss is
    ``-ln((c(w1, w2) + k) / (c(w1) + k * V))`` with the counts of the training corpus and ``V`` its
    distinct tokens and one for all others.
    """
    trained = _trained(train, corpus_col)
    pairs = counts.groupBy("w1", "w2").agg(F.sum(trained).alias("__pair"), F.sum("n").alias("n"))
    return _with_loss(pairs, counts, train, k, vocabulary, corpus_col).select("w1", "w2", "n", "loss")


def _trained(train: str, corpus_col: str) -> Column:
    return F.when(F.col(corpus_col) == train, F.col("n")).otherwise(0)


def _with_loss(
    pairs: DataFrame, counts: DataFrame, train: str, k: float, vocabulary: int | None, corpus_col: str
) -> DataFrame:
    trained = _trained(train, corpus_col)
    followed = F.when(F.col("w2").isNotNull(), trained).otherwise(0)
    contexts = stored(counts.groupBy("w1").agg(F.sum(followed).alias("__context"), F.sum(trained).alias("__seen"), F.sum("n").alias("__n")), "contexts")
    joined = lookup(pairs.where(F.col("w2").isNotNull()), contexts.drop("__seen"), ["w1"], weight="__n", how="inner")
    if vocabulary is None:
        known = contexts.agg((F.sum(F.when(F.col("__seen") > 0, 1).otherwise(0)) + 1).alias("__v"))
        joined, size = attach_row(joined, known), F.col("__v")
    else:
        size = F.lit(vocabulary)
    probability = (F.col("__pair") + F.lit(float(k))) / (F.col("__context") + F.lit(float(k)) * size)
    return joined.withColumn("loss", -F.log(probability))


def _contexts(pairs: DataFrame) -> DataFrame:
    """``(w1, context)`` of stored training bigrams: how often each word was followed by another.

    Every training word is there, the last of a text with a null ``w2``, so rows count the vocabulary.
    """
    followed = F.when(F.col("w2").isNotNull(), F.col("n")).otherwise(0)
    return stored(pairs.groupBy("w1").agg(F.sum(followed).alias("context")), "contexts")


def _parts_of_loss(words: DataFrame, pairs: DataFrame, contexts: DataFrame, k: float, *by: str) -> DataFrame:
    """``(*by, nll, n_tokens)`` as the sum of two parts, of which neither needs the other's join.

    ``-ln((c(w1, w2) + k) / (c(w1) + k * V))`` is a part of the first word and a part of the pair:
    ``words`` is ``(*by, w1, n)``, ``pairs`` is ``(*by, pair, n)`` with the training count of each pair.
    """
    ahead = _ahead(words.join(contexts, "w1", "left"), contexts, k, *by)
    return _summed(ahead.union(_behind(pairs, k, *by)), *by)


def _ahead(words: DataFrame, contexts: DataFrame, k: float, *by: str) -> DataFrame:
    """The first words' part, of ``(*by, n, context)``."""
    size = contexts.agg((F.count(F.lit(1)) + 1).alias("__v"))
    context = F.log(F.coalesce("context", F.lit(0)) + F.lit(float(k)) * F.col("__v"))
    return attach_row(words, size).select(*by, (F.col("n") * context).alias("nll"), F.col("n").alias("n_tokens"))


def _behind(pairs: DataFrame, k: float, *by: str) -> DataFrame:
    """The pairs' part, of ``(*by, n, pair)``."""
    pair = -F.log(F.coalesce("pair", F.lit(0)) + F.lit(float(k)))
    return pairs.select(*by, (F.col("n") * pair).alias("nll"), F.lit(0).cast("bigint").alias("n_tokens"))


def _summed(losses: DataFrame, *by: str) -> DataFrame:
    return losses.groupBy(*by).agg(F.sum("nll").alias("nll"), F.sum("n_tokens").alias("n_tokens"))


def corpus_losses(
    df: DataFrame, tokens: Column, train: str, k: float = 0.1, corpus_col: str = "corpus"
) -> DataFrame:
    """``(corpus, nll, n_tokens)`` under a bigram model trained on the corpus ``train``.

    Only distinct bigrams are scored, so a frequent one costs a single row per corpus; the rows of
    one bigram, which share a window, are as many as there are corpora.
    """
    counts = stored(bigram_counts(df, tokens, corpus_col), "bigrams")
    contexts = _contexts(counts.where(F.col(corpus_col) == train))
    followed = counts.where(F.col("w2").isNotNull())
    words = followed.groupBy(corpus_col, "w1").agg(F.sum("n").alias("n"))
    same_pair = Window.partitionBy("w1", "w2")
    pairs = followed.withColumn("pair", F.sum(_trained(train, corpus_col)).over(same_pair))
    return _parts_of_loss(words, pairs, contexts, k, corpus_col)


def document_losses(
    df: DataFrame,
    tokens: Column,
    train: str,
    k: float = 0.1,
    id_col: str = "doc_id",
    corpus_col: str = "corpus",
) -> DataFrame:
    """``(corpus, id, nll, n_tokens)``; documents with fewer than two tokens get zeros.

    A document is one (corpus, id) pair, so corpora may number their documents alike. Words become 64-bit
    numbers, checked to be one for each word, and texts are stored as these. The first words' part meets the
    commonest words where a text is read. For the other part the training bigrams are counted, and those of
    all texts joined to them as they are, while adaptive execution splits the partitions of frequent ones; many
    words go in parts, by a hash of the bigram, one after the other.
    """
    spark, by = df.sparkSession, [corpus_col, id_col]

    def sums() -> DataFrame:
        texts = stored(as_numbers(df.select(*by, tokens.alias("__t"))).where(F.size("words") > 0), "numbered-words")
        all_rows = texts.select(*by, F.inline(bigrams(F.col("words"))))
        trained = all_rows.where(F.col(corpus_col) == train).select("w1", "w2")
        contexts = _contexts(trained.withColumn("n", F.lit(1).cast("bigint")))
        rows = all_rows.where(F.col("w2").isNotNull()).withColumn("n", F.lit(1).cast("bigint"))
        found = lookup(rows.select(*by, "w1", "n"), contexts.withColumn("weight", F.col("context")), ["w1"], weight="weight")
        ahead = stored(_summed(_ahead(found, contexts, k, *by), *by), "document-sums")

        def of_pairs(rows: DataFrame, trained: DataFrame) -> DataFrame:
            seen = stored(trained.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("pair")), "training-bigrams")
            return _summed(_behind(rows.join(seen, ["w1", "w2"], "left"), k, *by), *by)

        step = lambda rows, trained: settled(spark, lambda: of_pairs(rows, trained), "document-sums")
        behind = in_parts(step, [rows, trained.where(F.col("w2").isNotNull())], ["w1", "w2"], parts_of(texts), "document-sums")
        return _summed(ahead.union(behind), *by)

    return df.select(*by).join(settled(spark, sums, "document-losses"), by, "left").na.fill({"nll": 0.0, "n_tokens": 0})


def perplexity(losses: DataFrame, corpus_col: str = "corpus") -> DataFrame:
    """``(corpus, perplexity)``: the exponent of total loss over predicted tokens.

    Works on losses per document, batch or corpus. Batches that failed count for nothing; a corpus
    without tokens gets null.
    """
    total = F.sum("n_tokens")
    return losses.groupBy(corpus_col).agg(
        F.exp(F.sum("nll") / F.nullif(total, F.lit(0))).alias("perplexity")
    )


def mean_batch_loss(losses: DataFrame, batch_col: str = "batch_id", average: str = "macro") -> DataFrame:
    """One number for losses that carry a batch number.

    'macro' is the plain mean of the batches' mean losses; 'micro' weights each by its tokens.
    """
    per_batch = losses.groupBy(batch_col).agg(F.sum("nll").alias("nll"), F.sum("n_tokens").alias("n"))
    if average == "micro":
        return per_batch.agg((F.sum("nll") / F.nullif(F.sum("n"), F.lit(0))).alias("loss"))
    if average != "macro":
        raise ValueError("average is 'macro' or 'micro'")
    return per_batch.agg(F.avg(F.col("nll") / F.nullif(F.col("n"), F.lit(0))).alias("loss"))

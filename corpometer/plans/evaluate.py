"""One table with all measures of all corpora."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpometer.functions import text as T
from corpometer.functions.arrays import truncate
from corpometer.functions.keys import order_key
from corpometer.operators import kneser_ney
from corpometer.operators import language_model as lm
from corpometer.operators import stats
from corpometer.operators.density import density_curve, length_quantiles, value_counts
from corpometer.operators.distance import sliced_distances, sliced_wasserstein
from corpometer.operators.ranks import first_by_hash
from corpometer.plans.classify import classify_texts
from corpometer.plans.topics import topic_coherence

HELD_OUT = 0.1  # share of the training corpus that perplexity is measured on
MODES = ("real", "synthetic", "both")
COSTLY = ("coherence", "perplexity")
TRAINING = "\u0000training"  # name of the rows a model is trained on, while losses are worked out


def _metric_rows(df: DataFrame, names: Sequence[str], corpus_col: str) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]
    )
    return df.select(F.col(corpus_col).alias("corpus"), F.inline(pairs)).withColumn(
        "detail", F.lit(None).cast("string")
    )


def lengths_and_words(df: DataFrame, text_col: str = "text", corpus_col: str = "corpus") -> DataFrame:
    """The statistics of each corpus as metric rows."""
    table = stats.corpus_stats(df, text_col, corpus_col)
    names = ("n_docs", "avg_len_tokens", "std_len_tokens", "avg_len_chars", "ttr", "hapax_ratio")
    return _metric_rows(table, names, corpus_col)


def perplexities(
    df: DataFrame,
    train: str,
    text_col: str = "text",
    id_col: str = "doc_id",
    corpus_col: str = "corpus",
    max_length: int | None = None,
    k: float = 0.1,
    held_out: float = HELD_OUT,
    seed=42,
    order: int = 2,
) -> DataFrame:
    """Perplexity of each corpus under a model of the corpus ``train``, as metric rows.

    An ``order`` of 2 is the bigram model with ``k`` added to each count; of 3 and more Kneser-Ney's.

    The share ``held_out`` of that corpus, chosen by a hash of the id, is not learned from, and only
    those rows stand for it; with 0 it is measured on what the model has seen. Whole texts are read
    unless ``max_length`` sets a limit in tokens. ``detail`` says what the model was trained on.
    """
    tokens = truncate(T.space_tokens(text_col), max_length, context=None)

    def losses_of(rows: DataFrame, name: str) -> DataFrame:
        if order > 2:
            return kneser_ney.corpus_losses(rows, tokens, name, order, corpus_col)
        return lm.corpus_losses(rows, tokens, name, k, corpus_col)

    learned = F.col(corpus_col) == train
    if held_out:
        learned &= F.substring(order_key(seed, id_col), 1, 8) >= f"{round(held_out * 2**32):08x}"
        rows = df.withColumn(corpus_col, F.when(learned, TRAINING).otherwise(F.col(corpus_col)))
        losses = losses_of(rows, TRAINING).where(F.col(corpus_col) != TRAINING)
    else:
        losses = losses_of(df, train)
    settings = {"train": train, "held_out": float(held_out), **({"order": order} if order > 2 else {})}
    detail = F.to_json(F.struct(*[F.lit(value).alias(name) for name, value in settings.items()]))
    return _metric_rows(lm.perplexity(losses, corpus_col), ["perplexity"], corpus_col).withColumn("detail", detail)


def evaluate(
    df: DataFrame,
    mode: str = "both",
    reference: str = "real",
    synthetic: Sequence[str] = ("synthetic",),
    sample: int = -1,
    skip: Sequence[str] = (),
    text_col: str = "text",
    id_col: str = "doc_id",
    corpus_col: str = "corpus",
    embeddings: DataFrame | None = None,
    embedding_width: int | None = None,
    num_topics: int = 10,
    no_below: int = 5,
    seed=42,
    train: str | None = None,
    held_out: float = HELD_OUT,
    max_length: int | None = None,
    order: int = 2,
    learner: str = "online",
) -> DataFrame:
    """The report ``(corpus, metric, value, detail)``.

    ``mode`` picks the corpora. Lengths and words are measured on all rows; ``coherence`` and
    ``perplexity`` on an exact sample of ``sample`` rows per corpus (-1: all). Perplexity is under a
    model of the corpus ``train`` (by default the reference, in every mode), of which the share
    ``held_out`` is kept for measuring. The classifier and the distance of ``embeddings`` set each
    synthetic corpus against the reference, need both sides and run in mode 'both' only. ``skip``
    leaves measures out: 'stats', 'coherence', 'perplexity', 'classifier', 'distance'. ``order`` is that of
    :func:`perplexities`, ``learner`` that of :func:`topics.topic_coherence`.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    names = {"real": [reference], "synthetic": list(synthetic), "both": [reference, *synthetic]}[mode]
    train = train or reference
    texts = df.where(F.col(text_col).isNotNull())
    rows = texts.where(F.col(corpus_col).isin(*names))
    few = texts.where(F.col(corpus_col).isin(*names, train))
    if sample != -1 and set(COSTLY) - set(skip):
        sized = list(dict.fromkeys([*names, train]))
        sizes = df.sparkSession.createDataFrame([(n, sample) for n in sized], f"{corpus_col} string, size bigint")
        few = first_by_hash(few, sizes, seed, id_col, by=[corpus_col])
    parts: list[DataFrame] = []
    if "stats" not in skip:
        parts.append(lengths_and_words(rows, text_col, corpus_col))
    if "perplexity" not in skip:
        losses = perplexities(few, train, text_col, id_col, corpus_col, max_length, held_out=held_out, seed=seed, order=order)
        parts.append(losses.where(F.col("corpus").isin(*names)))
    if "coherence" not in skip:
        for name in names:
            one = topic_coherence(
                few.where(F.col(corpus_col) == name), text_col, id_col, None, num_topics, no_below,
                seed=seed, tokenizer="simple", corpus=name, learner=learner,
            )
            parts.append(
                one.select("corpus", F.lit("coherence").alias("metric"), F.col("coherence").alias("value"),
                           F.col("error").alias("detail"))
            )
    if mode == "both":
        if "classifier" not in skip:
            for name in synthetic:
                pair = rows.where(F.col(corpus_col).isin(reference, name))
                parts += _classifier_rows(pair, name, text_col, id_col, corpus_col, seed)
        if embeddings is not None and "distance" not in skip:
            if embedding_width is None:
                raise ValueError("embedding_width is needed with embeddings")
            distances = sliced_distances(embeddings, embedding_width, reference, synthetic, corpus_col=corpus_col)
            parts.append(
                sliced_wasserstein(distances, corpus_col).select(
                    F.col(corpus_col).alias("corpus"),
                    F.lit("wasserstein").alias("metric"),
                    F.col("mean_distance").alias("value"),
                    F.to_json("distances").alias("detail"),
                )
            )
    if not parts:
        raise ValueError("Every measure was skipped")
    return reduce(DataFrame.unionByName, parts)


def _classifier_rows(rows, synthetic, text_col, id_col, corpus_col, seed) -> list[DataFrame]:
    result = classify_texts(rows, synthetic, text_col, id_col, corpus_col, seed=seed)
    wide = result.scores.select(F.lit(synthetic).alias("corpus"), "accuracy", "macro_f1", "roc_auc")
    report = result.report.agg(
        F.to_json(F.sort_array(F.collect_list(F.struct("name", "precision", "recall", "f1", "support")))).alias("detail")
    )
    named = report.select(
        F.lit(synthetic).alias("corpus"), F.lit("class_report").alias("metric"),
        F.lit(None).cast("double").alias("value"), "detail",
    )
    return [_metric_rows(wide, ("accuracy", "macro_f1", "roc_auc"), "corpus"), named]


def length_table(
    df: DataFrame,
    text_col: str = "text",
    corpus_col: str = "corpus",
    clip: tuple[float, float] = (0.0, 4000.0),
    points: int = 200,
) -> tuple[DataFrame, DataFrame]:
    """Density curve and quantiles of text lengths in words, from one count per length."""
    counts = value_counts(df, T.word_count(text_col), corpus_col)
    return density_curve(counts, corpus_col, points, clip), length_quantiles(counts, corpus_col=corpus_col)

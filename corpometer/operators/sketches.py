"""Summaries that add up: stored for each batch of texts or vectors, merged without reading these again.

Quantiles: a KLL sketch of every projected value, whose ranks are off by a stated share at most. Types: a HyperLogLog
sketch. Frequent terms: Misra-Gries counts, which never exceed the true ones and fall short by a stated number at most.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpometer.operators.joins import attach
from corpometer.session import stored

KLL_K = 800
HLL_K = 14  # 2^14 registers
TERMS = 10_000


# --- quantiles and distances ---


def rank_error(k: int = KLL_K) -> float:
    """Share of the values by which a rank taken from a sketch may be off, with 99 % confidence."""
    return 2.296 / k**0.9723


def value_sketches(df: DataFrame, value: Column | str, by: Sequence[str], k: int = KLL_K) -> DataFrame:
    """``(*by, sketch, n, low, high)`` of the values of each group; nulls and non-finite values are left out.

    Values are summarised where they are read; a group costs a few KB for each task, however many values it has.
    """
    expr = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(*by, expr.alias("__x")).where(F.col("__x").isNotNull() & ~F.isnan("__x") & (F.abs("__x") < float("inf")))
    return rows.groupBy(*by).agg(
        F.kll_sketch_agg_double("__x", F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("n"), F.min("__x").alias("low"), F.max("__x").alias("high")
    )


def merged_sketches(sketches: DataFrame, by: Sequence[str], k: int = KLL_K) -> DataFrame:
    """The sketches of each group as one, from any number of stored batches."""
    return sketches.groupBy(*by).agg(
        F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
    )


def sketched_quantiles(sketches: DataFrame, shares: Sequence[float], by: Sequence[str]) -> DataFrame:
    """``(*by, share, value)``: the values below which the given shares of each group lie."""
    asked = F.array(*[F.lit(float(s)) for s in shares])
    found = F.kll_sketch_get_quantile_double("sketch", asked)
    pairs = F.zip_with(asked, found, lambda s, v: F.struct(s.alias("share"), v.alias("value")))
    return sketches.select(*by, F.inline(pairs))


def sketched_distances(
    sketches: DataFrame, reference: str, others: Sequence[str], by: Sequence[str] = ("direction",), corpus_col: str = "corpus", points: int = 1000, k: int = KLL_K
) -> DataFrame:
    """Wasserstein distance of each corpus to the reference from sketches: ``(*by, corpus, distance, error)``.

    It is the mean gap between the quantiles of both at ``points`` even shares. ``error`` bounds what it may be off:
    each distribution function by the rank error, and the shares between two points, over the range of the values.
    """
    shares = F.array(*[F.lit((i + 0.5) / points) for i in range(points)])
    rows = sketches.where(F.col(corpus_col).isin(reference, *others)).withColumn("__q", F.kll_sketch_get_quantile_double("sketch", shares))
    base = rows.where(F.col(corpus_col) == reference).select(*by, F.col("__q").alias("__r"), F.col("low").alias("__low"), F.col("high").alias("__high"))
    joined = attach(rows.where(F.col(corpus_col) != reference), stored(base, "reference-quantiles"), list(by), how="inner")
    gaps = F.aggregate(F.zip_with("__q", "__r", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, g: s + g) / points
    reach = F.greatest("high", "__high") - F.least("low", "__low")
    return joined.select(*by, corpus_col, gaps.alias("distance"), (reach * (2 * rank_error(k) + 1 / points)).alias("error"))


# --- vocabulary ---


def type_error(lg_k: int = HLL_K) -> float:
    """Share of the types by which an estimate may be off: three standard errors of a merged sketch."""
    return 3 * 1.04 / math.sqrt(2**lg_k)


def vocabulary_sketches(
    df: DataFrame, tokens: Column, by: Sequence[str] = ("corpus",), terms: int = TERMS, lg_k: int = HLL_K
) -> tuple[DataFrame, DataFrame]:
    """``(*by, types, n_tokens)`` with a sketch of the types, and ``(*by, token, n, short)`` of the frequent terms.

    Both are of a size that does not grow with the texts.
    """
    counts = df.select(*by, F.explode(tokens).alias("token")).groupBy(*by, "token").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts, "batch-counts")
    sketch = counts.groupBy(*by).agg(F.hll_sketch_agg("token", F.lit(lg_k)).alias("types"), F.sum("n").alias("n_tokens"))
    return sketch, reduced(counts.withColumn("short", F.lit(0).cast("bigint")), by, terms)


def reduced(counts: DataFrame, by: Sequence[str], terms: int = TERMS) -> DataFrame:
    """``counts`` (*by, token, n, short) cut down to at most ``terms`` for each group.

    The count of the first term left out is taken off every count, and those at zero go. What has been taken off
    in a group so far is ``short``: a true count is at most that much larger. The count is found from the number of
    terms of each count, so no task sorts a group.
    """
    sizes = counts.groupBy(*by, "n").agg(F.count(F.lit(1)).alias("__terms"))
    down = Window.partitionBy(*by).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    beyond = sizes.withColumn("__upto", F.sum("__terms").over(down)).where(F.col("__upto") > terms)
    cuts = beyond.groupBy(*by).agg(F.max("n").alias("__cut"))
    cut = F.coalesce("__cut", F.lit(0))
    rows = attach(counts, stored(cuts, "cuts"), list(by)).where(F.col("n") > cut)
    return rows.select(*by, "token", (F.col("n") - cut).alias("n"), (F.col("short") + cut).alias("short"))


def merged_vocabulary(
    sketches: DataFrame, frequent: DataFrame, by: Sequence[str] = ("corpus",), batch: str = "batch", terms: int = TERMS
) -> tuple[DataFrame, DataFrame]:
    """``(*by, n_types, n_tokens)`` and ``(*by, token, n, short)`` of all stored batches.

    What a batch has taken off may hide a term there altogether, so a group is short by the sum over its batches.
    """
    types = F.hll_sketch_estimate(F.hll_union_agg("types"))
    whole = sketches.groupBy(*by).agg(types.alias("n_types"), F.sum("n_tokens").alias("n_tokens"))
    taken = frequent.groupBy(*by, batch).agg(F.max("short").alias("short")).groupBy(*by).agg(F.sum("short").alias("short"))
    summed = frequent.groupBy(*by, "token").agg(F.sum("n").alias("n"))
    return whole, reduced(attach(summed, stored(taken, "taken"), list(by), how="inner"), by, terms)

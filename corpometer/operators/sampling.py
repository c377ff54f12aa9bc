"""Samples, splits, folds and batches that come out the same on every run."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpometer.operators.joins import attach_row
from corpometer.operators.ranks import first_by_hash, hash_rank, id_columns, position

SMALL_SAMPLES = 1_000_000  # (seed, id) rows that fit a broadcast


def _constant_sizes(df: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    if by:
        return df.select(*by).distinct().withColumn("size", F.lit(n).cast("bigint"))
    return df.sparkSession.range(1).select(F.lit(n).cast("bigint").alias("size"))


def sample_exact(df: DataFrame, n: int, seed=42, id_col: str | Sequence[str] = "doc_id") -> DataFrame:
    """Exactly ``n`` rows without replacement; all rows if there are fewer or ``n`` is -1."""
    if n == -1:
        return df
    return first_by_hash(df, _constant_sizes(df, (), n), seed, id_col)


def sample_unseeded(df: DataFrame, n: int, id_col: str | Sequence[str] = "doc_id") -> DataFrame:
    """Exactly ``n`` rows, other ones on every call; one call's result does not change."""
    return sample_exact(df, n, seed=random.SystemRandom().getrandbits(63), id_col=id_col)


def sample_per_label(
    df: DataFrame, label_col: str, n: int = 1000, seed=42, id_col: str | Sequence[str] = "doc_id"
) -> DataFrame:
    """At most ``n`` rows of each label."""
    return first_by_hash(df, _constant_sizes(df, [label_col], n), seed, id_col, by=[label_col])


def first_rows(df: DataFrame, n: int, order_col: str = "doc_id") -> DataFrame:
    """The first ``n`` rows in id order."""
    return df.orderBy(order_col).limit(n)


def seeded_samples(df: DataFrame, n: int, seeds: Sequence[int], id_col: str | Sequence[str] = "doc_id") -> DataFrame:
    """``(seed, id)`` of one exact sample per seed, drawn in one pass over the ids."""
    names = id_columns(id_col)
    ids = df.select(*names).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    sizes = df.sparkSession.createDataFrame([(s, n) for s in seeds], "seed int, size bigint")
    return first_by_hash(ids, sizes, F.col("seed"), id_col, by=["seed"]).select("seed", *names)


def repeated_sample_mean(
    stats_of, df: DataFrame, n: int, seeds: Sequence[int], id_col: str = "doc_id"
) -> DataFrame:
    """Mean over seeds of the statistics of one sample per seed.

    ``stats_of(rows, group_col)`` gives one row of numeric statistics per group.
    """
    picked = seeded_samples(df, n, seeds, id_col)
    # The samples hold at most n ids per seed; while that is little, the texts need not be shuffled.
    side = F.broadcast(picked) if n * len(seeds) <= SMALL_SAMPLES else picked
    per_seed = stats_of(df.join(side, id_columns(id_col)), "seed")
    names = [c for c in per_seed.columns if c != "seed"]
    return per_seed.agg(*[F.avg(c).alias(c) for c in names])


def balance_by_repeats(
    df: DataFrame,
    corpus_col: str = "corpus",
    large: str = "real",
    small: str = "synthetic",
    id_col: str = "doc_id",
    repeats: int | None = None,
) -> DataFrame:
    """Repeat the smaller corpus a whole number of times, cut at the size of the larger one.

    By default the number of repeats is ``size of large // size of small``. A ``copy`` column
    numbers the repeats from 1; copies are cut in the order of copy and id.
    """
    counts = df.groupBy(corpus_col).agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.agg(
        F.coalesce(F.sum(F.when(F.col(corpus_col) == large, F.col("n"))), F.lit(0)).alias("__large"),
        F.coalesce(F.sum(F.when(F.col(corpus_col) == small, F.col("n"))), F.lit(0)).alias("__small"),
    )
    times = F.lit(repeats) if repeats is not None else F.greatest(
        F.floor(F.col("__large") / F.col("__small")), F.lit(1)
    )
    minor = attach_row(df.where(F.col(corpus_col) == small), sizes)
    placed = position(minor, id_col, name="__place")
    copies = placed.withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("bigint"), times.cast("bigint")))
    ).where(
        (F.col("copy") - 1) * F.col("__small") + F.col("__place")
        <= F.greatest(F.col("__large"), F.col("__small"))
    )
    kept = df.where(F.col(corpus_col) != small).withColumn("copy", F.lit(1).cast("bigint"))
    return kept.unionByName(copies.select(*kept.columns))


def _share_sizes(df: DataFrame, by: Sequence[str], share: float) -> DataFrame:
    """Rows each group gives to a share of the whole, by largest remainder.

    The share is rounded up over all rows, and what it leaves is dealt out in proportion to group
    size; groups with the largest remainders give one more row.
    """
    number = "decimal(19,0)"
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).cast(number).alias("n")).withColumn("__one", F.lit(1))
    everyone = Window.partitionBy("__one")
    keep = (F.col("total") - F.ceil(F.col("total") * F.lit(share))).cast(number)
    places = (
        counts.withColumn("total", F.sum("n").over(everyone).cast(number))
        .withColumn("keep", keep)
        .withColumn("over", F.pmod(F.col("n") * F.col("keep"), F.col("total")).cast(number))
        .withColumn(
            "whole", ((F.col("n") * F.col("keep") - F.col("over")) / F.col("total")).cast(number)
        )
        .withColumn("spare", F.col("keep") - F.sum("whole").over(everyone))
        .withColumn("turn", F.row_number().over(everyone.orderBy(F.desc("over"), *by)))
    )
    given = F.col("n") - F.col("whole") - F.when(F.col("turn") <= F.col("spare"), 1).otherwise(0)
    return places.select(*by, given.cast("bigint").alias("size"))


def split(
    df: DataFrame,
    share: float,
    label_col: str | None = None,
    seed=42,
    id_col: str | Sequence[str] = "doc_id",
    name: str = "split",
) -> DataFrame:
    """Mark each row 'train' or 'test'; ``share`` of all rows, rounded up, are test rows.

    With ``label_col`` every label gives its own part (stratified).
    """
    by = [label_col] if label_col else []
    flagged = first_by_hash(df, _share_sizes(df, by, share), seed, id_col, by=by, flag="__test")
    return flagged.withColumn(name, F.when(F.col("__test"), "test").otherwise("train")).drop("__test")


def folds(
    df: DataFrame,
    k: int = 5,
    label_col: str | None = None,
    seed=42,
    id_col: str | Sequence[str] = "doc_id",
    name: str = "fold",
) -> DataFrame:
    """Number rows 0 to ``k - 1`` so that each label is spread evenly over the folds."""
    by = [label_col] if label_col else []
    ranked = hash_rank(df, seed, id_col, by=by, name="__rank")
    return ranked.withColumn(name, F.pmod(F.col("__rank") - 1, F.lit(k)).cast("int")).drop("__rank")


def batches(
    df: DataFrame, size: int, order_col: str = "doc_id", by: Sequence[str] = (), name: str = "batch_id"
) -> DataFrame:
    """Number fixed-size batches from 0 in id order."""
    placed = position(df, order_col, by=by, name="__place")
    return placed.withColumn(
        name, F.floor((F.col("__place") - 1) / size).cast("bigint")
    ).drop("__place")


def batch_count(rows: Column, size: int) -> Column:
    """Number of batches that ``rows`` rows fill."""
    return F.ceil(rows / size).cast("bigint")


def equal_shares(
    df: DataFrame, owners: Sequence[str], order_col: str = "doc_id", name: str = "person"
) -> DataFrame:
    """Give each owner a run of rows in id order, sizes differing by one row at most."""
    k = len(owners)
    placed = attach_row(position(df, order_col, name="__place"), df.agg(F.count(F.lit(1)).alias("__n")))
    base = F.floor(F.col("__n") / k)
    longer = F.col("__n") % k
    edge = longer * (base + 1)
    tile = F.when(
        F.col("__place") <= edge, F.floor((F.col("__place") - 1) / (base + 1)) + 1
    ).otherwise(longer + F.floor((F.col("__place") - 1 - edge) / F.greatest(base, F.lit(1))) + 1)
    names = F.array(*[F.lit(o) for o in owners])
    return placed.withColumn(name, F.element_at(names, tile.cast("int"))).select(*df.columns, name)


def stand_in_corpus(
    df: DataFrame,
    old: str,
    new: str,
    text_col: str = "text",
    order_col: str = "doc_id",
) -> DataFrame:
    """A stand-in synthetic corpus: the first half of the rows with one word replaced."""
    placed = attach_row(position(df, order_col, name="__place"), df.agg(F.count(F.lit(1)).alias("__n")))
    half = placed.where(F.col("__place") <= F.floor(F.col("__n") / 2))
    return half.withColumn(text_col, F.replace(F.col(text_col), F.lit(old), F.lit(new))).select(
        *df.columns
    )

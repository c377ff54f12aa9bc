"""Distances between the embedding clouds of corpora."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpometer.operators.joins import attach, attach_row
from corpometer.operators.ranks import running_sums
from corpometer.session import stored


def directions(width: int, n: int = 128, seed: int = 42) -> np.ndarray:
    """``n`` random unit vectors, one per row, the same for the same seed."""
    drawn = np.random.default_rng(seed).normal(size=(n, width))
    return drawn / (np.linalg.norm(drawn, axis=1, keepdims=True) + 1e-12)


def project(
    df: DataFrame,
    vectors: np.ndarray,
    vector_col: str = "embedding",
    keep: Sequence[str] = ("corpus",),
) -> DataFrame:
    """Dot product of every embedding with every direction: ``(*keep, direction, value)``.

    The directions travel with the task; each Arrow batch is one matrix product.
    """
    matrix = np.ascontiguousarray(vectors.T, dtype=np.float64)

    @F.pandas_udf("array<double>")
    def dots(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if len(batch) == 0:
                yield pd.Series([], dtype=object)
            else:
                stacked = np.stack(batch.to_numpy()).astype(np.float64)
                yield pd.Series(list(stacked @ matrix))

    dotted = df.where(F.col(vector_col).isNotNull()).select(*keep, dots(vector_col).alias("__d"))
    # The outer form keeps Spark from putting a filter, and with it a second call, before the explode.
    return dotted.select(*keep, F.posexplode_outer("__d").alias("direction", "value"))


def wasserstein_1d(
    df: DataFrame,
    reference: str,
    others: Sequence[str],
    value_col: str = "value",
    by: Sequence[str] = (),
    corpus_col: str = "corpus",
) -> DataFrame:
    """Exact 1-D Wasserstein distance of each corpus to the reference: ``(*by, corpus, distance)``.

    It is the area between the two distribution functions. Equal values are counted first, then
    running counts per corpus are taken along the value axis.
    """
    names = [reference, *others]
    rows = df.where(F.col(corpus_col).isin(*names))
    counted = stored(
        rows.groupBy(*by, F.col(value_col).cast("double").alias("__x")).agg(
            *[F.sum(F.when(F.col(corpus_col) == c, 1).otherwise(0)).alias(f"n{i}") for i, c in enumerate(names)]
        ),
        "value-counts",
    )
    sums = {f"c{i}": F.col(f"n{i}") for i in range(len(names))}
    run = running_sums(counted, "__x", sums, by=by, following="__next")
    gap = F.coalesce(F.col("__next") - F.col("__x"), F.lit(0.0))
    sized = counted.groupBy(*by).agg(*[F.sum(f"n{i}").alias(f"t{i}") for i in range(len(names))])
    shares = attach(run, sized, by, how="inner") if by else attach_row(run, sized)
    # A corpus without a value has no share, and no distance.
    share = [F.col(f"c{i}") / F.nullif(F.col(f"t{i}"), F.lit(0)) for i in range(len(names))]
    areas = [
        F.sum(F.abs(share[0] - share[i]) * gap).alias(f"d{i}")
        for i in range(1, len(names))
    ]
    wide = shares.groupBy(*by).agg(*areas)
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias(corpus_col), F.col(f"d{i}").alias("distance"))
            for i, c in enumerate(names)
            if i
        ]
    )
    return wide.select(*by, F.inline(pairs)).where(F.col("distance").isNotNull())


def sliced_distances(
    df: DataFrame,
    width: int,
    reference: str = "real",
    others: Sequence[str] = ("synthetic",),
    n_projections: int = 128,
    seed: int = 42,
    vector_col: str = "embedding",
    corpus_col: str = "corpus",
    resolution: float | None = None,
) -> DataFrame:
    """Wasserstein distance along each random direction: ``(direction, corpus, distance)``.

    Exact by default, at the price of sorting every projected value. With ``resolution`` values are
    first rounded to multiples of it: equal ones collapse before the shuffle, no row is left out,
    and a distance is off by no more than the resolution.
    """
    rows = df.where(F.col(corpus_col).isin(reference, *others))
    projected = project(rows, directions(width, n_projections, seed), vector_col, [corpus_col])
    if resolution is not None:
        projected = projected.withColumn("value", F.round(F.col("value") / resolution) * resolution)
    return wasserstein_1d(projected, reference, others, by=["direction"], corpus_col=corpus_col)


def sliced_wasserstein(distances: DataFrame, corpus_col: str = "corpus") -> DataFrame:
    """Mean over directions, and the list in direction order: ``(corpus, mean_distance, distances)``."""
    listed = F.sort_array(F.collect_list(F.struct("direction", "distance")))
    return distances.groupBy(corpus_col).agg(
        F.avg("distance").alias("mean_distance"),
        F.transform(listed, lambda p: p["distance"]).alias("distances"),
    )

"""Histogram and density tables, the data behind a distribution figure."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpometer.operators.joins import attach
from corpometer.session import stored

PAIR_CHUNK = 2048  # points whose distances to the grid are held at once


def value_counts(df: DataFrame, value: Column | str, corpus_col: str = "corpus") -> DataFrame:
    """``(corpus, value, n)``: equal values counted once, before anything else is done with them."""
    expr = F.col(value) if isinstance(value, str) else value
    # Nulls go by their count: a filter on the value would work the value out a second time.
    named = df.select(corpus_col, expr.cast("double").alias("value"))
    return named.groupBy(corpus_col, "value").agg(F.count("value").alias("n")).where("n > 0")


def histogram(counts: DataFrame, bins: int = 30, corpus_col: str = "corpus") -> DataFrame:
    """Equal-width bins of each corpus with its mean: ``(corpus, bin, low, high, n, mean)``.

    Bins run from the smallest to the largest value; the last one holds its upper edge. Bins
    without a value are not listed.
    """
    counts = stored(counts, "value-counts")
    span = counts.groupBy(corpus_col).agg(
        F.min("value").alias("__lo"),
        F.max("value").alias("__hi"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"),
    )
    width = (F.col("__hi") - F.col("__lo")) / F.lit(bins)
    place = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("__lo")) / width), F.lit(bins - 1)))
    placed = attach(counts, span, [corpus_col], how="inner").withColumn(
        "bin", F.coalesce(place, F.lit(0)).cast("bigint")
    )
    return placed.groupBy(corpus_col, "bin").agg(
        F.min(F.col("__lo") + F.col("bin") * width).alias("low"),
        F.min(F.col("__lo") + (F.col("bin") + 1) * width).alias("high"),
        F.sum("n").cast("bigint").alias("n"),
        F.min("mean").alias("mean"),
    )


def density_curve(
    counts: DataFrame,
    corpus_col: str = "corpus",
    points: int = 200,
    clip: tuple[float | None, float | None] = (None, None),
    bandwidth: float | None = None,
    cut: float = 3.0,
) -> DataFrame:
    """Gaussian density of each corpus on an even grid: ``(corpus, point, x, density)``.

    The bandwidth is the sample deviation times ``n ** (-1/5)`` unless given. The grid reaches
    ``cut`` bandwidths past the data and stops at the clip limits, which limit the grid only.
    """
    counts = stored(counts, "value-counts")
    n = F.sum("n")
    mean = F.sum(F.col("value") * F.col("n")) / n
    totals = counts.groupBy(corpus_col).agg(
        n.alias("__n"), mean.alias("__mean"), F.min("value").alias("__lo"), F.max("value").alias("__hi")
    )
    centred = attach(counts, totals, [corpus_col], how="inner")
    off = F.col("value") - F.col("__mean")
    spread = F.sqrt(F.sum(F.col("n") * off * off) / (F.first("__n") - 1))
    width = F.lit(float(bandwidth)) if bandwidth else spread * F.pow(F.first("__n"), F.lit(-0.2))
    shape = centred.groupBy(corpus_col).agg(
        F.first("__n").alias("__n"), F.first("__lo").alias("__lo"), F.first("__hi").alias("__hi"),
        width.alias("__h"),
    )
    low, high = F.col("__lo") - cut * F.col("__h"), F.col("__hi") + cut * F.col("__h")
    low = low if clip[0] is None else F.greatest(low, F.lit(float(clip[0])))
    high = high if clip[1] is None else F.least(high, F.lit(float(clip[1])))
    shape = shape.where(F.col("__h") > 0).select(
        corpus_col, "__n", "__h", low.alias("__from"), ((high - low) / (points - 1)).alias("__step")
    )
    grid = attach(counts, shape, [corpus_col], how="inner").withColumn(
        "point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    )
    x = F.col("__from") + F.col("point") * F.col("__step")
    z = (x - F.col("value")) / F.col("__h")
    scale = F.col("__n") * F.col("__h") * F.lit(float(np.sqrt(2 * np.pi)))
    return grid.groupBy(corpus_col, F.col("point").cast("bigint").alias("point")).agg(
        F.min(x).alias("x"), F.sum(F.col("n") * F.exp(-0.5 * z * z) / scale).alias("density")
    )


def _shapes(rows: DataFrame, corpus_col: str) -> DataFrame:
    """Number, range and covariance of the weighted points of each corpus, and the factor of the kernel's width."""
    w = F.col("__n")
    mean = rows.groupBy(corpus_col).agg(
        F.sum(w).alias("n"),
        (F.sum(w * F.col("__x")) / F.sum(w)).alias("mx"), (F.sum(w * F.col("__y")) / F.sum(w)).alias("my"),
        F.min("__x").alias("x0"), F.max("__x").alias("x1"),
        F.min("__y").alias("y0"), F.max("__y").alias("y1"),
    )
    dx, dy = F.col("__x") - F.col("mx"), F.col("__y") - F.col("my")
    one_less = F.nullif(F.first("n") - 1, F.lit(0))  # a lone point has no spread
    return (
        attach(rows, mean, [corpus_col], how="inner")
        .groupBy(corpus_col)
        .agg(
            *[F.first(c).alias(c) for c in ("n", "x0", "x1", "y0", "y1")],
            (F.sum(w * dx * dx) / one_less).alias("sxx"),
            (F.sum(w * dy * dy) / one_less).alias("syy"),
            (F.sum(w * dx * dy) / one_less).alias("sxy"),
        )
        .withColumn("f", F.pow("n", F.lit(-1.0 / 3.0)))
        .where(F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy") > 0)
    )


def _levels(summed: DataFrame, corpus_col: str, levels: int, threshold: float) -> DataFrame:
    order = Window.partitionBy(corpus_col).orderBy("density", "point_x", "point_y")
    mass = F.sum("density").over(order.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("density").over(Window.partitionBy(corpus_col))
    share = (mass - F.col("density")) / whole
    step = (1.0 - threshold) / (levels - 1)
    level = F.when(share >= threshold, F.floor((share - threshold) / F.lit(step)) + 1).otherwise(0)
    return summed.withColumn("level", level.cast("bigint"))


def density_grid(
    df: DataFrame,
    x: str = "x",
    y: str = "y",
    corpus_col: str = "corpus",
    points: int = 40,
    cut: float = 3.0,
    levels: int = 20,
    threshold: float = 0.05,
) -> DataFrame:
    """Two-way Gaussian density: ``(corpus, point_x, point_y, x, y, density, level)``.

    The kernel has the shape of the data's covariance, scaled by ``n ** (-1/6)``. ``level`` is the
    number of contour lines, evenly spaced in probability mass from ``threshold`` to 1, that
    enclose the point; 0 lies outside all of them.
    """
    rows = df.select(corpus_col, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    rows = stored(rows.groupBy(corpus_col, "__x", "__y").agg(F.count(F.lit(1)).alias("__n")), "points")
    shape = _shapes(rows, corpus_col)
    ready = attach(rows, shape, [corpus_col], how="inner")

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[object, tuple[np.ndarray, pd.Series]] = {}
        for frame in frames:
            for corpus, part in frame.groupby(corpus_col, sort=False):
                head = part.iloc[0]
                gx, gy = _axes(head, points, cut)
                total = sums[corpus][0] if corpus in sums else np.zeros((points, points))
                det = head.sxx * head.syy - head.sxy**2
                a, b, c = head.syy / det / head.f, head.sxx / det / head.f, head.sxy / det / head.f
                for start in range(0, len(part), PAIR_CHUNK):
                    piece = part.iloc[start : start + PAIR_CHUNK]
                    ux = gx[:, None] - piece["__x"].to_numpy()[None, :]
                    uy = gy[:, None] - piece["__y"].to_numpy()[None, :]
                    weight = piece["__n"].to_numpy(dtype=float)
                    for i in range(points):
                        q = a * ux[i] ** 2 + b * uy**2 - 2 * c * ux[i] * uy
                        total[i] += np.exp(-0.5 * q) @ weight
                sums[corpus] = (total, head)
        for corpus, (total, head) in sums.items():
            gx, gy = _axes(head, points, cut)
            det = head.sxx * head.syy - head.sxy**2
            scale = head.n * 2 * np.pi * np.sqrt(det) * head.f
            yield pd.DataFrame(
                {
                    corpus_col: corpus,
                    "point_x": np.repeat(np.arange(points), points),
                    "point_y": np.tile(np.arange(points), points),
                    "x": np.repeat(gx, points),
                    "y": np.tile(gy, points),
                    "density": (total / scale).ravel(),
                }
            )

    schema = f"{corpus_col} string, point_x bigint, point_y bigint, x double, y double, density double"
    summed = (
        ready.mapInPandas(partial, schema)
        .groupBy(corpus_col, "point_x", "point_y")
        .agg(F.first("x").alias("x"), F.first("y").alias("y"), F.sum("density").alias("density"))
    )
    return _levels(summed, corpus_col, levels, threshold)


def binned_density_grid(
    df: DataFrame,
    x: str = "x",
    y: str = "y",
    corpus_col: str = "corpus",
    points: int = 40,
    refine: int = 8,
    cut: float = 3.0,
    levels: int = 20,
    threshold: float = 0.05,
) -> DataFrame:
    """:func:`density_grid` at a cost per point that does not depend on the grid.

    A second grid has ``refine`` steps for each one of the first. Every point is dealt out to the four nodes around
    it, by nearness, and what the nodes get is added up where the points are read. One corpus is then at most
    ``(refine * (points - 1) + 1)`` squared numbers, whose convolution with the kernel takes two Fourier transforms.
    A density is off by at most :func:`binning_error` of the kernel's peak.
    """
    fine = refine * (points - 1) + 1
    rows = df.select(corpus_col, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).where("__x IS NOT NULL AND __y IS NOT NULL")
    shape = _shapes(rows.withColumn("__n", F.lit(1)), corpus_col)
    spread_x, spread_y = F.lit(float(cut)) * F.sqrt(F.col("sxx") * F.col("f")), F.lit(float(cut)) * F.sqrt(F.col("syy") * F.col("f"))
    shape = shape.withColumns({"lx": F.col("x0") - spread_x, "ly": F.col("y0") - spread_y})
    shape = shape.withColumns(
        {"dx": (F.col("x1") + spread_x - F.col("lx")) / (fine - 1), "dy": (F.col("y1") + spread_y - F.col("ly")) / (fine - 1)}
    )
    shape = stored(shape, "shapes")
    placed = attach(rows, shape, [corpus_col], how="inner").select(
        corpus_col, ((F.col("__x") - F.col("lx")) / F.col("dx")).alias("u"), ((F.col("__y") - F.col("ly")) / F.col("dy")).alias("v")
    )
    # The outermost node is reached by no point, as the grid is wider than the data.
    placed = placed.withColumns({"i": F.floor("u").cast("int"), "j": F.floor("v").cast("int")})
    right, up = F.col("u") - F.col("i"), F.col("v") - F.col("j")
    corner = [(0, 0, (1 - right) * (1 - up)), (1, 0, right * (1 - up)), (0, 1, (1 - right) * up), (1, 1, right * up)]
    dealt = placed.select(
        corpus_col, F.inline(F.array(*[F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j"), w.alias("mass")) for a, b, w in corner]))
    )
    nodes = dealt.groupBy(corpus_col, "i", "j").agg(F.sum("mass").alias("mass"))

    def convolved(frame: pd.DataFrame) -> pd.DataFrame:
        head = frame.iloc[0]
        mass = np.zeros((fine, fine))
        mass[frame["i"].to_numpy(), frame["j"].to_numpy()] = frame["mass"].to_numpy()
        det = head.sxx * head.syy - head.sxy**2
        a, b, c = head.syy / det / head.f, head.sxx / det / head.f, head.sxy / det / head.f
        far = np.arange(-(fine - 1), fine)
        kx, ky = (far * head.dx)[:, None], (far * head.dy)[None, :]
        kernel = np.exp(-0.5 * (a * kx**2 + b * ky**2 - 2 * c * kx * ky))
        size = 3 * fine - 2
        product = np.fft.rfft2(mass, (size, size)) * np.fft.rfft2(kernel, (size, size))
        whole = np.fft.irfft2(product, (size, size))[fine - 1 : 2 * fine - 1 : refine, fine - 1 : 2 * fine - 1 : refine]
        scale = head.n * 2 * np.pi * np.sqrt(det) * head.f
        at = np.arange(points) * refine
        return pd.DataFrame(
            {
                corpus_col: head[corpus_col],
                "point_x": np.repeat(np.arange(points), points),
                "point_y": np.tile(np.arange(points), points),
                "x": np.repeat(head.lx + at * head.dx, points),
                "y": np.tile(head.ly + at * head.dy, points),
                "density": (np.maximum(whole, 0) / scale).ravel(),
            }
        )

    schema = f"{corpus_col} string, point_x bigint, point_y bigint, x double, y double, density double"
    summed = attach(nodes, shape, [corpus_col], how="inner").groupBy(corpus_col).applyInPandas(convolved, schema)
    return _levels(summed, corpus_col, levels, threshold)


def binning_error(step_x: float, step_y: float, width_x: float, width_y: float) -> float:
    """Largest error of a binned density as a share of the kernel's peak, by the steps of the fine grid.

    The widths are the kernel's deviations along each axis with the other one held. Between nodes a value is taken
    on a straight line, which is off by an eighth of the squared step times the second derivative; that of the
    kernel is its peak over the squared width at most.
    """
    return (step_x**2 / width_x**2 + step_y**2 / width_y**2) / 8


def _axes(head, points: int, cut: float) -> tuple[np.ndarray, np.ndarray]:
    hx, hy = np.sqrt(head.sxx * head.f), np.sqrt(head.syy * head.f)
    return (
        np.linspace(head.x0 - cut * hx, head.x1 + cut * hx, points),
        np.linspace(head.y0 - cut * hy, head.y1 + cut * hy, points),
    )


def length_quantiles(
    counts: DataFrame, shares: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95), corpus_col: str = "corpus"
) -> DataFrame:
    """Exact quantiles of pre-counted values: ``(corpus, share, value)``."""
    items = F.array(*[F.lit(float(s)) for s in shares])
    packed = counts.groupBy(corpus_col).agg(
        F.percentile("value", list(map(float, shares)), F.col("n")).alias("__q")
    )
    return packed.select(corpus_col, F.inline(F.zip_with(items, "__q", lambda s, v: F.struct(s.alias("share"), v.alias("value")))))

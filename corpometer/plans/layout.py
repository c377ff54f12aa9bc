"""A two-dimensional view of embeddings that keeps neighbours together, by landmarks.

A bounded sample of the rows, drawn by a hash of their id, is laid out on the driver: landmarks that are near in the
full space pull each other in the plane, and others, drawn at random, push away. Every row, whatever their number, is
then placed in its task at the mean of the landmarks next to it, the nearer the heavier.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpometer.functions.keys import order_key
from corpometer.operators.joins import local_rows

LANDMARKS = 2_000
NEIGHBOURS = 15
PUSHES = 20


def landmark_rows(df: DataFrame, vector_col: str, id_col: str, most: int = LANDMARKS, seed: int = 42) -> np.ndarray:
    """Vectors of at most ``most`` rows, those first in hash order; equal vectors count once."""
    rows = df.where(F.col(vector_col).isNotNull()).select(order_key(seed, id_col).alias("key"), F.col(vector_col).cast("array<double>").alias("v"))
    first = rows.orderBy("key").limit(most)
    table = local_rows(first, most).sort_by("key")
    if not table.num_rows:
        return np.zeros((0, 1))
    found = np.array(table.column("v").to_pylist(), dtype=float)
    return found[np.sort(np.unique(found, axis=0, return_index=True)[1])]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(squares, 0))


def principal(x: np.ndarray) -> np.ndarray:
    """The first two principal components, of unit spread along the first."""
    centred = x - x.mean(0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes[:2] * np.sign(axes[:2][np.arange(min(2, len(axes))), np.abs(axes[:2]).argmax(1)])[:, None]
    found = centred @ axes.T
    found = np.pad(found, ((0, 0), (0, 2 - found.shape[1])))
    return found / max(found[:, 0].std(), 1e-12)


def laid_out(x: np.ndarray, neighbours: int = NEIGHBOURS, steps: int = 300, seed: int = 42) -> np.ndarray:
    """Places in the plane for the rows of ``x``: near rows pull, rows drawn at random push (negative sampling)."""
    n = len(x)
    if n <= 2:
        return principal(x) if n else np.zeros((0, 2))
    k = min(neighbours, n - 1)
    apart = distances(x, x)
    np.fill_diagonal(apart, np.inf)
    near = np.argpartition(apart, k - 1, axis=1)[:, :k]
    reach = np.take_along_axis(apart, near, 1)
    # Each row's own scale: its nearest neighbour pulls fully, farther ones less.
    low = reach.min(1, keepdims=True)
    pull = np.exp(-(reach - low) / np.maximum(reach.mean(1, keepdims=True) - low, 1e-12)).ravel()
    one, two = np.repeat(np.arange(n), k), near.ravel()
    y = principal(x) * 10
    rng = np.random.default_rng(seed)
    for step in range(steps):
        rate = 1 - step / steps
        gap = y[one] - y[two]
        square = (gap * gap).sum(1)
        force = (-2 * pull / (1 + square))[:, None] * gap
        move = np.zeros_like(y)
        np.add.at(move, one, force)
        np.add.at(move, two, -force)
        for _ in range(PUSHES):
            other = rng.integers(0, n, n)
            gap = y - y[other]
            square = (gap * gap).sum(1)
            move += np.clip((2 / ((0.001 + square) * (1 + square)))[:, None] * gap, -4, 4) * (other != np.arange(n))[:, None]
        y += rate * np.clip(move / k, -4, 4)
    return y


def placed(x: np.ndarray, marks: np.ndarray, places: np.ndarray, nearest: int = 3) -> np.ndarray:
    """Rows at the mean of their nearest landmarks, weighted by nearness; a landmark is at its own place."""
    k = min(nearest, len(marks))
    apart = distances(x, marks)
    near = np.argpartition(apart, k - 1, axis=1)[:, :k]
    reach = np.take_along_axis(apart, near, 1)
    weight = 1 / np.maximum(reach, 1e-9) ** 2
    weight /= weight.sum(1, keepdims=True)
    return (places[near] * weight[:, :, None]).sum(1)


def neighbour_view(
    df: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", keep: tuple[str, ...] = (), most: int = LANDMARKS, seed: int = 42
) -> DataFrame:
    """``(id, *keep, x, y)`` of every row with a vector. Vectors must be of one length; equal ones share a place."""
    rows = df.where(F.col(vector_col).isNotNull()).select(id_col, *keep, F.col(vector_col).cast("array<double>").alias("__v"))
    marks = landmark_rows(df, vector_col, id_col, most, seed)
    names = [id_col, *keep]
    places = laid_out(marks, seed=seed)
    schema = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("__v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                # A tile of distances at a time.
                found = np.concatenate([placed(x[i : i + 1024], marks, places) for i in range(0, len(x), 1024)])
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found[:, 0]), pa.array(found[:, 1])], names=[*names, "x", "y"])

    return rows.mapInArrow(run, f"{schema}, x double, y double")


def neighbour_recall(x: np.ndarray, y: np.ndarray, k: int = 10) -> float:
    """Share of each row's ``k`` nearest in ``x`` that are among its nearest in the plane ``y``; for tests and samples."""
    a, b = distances(x, x), distances(y, y)
    for m in (a, b):
        np.fill_diagonal(m, np.inf)
    first, second = (np.argsort(m, axis=1, kind="stable")[:, :k] for m in (a, b))
    return float(np.mean([len(set(p) & set(q)) / k for p, q in zip(first.tolist(), second.tolist(), strict=True)]))

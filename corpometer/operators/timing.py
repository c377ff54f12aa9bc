"""Generation times: totals per model, running totals and time left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpometer.operators.joins import attach
from corpometer.operators.ranks import running_sums

BASELINE_SECONDS = 8.0  # seconds per article of the model that speed is compared with


def generation_times(
    df: DataFrame,
    seconds_col: str = "elapsed_time",
    model_col: str = "model",
    baseline: float = BASELINE_SECONDS,
) -> DataFrame:
    """Articles, total and mean seconds, days for 100,000 articles, and speed against a baseline."""
    totals = df.groupBy(model_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(seconds_col).alias("total_seconds"),
        F.avg(seconds_col).alias("avg_seconds"),
    )
    return totals.withColumns(
        {
            "days_per_100k": F.col("avg_seconds") * 100_000 / 3600 / 24,
            "speed_factor": F.lit(float(baseline)) / F.col("avg_seconds"),
        }
    )


def running_time(
    df: DataFrame,
    seconds_col: str = "elapsed_time",
    order_col: str = "batch_id",
    by: Sequence[str] = ("model",),
    ties: Sequence[str] = (),
) -> DataFrame:
    """Add the seconds spent up to each row (``total_time``) and the rows done (``done``)."""
    sums = {"total_time": F.col(seconds_col), "done": F.lit(1).cast("bigint")}
    return running_sums(df, order_col, sums, by=by, ties=ties)


def time_left(
    df: DataFrame,
    seconds_col: str = "elapsed_time",
    order_col: str = "batch_id",
    by: Sequence[str] = ("model",),
    ties: Sequence[str] = (),
) -> DataFrame:
    """The ``running_time`` table with the rows still to do and the estimated seconds left.

    The estimate is the mean time of the rows done, times the rows that remain.
    """
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    left = F.col("__n") - F.col("done")
    run = running_time(df, seconds_col, order_col, by, ties)
    return (
        attach(run, n, by)
        .withColumns(
            {"remaining": left, "seconds_left": F.col("total_time") / F.col("done") * left}
        )
        .drop("__n")
    )

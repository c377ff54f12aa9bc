"""Joins that decide their strategy from a checked size, and groups made safe for joining."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 20_000
NO_KEY = "\u0000"


def group_key(*cols: str) -> Column:
    """One non-null text key for a list of columns, so null groups join like any other."""
    if not cols:
        return F.lit("all")
    return F.concat_ws(
        "\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit(NO_KEY)) for c in cols]
    )


def local_rows(small: DataFrame, max_rows: int = BROADCAST_ROWS) -> pa.Table | None:
    """The rows of ``small`` on the driver if there are at most ``max_rows``, else None.

    The read stops after ``max_rows + 1`` rows, so the driver never holds more than that.
    """
    head = small.limit(max_rows + 1).toArrow()
    return None if head.num_rows > max_rows else head


def bounded(small: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame | None:
    """``small`` as a local table if it has at most ``max_rows`` rows, else None; read as in :func:`local_rows`."""
    head = local_rows(small, max_rows)
    return None if head is None else small.sparkSession.createDataFrame(head, schema=small.schema)


def attach(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a per-group table to ``big``.

    The table is broadcast once it is known to hold at most ``max_rows`` rows, and ``big`` stays
    where it is. Above that both sides are shuffled and adaptive execution splits skewed keys.
    """
    on = list(on)
    local = bounded(small, max_rows)
    if local is None:
        return big.join(small, on, how)
    return big.join(F.broadcast(local), on, how)


def attach_row(big: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a table that is one row by construction (an ungrouped aggregate)."""
    values = row.select(F.struct(*row.columns).alias("row")).scalar()
    return big.withColumns({name: values[name] for name in row.columns})


def lookup(
    big: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    weight: str,
    how: str = "left",
    hot_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a table of any size, with one row per key, to rows whose keys are skewed.

    The ``hot_rows`` heaviest keys by ``weight`` are broadcast (the limit bounds their size), which
    settles most rows without moving them. Only rows with a key outside that list are shuffled to the rest of the table,
    and by construction none of those keys is heavy. ``table`` is read more than once, so it
    should be a stored one.
    """
    if how not in ("left", "inner"):
        raise ValueError("lookup joins are 'left' or 'inner'")
    on = list(on)
    if bounded(table.limit(hot_rows + 1).select(on[0]), hot_rows) is not None:
        return big.join(F.broadcast(table.drop(weight)), on, how)
    hot = table.orderBy(F.desc(weight), *on).limit(hot_rows).drop(weight)
    settled = big.join(F.broadcast(hot), on, "inner")
    rest = big.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return settled.unionByName(rest.join(table.drop(weight), on, how))

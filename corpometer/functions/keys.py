"""Repeatable keys: the same row gets the same order, id or random value on every run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed, *cols) -> Column:
    """Hash text that puts rows in a random-looking but fixed order for a seed."""
    return F.md5(F.concat_ws(":", F.lit(seed).cast("string") if not isinstance(seed, Column)
                             else seed.cast("string"), *[F.col(c).cast("string") if isinstance(c, str)
                                                         else c.cast("string") for c in cols]))


def row_id(*cols) -> Column:
    """Row id made from the row's own content."""
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]), 256)


def uniform(seed, *cols, low: float = 0.0, high: float = 1.0) -> Column:
    """Repeatable value in ``[low, high)`` drawn for each row."""
    unit = F.conv(F.substring(order_key(seed, *cols), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    return F.lit(float(low)) + F.lit(float(high) - float(low)) * unit


def pick(values, seed, *cols) -> Column:
    """Element of a list chosen for each row; an element listed twice has twice the chance."""
    items = F.array(*[F.lit(v) for v in values])
    place = F.floor(uniform(seed, *cols) * F.lit(len(values))).cast("int")
    return F.element_at(items, place + 1)

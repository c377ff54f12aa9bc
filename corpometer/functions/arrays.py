"""Token and token-id arrays: truncation, padding, masks, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTEXT_LIMIT = 2048  # tokens a model of the measured kind can take in
IGNORED_LABEL = -100  # label value that a loss leaves out


def truncate(tokens: Column, length: int | None, context: int | None = CONTEXT_LIMIT) -> Column:
    """The first ``length`` tokens, and of those no more than ``context``; None sets no limit."""
    limits = [int(n) for n in (length, context) if n is not None]
    return F.slice(tokens, 1, min(limits)) if limits else tokens


def pad(ids: Column, length, pad_id: int = 0) -> Column:
    """Cut or fill ``ids`` on the right to exactly ``length`` values (a number or a column)."""
    size = F.lit(length) if not isinstance(length, Column) else length
    size = size.cast("int")
    missing = F.greatest(size - F.size(ids), F.lit(0))
    return F.concat(F.slice(ids, F.lit(1), size), F.array_repeat(F.lit(pad_id).cast("bigint"), missing))


def attention_mask(ids: Column, length) -> Column:
    """1 for each kept id and 0 for each padded place."""
    size = F.lit(length) if not isinstance(length, Column) else length
    size = size.cast("int")
    kept = F.least(F.size(ids), size)
    return F.concat(
        F.array_repeat(F.lit(1).cast("bigint"), kept),
        F.array_repeat(F.lit(0).cast("bigint"), size - kept),
    )


def masked_labels(ids: Column, mask: Column, ignored: int = IGNORED_LABEL) -> Column:
    """A copy of ``ids`` with every padded place set to the ignored label."""
    return F.zip_with(ids, mask, lambda i, m: F.when(m == 0, F.lit(ignored).cast("bigint")).otherwise(i))


def join_longs(values: Column, separator: str = " ") -> Column:
    """Text form of a number array."""
    return F.array_join(values.cast("array<string>"), separator)

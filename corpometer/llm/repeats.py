"""Periodic runs of words: maximal stretches that repeat one sequence of words over and over.

An enhanced suffix array of the words finds them without a tree. Two suffixes that start ``d`` words apart and
agree on exactly ``d`` words are a square (a sequence twice in a row) whose period breaks behind it: a branching
square. They lie on the two sides of one place of the LCP array whose value is ``d``, so for each such place it is
enough to take the suffixes of its smaller side and to look up, in the inverse suffix array, whether the suffix ``d``
words further or nearer lies on the other side. Every run of two periods and more ends in one branching square of its
period; rotated to the left as long as the words agree, it gives the run's start.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpometer.llm.common import with_columns_from

MIN_LENGTH = 24
MIN_EXPONENT = 3
STRIDE = 1 << 20  # suffixes looked at together


def word_codes(words: list[bytes]) -> np.ndarray:
    """The words as numbers, equal for equal words."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))


def prefix_ranks(codes: np.ndarray) -> list[np.ndarray]:
    """Of every suffix the rank of its first 1, 2, 4, ... words, up to where all ranks differ.

    Suffixes that end earlier come first. The last array ranks whole suffixes.
    """
    n = len(codes)
    ranks = [codes.astype(np.int32)]
    span = 1
    while span < 2 * n:
        last = ranks[-1].astype(np.int64)
        after = np.zeros(n, dtype=np.int64)
        after[: max(n - span, 0)] = last[span:] + 1
        distinct, rank = np.unique(last * (n + 1) + after, return_inverse=True)
        ranks.append(rank.astype(np.int32))
        if len(distinct) == n:
            break
        span *= 2
    return ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """LCP array: at k > 0, on how many words the suffixes of ranks k - 1 and k agree; -1 at 0."""
    n = len(order)
    a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    agreed = np.zeros(max(n - 1, 0), dtype=np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        # Ranks of spans that run over the end differ, so equal ranks are equal words.
        open_ = np.flatnonzero(np.maximum(a, b) < n)
        same = open_[ranks[level][a[open_]] == ranks[level][b[open_]]]
        agreed[same] += 1 << level
        a[same] += 1 << level
        b[same] += 1 << level
    return np.concatenate([[-1], agreed])


def sides(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place k of the LCP array where its interval begins and ends, as ranks.

    The interval's suffixes of ranks below k are one side, the others the other; of places with the same value
    that share an interval, the first splits off what lies before it. Any two ranks are thus on two sides of
    one single place, which has the length of their common prefix.
    """
    n = len(lcp)
    values = lcp.tolist()
    low, high = [0] * n, [n] * n
    stack: list[int] = []
    for k, value in enumerate(values):
        while stack and values[stack[-1]] > value:
            high[stack.pop()] = k
        low[k] = stack[-1] if stack else 0
        stack.append(k)
    return np.array(low), np.array(high)


def branching_squares(order: np.ndarray, place: np.ndarray, lcp: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, periods) of all branching squares with a period of at most ``longest``, some at a time."""
    n = len(order)
    low, high = sides(lcp)
    at = np.flatnonzero((lcp > 0) & (lcp <= longest))
    left, right = at - low[at], high[at] - at
    begin, size = np.where(left <= right, low[at], at), np.minimum(left, right)
    other_low, other_high = np.where(left <= right, at, low[at]), np.where(left <= right, high[at], at)
    ends = np.cumsum(size)
    cuts = [0, *np.searchsorted(ends, np.arange(STRIDE, ends[-1], STRIDE)).tolist(), len(at)] if len(at) else []
    for first, last in zip(cuts, cuts[1:], strict=False):
        if first == last:
            continue
        part = slice(first, last)
        count = size[part]
        rank = np.repeat(begin[part] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        start, period = order[rank].astype(np.int64), np.repeat(lcp[at[part]], count)
        lo, hi = np.repeat(other_low[part], count), np.repeat(other_high[part], count)
        for partner, first_of_two in ((start + period, start), (start - period, start - period)):
            inside = (partner >= 0) & (partner < n)
            rank_of = place[np.where(inside, partner, 0)]
            hit = inside & (rank_of >= lo) & (rank_of < hi)
            yield first_of_two[hit], period[hit]


def rotated(codes: np.ndarray, start: int, period: int) -> int:
    """Where the square at ``start`` comes to, turned to the left for as long as the words agree."""
    step = 64
    while start > 0:
        low = max(0, start - step)
        differ = np.flatnonzero(codes[low:start] != codes[low + period : start + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        start, step = low, step * 2
    return 0


def runs_of(codes: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """All runs (start, length, smallest period) of numbered words, by start, then period.

    A run is a stretch that cannot be made longer with its period, of at least ``min_length`` words and
    ``min_exponent`` (2 or more) times its period.
    """
    if min_exponent < 2:
        raise ValueError("a run holds its period twice at least")
    n = len(codes)
    # A run agrees with itself, one period on, on all but one of its periods.
    agreed = min_length - min_length // min_exponent
    if n < max(min_length, min_exponent):
        return []
    ranks = prefix_ranks(codes)
    if 1 << (len(ranks) - 1) <= agreed:
        return []  # all suffixes differ within fewer words
    place = ranks[-1].astype(np.int64)
    order = np.empty(n, dtype=np.int64)
    order[place] = np.arange(n)
    lcp = common_prefixes(order, ranks)
    if int(lcp.max()) < agreed:
        return []
    table = np.stack(ranks)
    ends: dict[int, set[int]] = {}
    for starts, periods in branching_squares(order, place, lcp, n // min_exponent):
        end = starts + 2 * periods
        least = np.maximum(min_length, min_exponent * periods)
        fits = end >= least
        end, periods, least = end[fits], periods[fits], least[fits]
        span = least - periods
        level = np.minimum(np.frexp(span.astype(np.float64))[1] - 1, len(ranks) - 1)
        a = end - least
        wide = span < (2 << level)  # else all ranks of that level differ already, and so do the words
        same = wide & (table[level, a] == table[level, a + periods])
        same &= table[level, np.maximum(end - periods - (1 << level), 0)] == table[level, np.maximum(end - (1 << level), 0)]
        for e, p in zip(end[same].tolist(), periods[same].tolist(), strict=True):
            ends.setdefault(e, set()).add(p)
    found: list[tuple[int, int, int]] = []
    for end, own in ends.items():
        known: list[tuple[int, int]] = []
        for period in sorted(own):
            # The square of a repeated period belongs to the run of that period.
            if any(period % p == 0 and end - s >= 2 * period for s, p in known):
                continue
            start = rotated(codes, end - 2 * period, period)
            known.append((start, period))
            found.append((start, end - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds behind its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.cumsum(change[:-1]) == 0
    return [w for w, keep in zip(words, kept.tolist(), strict=True) if keep]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run that holds its period most often; of equal ones the first, then that of the smaller period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


ADDED = (
    "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, "
    "strongest struct<start:bigint,length:bigint,period:bigint>, collapsed string"
)


def with_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """``docs`` with n_words, all ``runs`` by start and period, the ``strongest`` one, and the ``collapsed`` text.

    Words are cut at ASCII white space. The collapsed text leaves out every word that a run holds behind its
    first period, and joins the others by single spaces. Texts are whole and judged one by one where they are, so
    equal rows get equal values and copies of any number need no group. Null, empty and short texts have no runs
    and a null ``strongest``. Columns of these four names are replaced, all others passed on; an empty table
    gives an empty one. Memory is some two hundred bytes a word of the longest text.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    keys = ("start", "length", "period")

    def score(texts: list[str | None]) -> list[pa.Array]:
        sizes, runs, best, left = [], [], [], []
        for value in texts:
            words = (value or "").encode("utf-8", "surrogatepass").split()
            found = runs_of(word_codes(words), min_length, min_exponent)
            top = strongest(found)
            sizes.append(len(words))
            runs.append([dict(zip(keys, r, strict=True)) for r in found])
            best.append(top and dict(zip(keys, top, strict=True)))
            left.append(b" ".join(without_repeats(words, found)).decode("utf-8", "surrogatepass"))
        return [pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(run)), pa.array(best, run), pa.array(left, pa.string())]

    return with_columns_from(docs, text, ADDED, score)

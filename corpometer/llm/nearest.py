"""Nearest vectors by a block matrix join of int8 tiles with error bounds."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERY_BLOCK = 4_096
ROW_BLOCK = 16_384
PAIRS = 32_768  # surviving pairs worked out together
TILE = 2_048
TOP = 5


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, vector) of rows with an id and a vector of finite numbers that is not null, empty or zero."""
    v = F.col("vector")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vector"))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & sound & F.exists(v, lambda x: x != 0))


class Quantised:
    """Rows of unit length as int8 with one scale each, and the exact length of what rounding left over."""

    def __init__(self, exact: np.ndarray):
        unit = exact / np.sqrt((exact * exact).sum(axis=1, keepdims=True))
        scale = np.abs(unit).max(axis=1, keepdims=True) / 127.0
        self.codes = np.rint(unit / scale).astype(np.int8)
        near = self.codes * scale
        self.scale = scale[:, 0]
        self.size = np.sqrt((near * near).sum(axis=1))
        self.rest = np.sqrt(((unit - near) ** 2).sum(axis=1)) + 1e-12


def even(rows: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near one: no bit of a cosine changes
    by it, and no square over- or underflows."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``, summed component by component."""
    dot, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for i in range(a.shape[1]):
        dot += a[:, i] * b[:, i]
        aa += a[:, i] * a[:, i]
        bb += b[:, i] * b[:, i]
    return np.clip(dot / np.sqrt(aa * bb), -1.0, 1.0)


def tile_products(q: Quantised, qs: slice, r: Quantised, rs: slice) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of a tile and the most that each may be off.

    Products of int8 codes are whole numbers under 2^24 for up to 1,040 components, so float32 holds
    them exactly and the matrix library can multiply them; wider rows are multiplied as float64.
    """
    kind = np.float32 if q.codes.shape[1] <= 1_040 else np.float64
    product = (q.codes[qs].astype(kind) @ r.codes[rs].astype(kind).T).astype(np.float64)
    product *= q.scale[qs][:, None]
    product *= r.scale[rs][None, :]
    # |x.y - x'.y'| <= |x'||y - y'| + |x - x'||y'| + |x - x'||y - y'|
    off = q.size[qs][:, None] * r.rest[rs][None, :] + q.rest[qs][:, None] * (r.size[rs] + r.rest[rs])[None, :]
    return product, off + 1e-9


def nearest_in_block(q_ids: np.ndarray, q_rows: np.ndarray, r_ids: np.ndarray, r_rows: np.ndarray, top: int) -> list[list[tuple[float, int]]]:
    """For each query its ``top`` nearest rows of the block as (score, id), itself left out.

    A tile's estimates less their bounds give a floor that the nearest found must reach; pairs whose
    estimate and bound together stay under it cannot be among them. The others are worked out in double
    precision and kept in a heap for each query, which raises the floor for the tiles that follow.
    """
    q_rows, r_rows = even(q_rows), even(r_rows)
    q, r = Quantised(q_rows), Quantised(r_rows)
    heaps: list[list[tuple[float, int]]] = [[] for _ in q_ids]
    floor = np.full(len(q_ids), -np.inf)
    for low in range(0, len(q_ids), TILE):
        qs = slice(low, min(low + TILE, len(q_ids)))
        for start in range(0, len(r_ids), TILE):
            rs = slice(start, min(start + TILE, len(r_ids)))
            estimate, off = tile_products(q, qs, r, rs)
            own = q_ids[qs][:, None] == r_ids[rs][None, :]
            estimate[own] = -np.inf
            if rs.stop - rs.start > top:
                sure = np.partition(estimate - off, -top, axis=1)[:, -top]
                floor[qs] = np.maximum(floor[qs], sure)
            at, to = np.nonzero((estimate + off >= floor[qs][:, None]) & ~own)
            # Of equal vectors all pairs of a tile may survive: their rows are gathered some at a time.
            for first in range(0, len(at), PAIRS):
                some, others = at[first : first + PAIRS], to[first : first + PAIRS]
                scores = cosines(q_rows[qs][some], r_rows[rs][others])
                for i, s, other in zip((some + low).tolist(), scores.tolist(), r_ids[rs][others].tolist(), strict=True):
                    heap = heaps[i]
                    if len(heap) < top:
                        heapq.heappush(heap, (s, -other))
                    elif (s, -other) > heap[0]:
                        heapq.heapreplace(heap, (s, -other))
            # Several copies of one id may be in the block, so the floor allows for equal scores.
            floor[qs] = [max(f, h[0][0] - 1e-12) if len(h) == top else f for f, h in zip(floor[qs], heaps[qs], strict=True)]
    return [[(s, -other) for s, other in sorted(h, reverse=True)] for h in heaps]


def _once(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows without repeats of an id with its vector; all rows of an id are in one block."""
    if len(np.unique(ids)) == len(ids):
        return ids, rows
    keep = sorted({(i, row.tobytes()): k for k, (i, row) in enumerate(zip(ids.tolist(), rows, strict=True))}.values())
    return ids[keep], rows[keep]


def nearest(
    queries: DataFrame,
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    top: int = TOP,
    query_block: int = QUERY_BLOCK,
    row_block: int = ROW_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest rows of ``vectors`` to each row of ``queries``.

    Nearness is the cosine in double precision, largest first, ties to the smaller id; a query's own id
    is no candidate. The result is exact: both tables are dealt into blocks of about ``query_block`` and
    ``row_block`` rows, every query block meets every row block in one task, where int8 tiles bound
    each cosine and only pairs that may be among the nearest are worked out. The best of each block are
    sorted by query and merged with a heap, one query at a time.

    Vectors that are null, empty or zero, or hold a null, NaN or infinity, take no part, nor do rows
    without an id. Vectors of different lengths never meet. Rows that share an id and a vector count
    once. Of rows that share an id alone each is a candidate and each is searched, and what they find
    is merged under the id. With fewer candidates than ``top`` all are returned; empty tables give an
    empty result.
    """
    q, r = usable(queries, vec_id, embedding), usable(vectors, vec_id, embedding)
    n_q = max(1, -(-q.count() // query_block))
    n_r = max(1, -(-r.count() // row_block))
    place = lambda n: F.pmod(F.xxhash64("id", F.lit(11)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    width = F.size("vector").alias("width")
    q = q.select("id", "vector", width, place(n_q).alias("qb"), each(n_r).alias("rb"))
    r = r.select("id", "vector", width, place(n_r).alias("rb"), each(n_q).alias("qb"))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, others, scores = [], [], []
        if left.num_rows and right.num_rows:
            w = left.column("width")[0].as_py()
            a, b = (t.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, w) for t in (left, right))
            (qi, a), (ri, b) = _once(left.column("id").to_numpy(), a), _once(right.column("id").to_numpy(), b)
            for i, found in zip(qi.tolist(), nearest_in_block(qi, a, ri, b, top), strict=True):
                ids += [i] * len(found)
                others += [other for _, other in found]
                scores += [s for s, _ in found]
        columns = [pa.array(ids, pa.int64()), pa.array(others, pa.int64()), pa.array(scores, pa.float64())]
        return pa.Table.from_arrays(columns, names=["query_id", "vec_id", "score"])

    found = q.groupBy("qb", "rb", "width").cogroup(r.groupBy("qb", "rb", "width")).applyInArrow(tile, "query_id long, vec_id long, score double")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            ranked = [(query, k, other, s) for query, heap in done for k, (s, other) in enumerate(((s, -o) for s, o in sorted(heap, reverse=True)), 1)]
            columns = [pa.array([x[i] for x in ranked], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.float64()))]
            return pa.RecordBatch.from_arrays(columns, names=["query_id", "rank", "vec_id", "score"])

        done: list[tuple[int, list[tuple[float, int]]]] = []
        for batch in batches:
            for query, other, s in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not done or done[-1][0] != query:
                    if len(done) > 10_000:
                        yield out()
                        done = []
                    done.append((query, []))
                heap = done[-1][1]
                if len(heap) < top:
                    heapq.heappush(heap, (s, -other))
                elif (s, -other) > heap[0]:
                    heapq.heapreplace(heap, (s, -other))
        yield out()

    together = found.repartition("query_id").sortWithinPartitions("query_id")
    return together.mapInArrow(merge, "query_id long, rank int, vec_id long, score double")

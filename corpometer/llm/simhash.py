"""SimHash near-duplicates found through deletion-variant signatures of two segments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpometer.llm.common import BROADCAST_ROWS, bounded, unused, with_columns_from
from corpometer.llm.components import connected
from corpometer.session import cleared, fresh_path, stored

DISTANCE = 3
SHINGLE = 3
SEED = 42
HALF = 32
CROWDED = 64


def fingerprint_of(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit fingerprint as a signed integer: a bit is set if over half the shingles' hashes have it."""
    hashes = shingle_hashes(words_of(text), shingle, seed)
    return _majority(hashes) if len(hashes) else 0


def shingle_hashes(words: list[bytes], shingle: int, seed: int = SEED) -> np.ndarray:
    """Hashes of the runs of ``shingle`` words in order; fewer words are one run."""
    if not words:
        return np.empty(0, dtype="<u8")
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts, ends[min(shingle, len(words)) - 1 :].tolist(), strict=False)
    return np.fromiter((digest(line[a:b], seed) for a, b in spans), dtype="<u8")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for low in range(0, len(hashes), 65536):
        part = hashes[low : low + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` and its fingerprints as long. Null and empty texts, and texts without words, get zero.

    Lower-cases A-Z, cuts words at ASCII white space, and takes whole texts of any length. A column of
    the docs that is called ``name`` is replaced.
    """
    return with_columns_from(docs, text, f"`{name}` long", lambda texts: [pa.array(map(fingerprint_of, texts), pa.int64())], 4_000_000)


def _signatures(rows: DataFrame, value: str, bits: int) -> DataFrame:
    """``rows`` with ``key`` and ``side`` for each signature of the two segments of ``value``, an SQL expression
    of ``2 * bits`` bits.

    A segment is indexed whole, and with each bit blanked out. The whole segment is met on side 2, a
    blanked one on the side that its bit has, so that two values which differ in that bit alone meet
    once, and equal values meet once. The key holds the segment's number, the bit, and the bits left.
    """
    places = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(2 * bits + 1))).alias("__at"))
    split = places.select(
        *rows.columns,
        F.expr(f"CASE WHEN __at <= {bits} THEN ({value}) & {(1 << bits) - 1}L ELSE shiftrightunsigned({value}, {bits}) & {(1 << bits) - 1}L END").alias("__part"),
        F.expr(f"CAST(__at > {bits} AS INT)").alias("__segment"),
        F.expr(f"__at % {bits + 1}").alias("__bit"),
    )
    whole = f"__bit = {bits}"
    return split.select(
        *rows.columns,
        F.expr(f"shiftleft(__segment * 64L + __bit, {bits}) | CASE WHEN {whole} THEN __part ELSE __part & ~shiftleft(1L, __bit) END").alias("key"),
        F.expr(f"CASE WHEN {whole} THEN 2 ELSE CAST(shiftright(__part, __bit) & 1L AS INT) END").alias("side"),
    )


def _distance() -> Column:
    return F.bit_count(F.col("a").bitwiseXOR(F.col("b")))


def _meet(keys: DataFrame, on: list[str], distance: int) -> DataFrame:
    """Pairs a, b that share a key on opposite sides, or on side 2, and are near enough."""
    left = keys.where("side <> 1").withColumnRenamed("fp", "a").withColumnRenamed("side", "sa")
    right = keys.where("side <> 0").withColumnRenamed("fp", "b").withColumnRenamed("side", "sb")
    near = (F.col("sa") + 1 == F.col("sb")) | ((F.col("sa") == 2) & (F.col("sb") == 2) & (F.col("a") < F.col("b")))
    # Spark sizes the keys like the fingerprints that they are exploded from, and would broadcast them.
    pairs = left.join(right.hint("merge"), on).where(near & (_distance() <= distance))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_pairs(values: DataFrame, distance: int = DISTANCE, crowded: int = CROWDED) -> DataFrame:
    """All pairs (a, b), a < b, of the distinct longs in column ``fp`` at ``distance`` bits (3) or fewer.

    Cut into two segments of 32 bits, two fingerprints with three differing bits have a segment that
    differs by one bit at most. Each segment is indexed whole and with every single bit blanked, and
    fingerprints that share such a signature are compared. Signatures that more than ``crowded``
    fingerprints share are worked out anew: the other segment, which still differs by three bits at
    most, is cut into two segments of 16 bits and indexed the same way under the shared signature.
    Such a finer signature leaves at most 2^17 fingerprints, however many rows there are.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments with one wildcard find up to three differing bits")
    keys = _signatures(values.select("fp"), "fp", HALF)
    heavy = stored(keys.groupBy("key").count().where(F.col("count") > crowded).select("key"), "crowded")
    local = bounded(heavy, BROADCAST_ROWS)
    few = heavy if local is None else F.broadcast(local)
    pairs = _meet(keys.join(few, "key", "left_anti"), ["key"], distance)
    crowd = keys.join(few, "key", "left_semi")
    # The segment that the key doesn't hold, cut once more; the bit above the place says which one it holds.
    other = f"CASE WHEN shiftright(top, {HALF + 6}) = 0 THEN shiftrightunsigned(fp, {HALF}) ELSE fp & {(1 << HALF) - 1}L END"
    crowd = crowd.select("fp", F.col("key").alias("top"), F.col("side").alias("outer"))
    finer = _signatures(crowd, other, HALF // 2)
    left = finer.where("side <> 1 and outer <> 1").select("top", "key", F.col("fp").alias("a"), F.col("side").alias("sa"), F.col("outer").alias("oa"))
    right = finer.where("side <> 0 and outer <> 0").select("top", "key", F.col("fp").alias("b"), F.col("side").alias("sb"), F.col("outer").alias("ob"))
    # Blanked outside: 0 meets 1 there, and any finer sides meet; whole outside: finer sides as above.
    crossed = finer.where("side = 1 and outer = 0").select("top", "key", F.col("fp").alias("a"), F.col("side").alias("sa"), F.col("outer").alias("oa"))
    opposite = finer.where("side = 0 and outer = 1").select("top", "key", F.col("fp").alias("b"), F.col("side").alias("sb"), F.col("outer").alias("ob"))
    whole = (F.col("oa") == 2) & (F.col("ob") == 2)
    inner = (F.col("sa") + 1 == F.col("sb")) | ((F.col("sa") == 2) & (F.col("sb") == 2) & (~whole | (F.col("a") < F.col("b"))))
    outer = (F.col("oa") + 1 == F.col("ob")) | whole
    near = _distance() <= distance
    more = left.join(right.hint("merge"), ["top", "key"]).where(inner & outer & near).select("a", "b")
    more = more.union(crossed.join(opposite.hint("merge"), ["top", "key"]).where(near).select("a", "b"))
    more = more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.union(more).distinct()


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (long) and component_id.

    Rows with equal fingerprints, and with fingerprints at ``distance`` bits or fewer, are linked;
    component_id is the smallest id that can be reached, null where all of them are null. Rows without
    words all have fingerprint zero and are linked like any other. Equal rows each keep their own row.
    An empty table gives an empty result.
    """
    rows = stored(fingerprints(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))).drop("text"), "fingerprints")
    return _with_components(rows, distance).drop("root")


def _with_components(rows: DataFrame, distance: int) -> DataFrame:
    """Components of stored rows (doc_id, fingerprint) whose fingerprints are linked at ``distance`` bits or fewer."""
    values = stored(rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("low")), "values")
    roots = connected(near_pairs(values.select("fp"), distance))
    linked = values.join(roots.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    named = stored(linked.join(lows, "root").select(F.col("fp").alias("fingerprint"), "root", "component_id"), "components")
    # Copies share a fingerprint: adaptive execution splits the partition of a crowded one.
    return rows.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id", "root")


def one_of_each(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each component of :func:`components`: of those with its smallest id, one.

    A component whose ids are all null keeps one row for each fingerprint. Rows that share an id but not
    a component are judged apart; of equal rows one stays. Null and empty texts are one component, as
    their fingerprints are zero. The columns and their order stay, whatever their names; an empty table
    gives an empty one.
    """
    print_ = unused("fingerprint", docs.columns)
    marked = stored(fingerprints(docs, "text", print_), "marked")
    keep_path = fresh_path(docs.sparkSession, "keep")
    with cleared(docs.sparkSession):
        rows = marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(print_).alias("fingerprint"))
        groups = _with_components(rows, distance).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        # Of the fingerprints that hold the smallest id, one stays; in most components there is but one.
        named = groups.where("component_id is not null").groupBy("root", F.col("component_id").alias("k_id")).agg(F.min("fingerprint").alias("k_fp"))
        unnamed = groups.where("component_id is null").select(F.col("component_id").alias("k_id"), F.col("fingerprint").alias("k_fp"))
        named.select("k_id", "k_fp").union(unnamed.distinct()).write.parquet(keep_path)
        repeated = not rows.groupBy("doc_id", "fingerprint").count().where("count > 1").isEmpty()
    keep = docs.sparkSession.read.parquet(keep_path).alias("keep")
    # The fingerprint alone is the key, a long; ids are compared behind it, which keeps a hash table small.
    own, kept_id = F.col("marked.doc_id").cast("long"), F.col("keep.k_id")
    same = (F.col(f"marked.`{print_}`") == F.col("keep.k_fp")) & ((own == kept_id) | (own.isNull() & kept_id.isNull()))
    kept = marked.alias("marked").join(keep, same, "left_semi")
    # Where no row comes twice, the kept texts are not moved once more to look for repeats.
    if repeated:
        kept = kept.dropDuplicates(["doc_id", print_])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])

"""Exact duplicates: two passes of Bloom filtering leave only rows that may have a copy to be shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpometer.llm.common import unused
from corpometer.operators.joins import attach, lookup
from corpometer.session import stored

BITS_PER_ROW = 16
BITMAP = 32_768  # bits of a bitmap that ``bitmap_construct_agg`` makes
BROADCAST_BITMAPS = 16_384  # of 4 KB each: 64 MB


def normal_text(text: Column) -> Column:
    """``text`` with one space for each run of ASCII white space; null counts as empty."""
    # A lone space is its own replacement, so only the other runs need to be matched.
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(normal_text(text), 256))


def _places(key: str, bitmaps: int) -> dict[str, Column]:
    """Of each digest: its bitmap, and one bit in either half of it."""
    bits = F.xxhash64(F.col(key), F.lit(1))
    return {
        "bitmap": F.pmod(F.xxhash64(F.col(key)), F.lit(bitmaps)),
        "low": bits.bitwiseAND(BITMAP // 2 - 1).cast("int"),
        "high": (F.shiftrightunsigned(bits, 32).bitwiseAND(BITMAP // 2 - 1) + BITMAP // 2).cast("int"),
    }


def repeat_filter(digests: DataFrame, key: str, bitmaps: int) -> DataFrame:
    """First pass: (bitmap, bits) of a Bloom filter of the digests that may be there more than once.

    Every row has one bit in each half of its bitmap. A bit is set if two rows or more have it, so both bits
    of a repeated digest are set. Bits are counted where rows are read, copies and all, before anything moves.
    """
    places = digests.select(*[value.alias(name) for name, value in _places(key, bitmaps).items()])
    hits = places.select("bitmap", F.explode(F.array("low", "high")).alias("bit")).groupBy("bitmap", "bit").count()
    return hits.where("count > 1").groupBy("bitmap").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _is_set(bits: str, at: str) -> Column:
    byte = f"CAST(conv(hex(substring({bits}, {at} DIV 8 + 1, 1)), 16, 10) AS INT)"
    return F.expr(f"shiftright({byte}, {at} % 8) & 1 = 1")


def _marked(rows: DataFrame, found: DataFrame, key: str, bitmaps: int, flag: str) -> DataFrame:
    """Second pass: ``rows`` and whether the filter holds both bits of their digest.

    Up to 64 MB of bitmaps are broadcast and no row moves. A filter beyond that is joined by its bitmap number.
    """
    names = {n: unused(f"bloom_{n}", rows.columns) for n in ("bitmap", "bits", "low", "high")}
    placed = rows.withColumns({names[n]: value for n, value in _places(key, bitmaps).items()})
    table = found.select(F.col("bitmap").alias(names["bitmap"]), F.col("bits").alias(names["bits"]))
    joined = attach(placed, table, [names["bitmap"]], max_rows=BROADCAST_BITMAPS)
    both = _is_set(names["bits"], names["low"]) & _is_set(names["bits"], names["high"])
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce(both, F.lit(False)).alias(flag))


def _bitmaps(rows: int, bits_per_row: int) -> int:
    return max(1, -(-rows * bits_per_row // BITMAP))


def _first(doc_id: str, *more: str) -> Column:
    """The smallest id of a group; null only where all ids are."""
    return F.min(F.struct(F.col(doc_id).isNull().alias("absent"), F.col(doc_id).alias("id"), *more))


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits_per_row: int = BITS_PER_ROW) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are once each run of ASCII white space is one space; null counts as empty.
    Of equal texts the row with the smallest id stays and gives keep_id; null ids come last, and of rows
    that share text and id one stays. Other columns are not read, and an empty table gives an empty result.

    Each text is read once, for its digest of 32 bytes. Rows whose digest the filter does not hold, which are
    all but about one in seventy of those without a copy, pass straight through. The rest are grouped on their
    digests, partly where they are, and the groups found are given back by :func:`lookup`, which does not move
    the rows of the largest ones.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), digest(F.col(text)).alias("digest"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
    bitmaps = _bitmaps(rows.count(), bits_per_row)
    found = stored(repeat_filter(rows, "digest", bitmaps), "filter")
    marked = _marked(rows, found, "digest", bitmaps, "maybe")
    alone = marked.where("NOT maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest"
    )
    suspects = stored(marked.where("maybe").drop("maybe"), "suspects")
    groups = suspects.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), _first("doc_id", "row").alias("first"))
    groups = groups.where("group_size > 1").select("digest", "group_size", F.col("group_size").alias("weight"), "first")
    judged = lookup(suspects, stored(groups, "groups"), ["digest"], "weight")
    repeated = judged.select(
        "doc_id",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("row") == F.col("first.row"), F.lit(True)).alias("kept"),
        "digest",
    )
    return alone.unionByName(repeated).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits_per_row: int = BITS_PER_ROW) -> DataFrame:
    """``docs`` with the one row of each group of equal texts that :func:`copies` keeps, all columns as they are.

    Rows that the filter clears are passed on where they lie. Of the others only those that hold the smallest
    id of their group go on, so a large group of copies never moves.
    """
    names: dict[str, str] = {}
    for name in ("digest", "maybe", "weight", "first", "found"):
        names[name] = unused(name, [*docs.columns, *names.values()])
    key, flag, weight, first, known = names.values()
    digests = stored(docs.select(digest(F.col(text)).alias("digest"), F.col(doc_id).alias("doc_id")), "digests")
    bitmaps = _bitmaps(digests.count(), bits_per_row)
    found = stored(repeat_filter(digests, "digest", bitmaps), "filter")
    suspects = _marked(digests, found, "digest", bitmaps, "maybe").where("maybe")
    groups = suspects.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), _first("doc_id").alias("first")).where("n > 1")
    groups = groups.select(F.col("digest").alias(key), F.col("n").alias(weight), F.col("first.id").alias(first), F.lit(True).alias(known))
    marked = _marked(docs.withColumn(key, digest(F.col(text))), found, key, bitmaps, flag)
    held = lookup(marked.where(F.col(flag)), stored(groups, "groups"), [key], weight)
    alone = marked.where(~F.col(flag))
    single = held.where(F.col(known).isNull())
    smallest = held.where(F.col(known) & F.col(f"`{doc_id}`").eqNullSafe(F.col(first))).dropDuplicates([key])
    own = [F.col(f"`{c}`") for c in docs.columns]
    return alone.select(*own).unionByName(single.select(*own)).unionByName(smallest.select(*own))

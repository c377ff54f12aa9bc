"""Benchmark decontamination: size-partitioned MinHash containment search, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpometer.llm.common import bounded, unused
from corpometer.session import stored

SHINGLE = 5
CONTAINMENT = 0.8
INDEX_ROWS = 200_000
NOT_WORD = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits, so case and punctuation do not hide a copy."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def shingles(df: DataFrame, text: str, size: int = SHINGLE) -> DataFrame:
    """One row per place: the columns of ``df`` but the text, words w0.. and their 64-bit hash."""
    words = df.select(*[c for c in df.columns if c != text], words_of(F.col(text)).alias("ws")).where(F.size("ws") >= size)
    names = [f"w{i}" for i in range(size)]
    shifted = [F.slice("ws", i + 1, F.size("ws") - (size - 1)).alias(n) for i, n in enumerate(names)]
    placed = words.select(*[c for c in words.columns if c != "ws"], F.inline(F.arrays_zip(*shifted)))
    return placed.withColumn("hash", F.xxhash64(*names))


def minhash_index(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = SHINGLE,
                  containment: float = CONTAINMENT) -> DataFrame:
    """The distinct shingles of every item with its size, its size partition and its MinHash sketch.

    Columns: item_id, n_shingles, partition, sketched, hash and the words. Items fall into partitions
    by the number of shingles, doubling from one to the next. The sketch of an item holds its smallest
    hashes, as many as the largest item of the partition may miss, and one more: of an item that a
    document contains to the share asked for, at least one sketched shingle is in the document, so the
    search loses nothing. A partition's shingles are ranked within the item, which is short.
    """
    names = [f"w{i}" for i in range(size)]
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("item_id is not null")
    distinct = shingles(items, "text", size).select("item_id", "hash", *names).distinct()
    sizes = distinct.groupBy("item_id").agg(F.count("*").alias("n_shingles"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("hash", *names))
    top = F.pow(F.lit(2.0), F.col("partition") + 1) - 1
    misses = F.floor((1 - F.lit(containment)) * top + 1e-9)
    return (
        distinct.withColumn("rank", rank)
        .join(sizes, "item_id")
        .withColumn("partition", F.floor(F.log2("n_shingles")).cast("int"))
        .withColumn("sketched", F.col("rank") <= misses + 1)
        .select("item_id", "n_shingles", "partition", "sketched", "hash", *names)
    )


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE,
    containment: float = CONTAINMENT,
    index_rows: int = INDEX_ROWS,
) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) of items found in documents.

    A row says that the document holds at least the share ``containment`` (0.8) of the item's distinct
    shingles of ``size`` (5) words. First every hash of a document, whole texts of any length, is looked
    up among the sketches of the items' size partitions; documents with fewer places than such an item
    needs are passed over. Then the found documents are read again and the shingles of found pairs are
    counted by their words, not their hashes.

    Null and empty texts, texts and items of fewer than ``size`` words, and items without an id have no
    shingles and give no row. Rows that share an id, a null one too, count as one document; rows that
    share an item id count as one item. Empty tables give an empty result.

    Of the benchmark, an index of up to ``index_rows`` shingles is broadcast, a longer one is joined by
    shuffles. Documents found are broadcast as ids under the same bound; beyond it all are read again.
    """
    names = [f"w{i}" for i in range(size)]
    index = stored(minhash_index(benchmark, "item_id", "text", size, containment), "benchmark-index")
    local = bounded(index, index_rows)
    held = index if local is None else local
    hint = (lambda df: df) if local is None else F.broadcast
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sketches = held.where("sketched").groupBy("hash", *names).agg(
        F.collect_set(F.struct("item_id", "n_shingles")).alias("items")
    )
    places = shingles(texts.withColumn("places", F.size(words_of(F.col("text"))) - (size - 1)), "text", size)
    found = places.join(hint(sketches.select("hash", "items")), "hash").select("doc_id", "places", F.inline("items"))
    enough = F.ceil(F.lit(containment) * F.col("n_shingles") - 1e-9)
    pairs = found.groupBy("doc_id", "item_id", "n_shingles").agg(F.sum("places").alias("places"))
    pairs = stored(pairs.where(F.col("places") >= enough).drop("places"), "contained-candidates")
    ids = bounded(pairs.select(F.col("doc_id").alias("found_id")).distinct(), index_rows)
    if ids is not None:
        texts = texts.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("found_id")), "left_semi")
    hits = shingles(texts, "text", size).join(hint(held.select("hash", "item_id", *names)), ["hash", *names])
    counted = hits.select("doc_id", "item_id", *names).distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("n_found"))
    pairs = pairs.select(F.col("doc_id").alias("p_doc"), F.col("item_id").alias("p_item"), "n_shingles")
    on = F.col("doc_id").eqNullSafe(F.col("p_doc")) & (F.col("item_id") == F.col("p_item"))
    return (
        counted.join(pairs, on)
        .where(F.col("n_found") >= enough)
        .select("doc_id", "item_id", "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment"))
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without those that hold a benchmark item; ``options`` as in :func:`contaminated`.

    Columns stay as they are, whatever their names; rows that share the id of a document go with it.
    """
    bad_id = unused("bad_id", docs.columns)
    bad = stored(contaminated(docs, benchmark, **options).select(F.col("doc_id").alias(bad_id)).distinct(), "contaminated")
    local = bounded(bad)
    return docs.join(bad if local is None else F.broadcast(local), F.col("doc_id").eqNullSafe(F.col(bad_id)), "left_anti")

"""Dictionaries, bags of words and TF-IDF weights as tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpometer.operators.joins import BROADCAST_ROWS, attach_row, local_rows, lookup
from corpometer.operators.ranks import hash_rank
from corpometer.session import stored

HOT_TOKENS = 500_000  # tokens that travel with the tasks, some 10 MB


def dictionary(frequencies: DataFrame, seed=0) -> DataFrame:
    """Give each distinct token an id from 0, without gaps: ``(token, token_id, cf)``.

    Ids follow a hash order of the tokens, which spreads the numbering over all tasks. The table
    is stored, since every encoding of texts reads it.
    """
    counts = stored(frequencies.select("token", "cf"), "token-counts")
    ranked = hash_rank(counts, seed, id_col="token", name="__rank")
    return stored(ranked.select("token", (F.col("__rank") - 1).alias("token_id"), "cf"), "dictionary")


def token_rows(df: DataFrame, tokens: Column, id_col: str = "doc_id") -> DataFrame:
    """``(id, place, token)``, places from 0."""
    return df.select(id_col, F.posexplode(tokens).alias("place", "token"))


def encode(
    df: DataFrame, tokens: Column, ids: DataFrame, id_col: str = "doc_id", hot_tokens: int = HOT_TOKENS
) -> DataFrame:
    """``(id, input_ids)``: known tokens as ids, in the order of the text.

    ``ids`` is a stored ``(token, token_id, cf)``. Documents without a known token get an empty array. The
    ``hot_tokens`` heaviest tokens travel with the tasks and are looked up where a text is read, a batch of texts
    at once. Only tokens beyond these move, with their places, and are merged into their text's ids.
    """
    table, whole = _heaviest(ids, hot_tokens)
    coded = df.select(id_col, tokens.alias("__t")).mapInArrow(
        _lookup_places(table, id_col, whole), f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, known array<bigint>, rare array<struct<place:int,token:string>>"
    )
    if whole:
        return coded.select(id_col, F.filter("known", lambda x: x.isNotNull()).alias("input_ids"))
    coded = stored(coded.withColumn("__row", F.monotonically_increasing_id()), "coded")
    found = coded.select("__row", F.inline("rare")).join(ids.select("token", "token_id"), "token")
    found = found.groupBy("__row").agg(F.collect_list(F.struct("place", "token_id")).alias("found"))
    placed = F.transform("known", lambda x, i: F.struct(i.alias("place"), x.alias("token_id")))
    hot = F.filter(placed, lambda p: p["token_id"].isNotNull())
    merged = F.sort_array(F.concat(hot, F.coalesce("found", F.array().cast("array<struct<place:int,token_id:bigint>>"))))
    return coded.join(found, "__row", "left").select(id_col, F.transform(merged, lambda p: p["token_id"]).alias("input_ids"))


def _heaviest(ids: DataFrame, most: int) -> tuple[pa.Table, bool]:
    """The heaviest tokens and their ids on the driver, at most ``most``, and whether these are all.

    Tokens of one weight stay together. The least weight taken is found from the number of tokens of each weight,
    of which there are few, so no task sorts the tokens.
    """
    table = local_rows(ids.select("token", "token_id"), most)
    if table is not None:
        return table, True
    sizes = ids.groupBy("cf").agg(F.count(F.lit(1)).alias("__n"))
    down = Window.orderBy(F.desc("cf")).rowsBetween(Window.unboundedPreceding, 0)
    fits = sizes.withColumn("__upto", F.sum("__n").over(down)).where(F.col("__upto") <= most)
    return local_rows(ids.where(F.col("cf") >= fits.agg(F.min("cf")).scalar()).select("token", "token_id"), most), False


def _flat(batch: pa.RecordBatch, table: pa.Table) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Where each text's tokens begin, all tokens, and their ids, null where the table has none."""
    lists = batch.column("__t")
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    names = table.column("token").combine_chunks()
    numbers = table.column("token_id").combine_chunks()
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), flat, numbers.take(pc.index_in(flat, value_set=names.cast(flat.type)))


def _lookup_places(table: pa.Table, id_col: str, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, flat, found = _flat(batch, table)
            known = pa.ListArray.from_arrays(pa.array(starts), found)
            missing = np.zeros(0, np.int64) if whole else np.flatnonzero(pc.is_null(found).to_numpy(zero_copy_only=False))
            row = np.searchsorted(starts, missing, side="right") - 1
            rare = pa.StructArray.from_arrays(
                [pa.array((missing - starts[row]).astype(np.int32)), flat.take(pa.array(missing)).cast(pa.string())], names=["place", "token"]
            )
            ends = np.searchsorted(missing, starts).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), known, pa.ListArray.from_arrays(pa.array(ends), rare)], names=[id_col, "known", "rare"]
            )

    return run


def term_counts(df: DataFrame, tokens: Column, id_col: str = "doc_id") -> DataFrame:
    """``(id, token, n)``; a document's tokens are added up where the document is read."""
    return (
        df.select(id_col, F.explode(tokens).alias("token"))
        .groupBy(id_col, "token")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def frequencies_of(counts: DataFrame) -> DataFrame:
    """``(token, df, cf)`` of stored term counts: documents with the token, and how often it occurs."""
    return counts.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("cf"))


def bags_of_words(
    df: DataFrame, tokens: Column, ids: DataFrame, id_col: str = "doc_id", hot_tokens: int = HOT_TOKENS
) -> DataFrame:
    """``(id, bag)`` with ``bag`` an array of ``(token_id, n)`` in id order; documents without a known token are left out.

    Tokens are looked up and counted where a text is read, as in :func:`encode`; one row per text moves at most.
    Texts that share an id have a bag each.
    """
    ids_of = encode(df, tokens, ids, id_col, hot_tokens)
    kind = ids_of.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("input_ids")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((flat, row))
            fresh = np.concatenate([[True], (np.diff(flat[order]) != 0) | (np.diff(row[order]) != 0)]) if len(flat) else np.zeros(0, bool)
            first = np.flatnonzero(fresh)
            n = np.diff(np.concatenate([first, [len(flat)]]))
            bag = pa.StructArray.from_arrays([pa.array(flat[order][first]), pa.array(n)], names=["token_id", "n"])
            starts = np.concatenate([[0], np.cumsum(np.bincount(row[order][first], minlength=len(sizes)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.ListArray.from_arrays(pa.array(starts), bag)], names=[id_col, "bag"])

    return ids_of.mapInArrow(run, f"`{id_col}` {kind}, bag array<struct<token_id:bigint,n:bigint>>").where(F.size("bag") > 0)


def bags_of_counts(counts: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """:func:`bags_of_words` of stored term counts, which a dictionary may have been made from."""
    coded = lookup(counts, ids.select("token", "token_id", "cf"), ["token"], weight="cf", how="inner")
    return coded.groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.struct("token_id", "n"))).alias("bag")
    )


def top_terms(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent terms of ``(token, cf)``; ties go by token."""
    return counts.orderBy(F.desc("cf"), "token").limit(k)


def tfidf(
    df: DataFrame, tokens: Column, max_features: int = 5000, id_col: str = "doc_id"
) -> DataFrame:
    """``(id, token, weight)``: smooth TF-IDF with unit length per document.

    The vocabulary is the ``max_features`` most frequent terms; the weight of a term is
    ``n * (ln((1 + docs) / (1 + df)) + 1)`` before each document is scaled to length 1.
    """
    counts = stored(term_counts(df, tokens, id_col), "term-counts")
    terms = frequencies_of(counts)
    kept = attach_row(top_terms(terms, max_features), df.agg(F.count(F.lit(1)).alias("__docs")))
    idf = kept.select(
        "token", (F.log((1 + F.col("__docs")) / (1 + F.col("df"))) + 1).alias("idf")
    )
    side = F.broadcast(idf) if max_features <= BROADCAST_ROWS else idf
    weighted = counts.join(side, "token").select(
        id_col, "token", (F.col("n") * F.col("idf")).alias("__w")
    )
    document = Window.partitionBy(id_col)
    length = F.sqrt(F.sum(F.col("__w") * F.col("__w")).over(document))
    return weighted.select(id_col, "token", (F.col("__w") / length).alias("weight"))

"""Topic model kept as tables: no vocabulary on the driver, any number of terms.

The model is a table with a row for each term and its expected count under each topic. A pass over the documents is
zero-order variational inference: a document starts with even shares of topics, and a few times over each of its words
is dealt out to the topics in proportion to

    (count of the term under the topic + eta) / (count of the topic + terms * eta) * (the document's share + alpha)

and the shares are added up anew. What the words give to each topic in the end, summed over all documents, is the next
table. Commonest terms travel with the tasks, up to a stated number; the rows of rarer ones go to the blocks of documents
that hold them, once to each block. The first table is drawn from a hash of term and topic, so a fit is the same on every cluster.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpometer.functions.keys import order_key
from corpometer.operators import bags, coherence
from corpometer.operators.joins import local_rows, lookup
from corpometer.session import cleared, fresh_path, stored

NO_TERM = "No token is left after filtering by document frequency."
HOT_TERMS = 100_000  # at most so many rows of the model travel with the tasks, 8 MB for ten topics
SLICE_PAIRS = 200_000  # documents are dealt out together up to so many terms in all
BLOCK_PAIRS = 500_000  # terms of the documents of a block, on average


@dataclass
class Topics:
    """A fitted model: ``terms`` (token, token_id, cf, w), ``w`` an array with the expected count under each topic."""

    terms: DataFrame
    size: int
    k: int
    alpha: float
    eta: float


def kept_terms(counts: DataFrame, n_docs: int, no_below: float = 5, no_above: float = 0.5) -> DataFrame:
    """``(token, token_id, cf)`` of the terms in ``no_below`` to ``no_above`` documents, of stored ``(id, token, n)``.

    ``no_above`` is a share of the documents, cut down to whole ones; ``no_below`` a number, or a share under 1.
    """
    least = math.ceil(no_below * n_docs) if 0 < no_below < 1 else no_below
    most = max(1, math.floor(no_above * n_docs + 1e-9))
    return bags.dictionary(bags.frequencies_of(counts).where(F.col("df").between(least, most)))


def start(terms: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """``terms`` with ``w``: exponential numbers drawn from the md5 of seed, term and topic."""
    eight = lambda t: F.conv(F.substring(order_key(seed, "token", t), 1, 8), 16, 10).cast("double")
    drawn = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda t: -F.log((eight(t) + 0.5) / F.lit(2.0**32)))
    return terms.withColumn("w", drawn)


def topic_totals(terms: DataFrame, k: int) -> list[float]:
    """Expected count of each topic: one row of ``k`` numbers."""
    sums = terms.agg(F.array(*[F.sum(F.col("w")[t]) for t in range(k)]).alias("sums"))
    return [float(x or 0) for x in local_rows(sums, 1).column("sums")[0].as_py()]


def dealt(n: np.ndarray, weights: np.ndarray, sizes: np.ndarray, alpha: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """How documents deal their words out: (terms x topics) expected counts, and (documents x topics) counts of topics.

    The terms of all documents lie behind one another, ``sizes`` of them in each and one at least. ``weights`` has
    what each topic makes of each term. The shares are even at first.
    """
    row, starts = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    shares = np.ones((len(sizes), weights.shape[1]))
    for _ in range(rounds):
        given = weights * shares[row]
        given *= (n / given.sum(axis=1))[:, None]
        counts = np.add.reduceat(given, starts, axis=0)
        shares = counts + alpha
    return given, counts


def _slices(bags_: pa.Array, pairs: int = SLICE_PAIRS) -> Iterator[tuple[int, int]]:
    """Row ranges whose bags hold about ``pairs`` terms at most; a larger bag is a range of its own."""
    low = held = 0
    for i, size in enumerate(pc.list_value_length(bags_).to_pylist()):
        if i > low and held + size > pairs:
            yield low, i
            low, held = i, 0
        held += size
    if len(bags_) > low:
        yield low, len(bags_)


def _rows(matrix: np.ndarray) -> pa.ListArray:
    places = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(places), pa.array(matrix.ravel()))


def _model_rows(table: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Term ids in order, and their rows of the model."""
    ids = table.column("token_id").to_numpy()
    w = np.concatenate([np.zeros(0), *(c.flatten().to_numpy(zero_copy_only=False) for c in table.column("w").chunks)]).reshape(-1, k)
    order = np.argsort(ids, kind="stable")
    return ids[order], w[order]


class Inference:
    """The documents of a corpus as bags, laid out for passes over them.

    Documents are dealt into blocks by a hash of their id, so many that a block holds about ``BLOCK_PAIRS`` terms.
    Terms beyond the ``hot_terms`` heaviest are known by block: a pass sends each one's row of the model once to
    every block that holds it, and no row for each document that does.
    """

    def __init__(self, counts: DataFrame, terms: DataFrame, id_col: str = "doc_id", hot_terms: int = HOT_TERMS):
        self.id_col, self.hot_terms = id_col, hot_terms
        self.size = terms.count()
        self.any_rare = self.size > hot_terms
        self.hot = stored(terms.orderBy(F.desc("cf"), "token_id").limit(hot_terms).select("token_id"), "hot-terms")
        coded = lookup(counts, terms, ["token"], weight="cf", how="inner").select(id_col, "token_id", "n")
        grouped = coded.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("token_id", "n"))).alias("bag"))
        self.bags = stored(grouped, "bags")
        if self.any_rare:
            pairs = self.bags.agg(F.coalesce(F.sum(F.size("bag")), F.lit(0))).scalar()
            # A scalar column is read where it is used, so the number of blocks is no constant of the plan.
            blocks = F.ceil((pairs + 1) / F.lit(BLOCK_PAIRS)).cast("bigint")
            self.blocks = stored(self.bags.withColumn("__block", F.pmod(F.xxhash64(id_col), blocks)), "blocks")
            asked = self.blocks.select("__block", F.inline("bag")).select("__block", "token_id")
            self.asked = stored(asked.join(F.broadcast(self.hot), "token_id", "left_anti").distinct(), "asked")

    def run(self, model: Topics, rounds: int, per_document: bool) -> DataFrame:
        """``(id, topics)`` with the counts of topics of each document, or else ``(token_id, w)`` of parts of the next table."""
        heavy = model.terms.join(F.broadcast(self.hot), "token_id", "left_semi").select("token_id", "w")
        k, alpha, eta, size = model.k, model.alpha, model.eta, model.size
        totals = np.array(topic_totals(model.terms, k)) + size * eta
        # At most hot_terms rows of k numbers.
        ids, known = _model_rows(local_rows(heavy, self.hot_terms), k)
        known = (known + eta) / totals
        key = self.id_col

        def weights_of(terms: np.ndarray, rare: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
            place = np.minimum(np.searchsorted(ids, terms), len(ids) - 1)
            if rare is None or not len(rare[0]):
                return known[place]
            own = np.minimum(np.searchsorted(rare[0], terms), len(rare[0]) - 1)
            return np.where((ids[place] == terms)[:, None], known[place], rare[1][own])

        def documents(keys: pa.Array, n: np.ndarray, terms: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
            counts = dealt(n, weights, sizes, alpha, rounds)[1]
            return pa.RecordBatch.from_arrays([keys, _rows(counts)], names=[key, "topics"])

        def parts(keys: pa.Array, n: np.ndarray, terms: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
            given = dealt(n, weights, sizes, alpha, rounds)[0]
            # One row for each term of the slice, however many of its documents hold it.
            order = np.argsort(terms, kind="stable")
            distinct, first = np.unique(terms[order], return_index=True)
            return pa.RecordBatch.from_arrays([pa.array(distinct), _rows(np.add.reduceat(given[order], first, axis=0))], names=["token_id", "w"])

        make: Callable[..., pa.RecordBatch] = documents if per_document else parts
        id_type = self.bags.schema[key].dataType.simpleString()
        schema = f"`{key}` {id_type}, topics array<double>" if per_document else "token_id bigint, w array<double>"

        def sliced(batch: pa.RecordBatch, rare: tuple[np.ndarray, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
            for low, high in _slices(batch.column("bag")):
                held = batch.column("bag").slice(low, high - low)
                flat = held.flatten()
                terms, n = (pc.struct_field(flat, f).to_numpy(zero_copy_only=False) for f in ("token_id", "n"))
                sizes = pc.list_value_length(held).to_numpy(zero_copy_only=False)
                yield make(batch.column(key).slice(low, high - low), n.astype(float), terms, weights_of(terms, rare), sizes)

        if not self.any_rare:
            return self.bags.select(key, "bag").mapInArrow(lambda batches: (one for b in batches for one in sliced(b, None)), schema)

        def block(docs: pa.Table, rows: pa.Table) -> pa.Table:
            own, w = _model_rows(rows, k)
            rare = (own, (w + eta) / totals)
            return pa.Table.from_batches([one for b in docs.to_batches() for one in sliced(b, rare)])

        asked = self.asked.join(model.terms.select("token_id", "w"), "token_id")
        return self.blocks.groupBy("__block").cogroup(asked.groupBy("__block")).applyInArrow(block, schema)


def next_terms(inference: Inference, model: Topics, rounds: int) -> DataFrame:
    """The terms with the table that one pass over the documents gives."""
    parts = inference.run(model, rounds, per_document=False)
    sums = parts.groupBy("token_id").agg(F.array(*[F.sum(F.col("w")[t]) for t in range(model.k)]).alias("w"))
    return model.terms.drop("w").join(sums, "token_id").select("token", "token_id", "cf", "w")


def fit(
    counts: DataFrame, terms: DataFrame, k: int = 10, passes: int = 5, rounds: int = 10, seed: int = 42,
    alpha: float | None = None, eta: float | None = None, id_col: str = "doc_id", hot_terms: int = HOT_TERMS,
) -> tuple[Topics, Inference]:
    """The model of stored term counts ``(id, token, n)`` after ``passes`` over the documents of ``rounds`` each.

    ``alpha`` and ``eta`` are one over ``k`` unless given. Every pass is written to the shared folder, where the
    next one reads it; only the last is kept.
    """
    spark = counts.sparkSession
    if terms.isEmpty():
        raise ValueError(NO_TERM)
    inference = Inference(counts, terms, id_col, hot_terms)
    alpha, eta = alpha or 1 / k, eta or 1 / k
    model = Topics(stored(start(terms, k, seed), "topics-start"), inference.size, k, alpha, eta)
    for _ in range(passes):
        path = fresh_path(spark, "topics")
        with cleared(spark):
            next_terms(inference, model, rounds).write.parquet(path)
        model = Topics(spark.read.parquet(path), inference.size, k, alpha, eta)
    return model, inference


def term_weights(model: Topics, corpus: str = "all", corpus_col: str = "corpus") -> DataFrame:
    """``(corpus, topic, word, weight)``: the probability of each term under each topic, which sum to one."""
    totals = [t + model.size * model.eta for t in topic_totals(model.terms, model.k)]
    sums = F.array(*[F.lit(t) for t in totals])
    rows = model.terms.select("token", F.posexplode("w").alias("topic", "w"))
    weight = (F.col("w") + model.eta) / F.element_at(sums, F.col("topic") + 1)
    return rows.select(F.lit(corpus).alias(corpus_col), F.col("topic").cast("bigint").alias("topic"), F.col("token").alias("word"), weight.alias("weight"))


def topic_words(model: Topics, k: int = 20, corpus: str = "all", corpus_col: str = "corpus") -> DataFrame:
    """``(corpus, topic, rank, word)``: the ``k`` heaviest words of each topic, ties by word."""
    return coherence.top_words(term_weights(model, corpus, corpus_col).withColumn("weight", F.round("weight", 12)), k, corpus_col)


def document_topics(inference: Inference, model: Topics, rounds: int = 10) -> DataFrame:
    """``(id, topics)``: the share of each topic in every document that holds a term."""
    counts = inference.run(model, rounds, per_document=True)
    total = F.aggregate("topics", F.lit(0.0), lambda a, b: a + b)
    return counts.select(inference.id_col, F.transform("topics", lambda t: (t + model.alpha) / (total + model.k * model.alpha)).alias("topics"))


def fitted_counts(df: DataFrame, tokens: Column, id_col: str = "doc_id") -> tuple[DataFrame, int]:
    """Stored term counts of the documents that hold a token, and the number of these documents."""
    counts = stored(bags.term_counts(df, tokens, id_col), "term-counts")
    return counts, counts.select(id_col).distinct().count()

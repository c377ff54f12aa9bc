"""Real against synthetic text without a vocabulary: hashed words and stochastic gradient descent on many shards.

Every word adds one or takes one away at a place that its hash gives, so no dictionary is made and new words need no
new fit. Training rows are dealt into shards of about equal size by a hash of their id. In an epoch each shard starts
from the common weights, takes its rows one by one in hash order, and returns the mean of the weights on its way; the
mean over shards, by rows, is where the next epoch starts. Part of the training rows, chosen by hash, is kept aside to
tell when to stop. Shards and their order depend on ids alone, so a fit does not follow files or cores.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpometer.functions import text as T
from corpometer.functions.keys import order_key
from corpometer.operators.joins import local_rows
from corpometer.operators.reports import class_report, confusion, summary_scores
from corpometer.operators.sampling import split
from corpometer.plans.classify import labelled
from corpometer.session import stored

BITS = 18  # 262,144 places
SHARD_ROWS = 2_000
MOST_PARTS = 1_000
BAG_ROWS = 1_000  # texts whose words are counted at a time
VALIDATION = 0.1


@dataclass
class Hashed:
    """Fitted weights, one for each place and one for all rows, and what the fit was like."""

    weights: np.ndarray
    bias: float
    epochs: int
    losses: list[float]


def hashed_bags(df: DataFrame, tokens: Column, bits: int = BITS, seed=0, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``(*keep, places, ns)``: for each row the signed counts of its words by the place that their hash gives.

    Places ascend and those that cancel out are left out. A text's words are added up where it is read, ``BAG_ROWS``
    texts at a time, and each distinct word of these is hashed once; no row moves.
    """
    size, names = 1 << bits, list(keep)
    prefix = f"{seed}:".encode()

    def bags(part: pa.RecordBatch) -> pa.RecordBatch:
        lists = part.column("__t")
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        words = lists.flatten().cast(pa.large_binary()).dictionary_encode()
        keys = [hashlib.md5(prefix + w).hexdigest() for w in words.dictionary.to_pylist()]
        place = np.array([int(k[:8], 16) % size for k in keys], np.int64)
        sign = np.array([1 if k[8] < "8" else -1 for k in keys], np.int64)
        code = words.indices.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(sizes)), sizes)
        found, at = np.unique(row * size + place[code], return_inverse=True)
        n = np.bincount(at, weights=sign[code], minlength=len(found)).astype(np.int64)
        found, n = found[n != 0], n[n != 0]
        starts = pa.array(np.searchsorted(found, np.arange(len(sizes) + 1) * size).astype(np.int32))
        places, ns = pa.ListArray.from_arrays(starts, pa.array((found % size).astype(np.int32))), pa.ListArray.from_arrays(starts, pa.array(n))
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in names), places, ns], names=[*names, "places", "ns"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BAG_ROWS):
                yield bags(batch.slice(start, BAG_ROWS))

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    # A word that is null counts for nothing in no place.
    whole = F.filter(tokens, lambda t: t.isNotNull())
    return df.select(*names, whole.alias("__t")).mapInArrow(run, f"{schema}, places array<int>, ns array<bigint>")


def _added_up(bags: DataFrame, id_col: str) -> DataFrame:
    """``(id, place, n)`` over all bags of an id; zeros are left out."""
    rows = bags.select(id_col, F.inline(F.arrays_zip(F.col("places").alias("place"), F.col("ns").alias("__n"))))
    return rows.toDF(id_col, "place", "__n").groupBy(id_col, "place").agg(F.sum("__n").alias("n")).where("n <> 0")


def hashed_counts(df: DataFrame, tokens: Column, bits: int = BITS, seed=0, id_col: str = "doc_id") -> DataFrame:
    """``(id, place, n)``: signed counts of words by the place that their hash gives; zeros are left out.

    The first 32 bits of the md5 of seed and word give the place, its ninth digit the sign: two words that share a
    place cancel out as often as they add up.
    """
    return _added_up(hashed_bags(df, tokens, bits, seed, [id_col]), id_col)


def _of_ids(rows: DataFrame, id_col: str) -> DataFrame:
    """``rows`` of stored bags with a split, each with the places and counts of all bags of its id, and ``counted``.

    ``counted`` is true for one training row of each id. A null id has no places. Only the bags of ids that come more
    than once move, are taken apart and added up.
    """
    trained, known = F.col("split") == "train", F.col(id_col).isNotNull()
    repeated = rows.where(known).groupBy(id_col).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(id_col)
    repeated = stored(repeated, "repeated-ids")
    bare = {c: F.when(known, F.col(c)).otherwise(F.array().cast(rows.schema[c].dataType)) for c in ("places", "ns")}
    if repeated.isEmpty():
        return rows.withColumns({**bare, "counted": trained & known})
    single = rows.join(repeated, id_col, "left_anti").withColumns({**bare, "counted": trained & known})
    several = rows.join(repeated, id_col, "left_semi")
    packed = _added_up(several, id_col).groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("place", "n"))).alias("v"))
    first = F.row_number().over(Window.partitionBy(id_col, "split").orderBy("label")) == 1
    merged = several.drop("places", "ns").withColumn("counted", first & trained).join(packed, id_col, "left")
    found = {c: F.coalesce(F.col(f"v.{n}"), F.array().cast(rows.schema[c].dataType)) for c, n in (("places", "place"), ("ns", "n"))}
    return single.unionByName(merged.withColumns(found).drop("v"))


def vectors(rows: DataFrame, n: int, bits: int = BITS) -> DataFrame:
    """``rows`` with ``ns`` replaced by ``values``: counts times the smoothed inverse frequency of the place, of length one.

    ``rows`` have ``places`` and ``ns``; ``counted`` marks those to count in, one for each id, and ``n`` is
    the number of documents that frequencies are out of. There are as many frequencies as places at most, which
    bounds what travels with the tasks.
    """
    seen = rows.where("counted").select(F.explode("places").alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("df"))
    table = local_rows(seen, 1 << bits)
    df = np.zeros(1 << bits)
    df[table.column("place").to_numpy()] = table.column("df").to_numpy()
    idf = np.log((1 + n) / (1 + df)) + 1
    kept = [f for f in rows.schema.fields if f.name not in ("places", "ns", "counted")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("places")
            sizes = pc.list_value_length(places).to_numpy(zero_copy_only=False)
            x = batch.column("ns").flatten().to_numpy() * idf[places.flatten().to_numpy()]
            row = np.repeat(np.arange(len(sizes)), sizes)
            norm = np.sqrt(np.bincount(row, weights=x * x, minlength=len(sizes)))
            starts = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            values = pa.ListArray.from_arrays(starts, pa.array(x / norm[row]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), places, values], names=[*names, "places", "values"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.select(*names, "places", "ns").mapInArrow(run, f"{schema}, places array<int>, values array<double>")


def _shards(rows: DataFrame, shard_rows: int, seed, id_col: str) -> DataFrame:
    """A row for each shard: its ``rows`` (label, places, values), in hash order.

    Shards are dealt out before they are stored, so that no epoch has to move them again.
    """
    shards = max(1, -(-rows.count() // shard_rows))
    key = order_key(seed, id_col)
    number = F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint"), F.lit(shards))
    packed = F.sort_array(F.collect_list(F.struct(F.substring(key, 9, 24).alias("key"), "label", "places", "values")))
    # At least as many parts as the cores can take, and otherwise one for each shard, which keeps a task small.
    parts = max(rows.sparkSession.sparkContext.defaultParallelism * 2, min(shards, MOST_PARTS))
    dealt = rows.withColumn("shard", number).repartition(parts, "shard")
    return stored(dealt.groupBy("shard").agg(packed.alias("rows")).select("rows"), "shards")


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _rows_of(one: pa.Scalar) -> list[tuple[float, np.ndarray, np.ndarray]]:
    found = one.values
    labels = found.field("label").to_numpy(zero_copy_only=False)
    places, values = found.field("places"), found.field("values")
    return [
        (float(labels[i]), places[i].values.to_numpy(zero_copy_only=False).astype(np.int64), values[i].values.to_numpy(zero_copy_only=False))
        for i in range(len(found))
    ]


def walked(rows: list[tuple[float, np.ndarray, np.ndarray]], weights: np.ndarray, bias: float, rate: float, reg: float) -> tuple[np.ndarray, float]:
    """The mean of weights and bias over one walk along the rows, by logistic loss and a penalty on squared weights.

    A step changes few places. The mean is therefore kept as a sum that is corrected by what a step changes, and
    the penalty's shrinking as a factor of all weights.
    """
    w, b = weights.copy(), bias
    late, late_b = np.zeros_like(w), 0.0  # sum over steps of (steps before it) times the change it made
    scale, n = 1.0, len(rows)
    for i, (label, at, x) in enumerate(rows):
        scale *= 1 - rate * reg
        slip = rate * (label - _sigmoid(scale * (w[at] @ x) + b))
        change = slip / scale * x
        w[at] += change
        b += slip
        late[at] += i * change
        late_b += i * slip
    # Steps before a change took no part in it: the mean is the end less the changes weighted by how late they came.
    return scale * (w - late / n), b - late_b / n


def fit(
    rows: DataFrame, bits: int = BITS, rate: float = 1.0, reg: float = 1e-5, epochs: int = 40, patience: int = 3, tolerance: float = 1e-3,
    validation: float = VALIDATION, shard_rows: int = SHARD_ROWS, seed=42, id_col: str = "doc_id",
) -> Hashed:
    """Weights from stored rows (id, label, places, values), label 1 or 0.

    Stops after ``patience`` epochs without a validation loss better by ``tolerance``, and returns the best
    weights. What comes to the driver in an epoch is at most one number for each place.
    """
    spark = rows.sparkSession
    aside = F.substring(order_key(f"{seed}-validation", id_col), 1, 8) < f"{round(validation * 2**32):08x}"
    rest, chosen = _shards(rows.where(~aside), shard_rows, seed, id_col), _shards(rows.where(aside), shard_rows, seed, id_col)
    if rest.isEmpty() or chosen.isEmpty():
        raise ValueError("Too few rows to train on and to keep some aside.")
    size = 1 << bits
    best, best_loss, since, losses = (np.zeros(size), 0.0), np.inf, 0, []
    now = best
    cores = spark.sparkContext.defaultParallelism
    # A task sends as many sums as there are places, so tasks are no more than the cores need.
    rest, chosen = rest.coalesce(cores), chosen.coalesce(cores)
    for epoch in range(epochs):
        now = _epoch(rest, *now, rate / (1 + epoch) ** 0.5, reg)
        loss = _loss(chosen, *now)
        losses.append(loss)
        since = 0 if loss < best_loss - tolerance else since + 1
        if loss < best_loss:
            best, best_loss = now, loss
        if since >= patience:
            break
    return Hashed(*best, len(losses), losses)


def _epoch(shards: DataFrame, weights: np.ndarray, bias: float, rate: float, reg: float) -> tuple[np.ndarray, float]:
    size = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved, moved_b, seen = np.zeros(size), 0.0, 0
        for batch in batches:
            for one in batch.column("rows"):
                rows = _rows_of(one)
                w, b = walked(rows, weights, bias, rate, reg)
                moved += len(rows) * (w - weights)
                moved_b += len(rows) * (b - bias)
                seen += len(rows)
        at = np.flatnonzero(moved)
        # Place -1 is the bias, place -2 the number of rows.
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-1, -2], at]), pa.int64()), pa.array(np.concatenate([[moved_b, seen], moved[at]]))], names=["place", "x"]
        )

    sums = shards.select("rows").mapInArrow(run, "place bigint, x double").groupBy("place").agg(F.sum("x").alias("x"))
    table = local_rows(sums, size + 2)
    place, x = table.column("place").to_numpy(), table.column("x").to_numpy()
    seen = x[place == -2][0]
    new = weights.copy()
    new[place[place >= 0]] += x[place >= 0] / seen
    return new, bias + x[place == -1][0] / seen


def _loss(shards: DataFrame, weights: np.ndarray, bias: float) -> float:
    """Mean logistic loss of the rows kept aside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0.0, 0
        for batch in batches:
            for one in batch.column("rows"):
                for label, at, x in _rows_of(one):
                    z = weights[at] @ x + bias
                    total += float(np.logaddexp(0, -z if label else z))
                    seen += 1
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([float(seen)])], names=["total", "seen"])

    sums = shards.select("rows").mapInArrow(run, "total double, seen double").agg(F.sum("total").alias("total"), F.sum("seen").alias("seen"))
    row = local_rows(sums, 1).to_pylist()[0]
    return row["total"] / row["seen"]


def score(rows: DataFrame, model: Hashed) -> DataFrame:
    """``rows`` with places and values replaced by ``score``, the probability of label 1, and ``prediction``."""
    weights, bias = model.weights, model.bias
    kept = [f for f in rows.schema.fields if f.name not in ("places", "values")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, value = batch.column("places"), batch.column("values")
            z = np.array([weights[p.values.to_numpy(zero_copy_only=False)] @ v.values.to_numpy(zero_copy_only=False) for p, v in zip(place, value, strict=True)], dtype=float)
            found = _sigmoid(z + bias)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(found), pa.array((found >= 0.5).astype(float))], names=[*names, "score", "prediction"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.select(*names, "places", "values").mapInArrow(run, f"{schema}, score double, prediction double")


@dataclass
class Judged:
    """The fitted weights, the scored test rows, the class report and the summary scores."""

    model: Hashed
    scored: DataFrame
    report: DataFrame
    scores: DataFrame


def classify_hashed(
    df: DataFrame, synthetic: str | Sequence[str] = "synthetic", text_col: str = "text", id_col: str = "doc_id", corpus_col: str = "corpus",
    test_share: float = 0.3, bits: int = BITS, seed=42, stop_words=T.ENGLISH_STOP_WORDS, **options,
) -> Judged:
    """Real against synthetic on hashed words, with a stratified test split; ``options`` as in :func:`fit`."""
    texts = labelled(df.where(T.has_text(text_col)), synthetic, corpus_col)
    bags = stored(hashed_bags(texts, T.tfidf_tokens(text_col, stop_words), bits, keep=[id_col, corpus_col, "label"]), "hashed-bags")
    parts = split(bags, test_share, label_col="label", seed=seed, id_col=id_col)
    sizes = local_rows(parts.where(F.col("split") == "train").groupBy("label").agg(F.count(F.lit(1)).alias("n"))).column("n").to_pylist()
    if len(sizes) < 2:
        raise ValueError("Both corpora need rows to train a classifier.")
    placed = stored(vectors(_of_ids(parts, id_col), sum(sizes), bits), "vectors")
    model = fit(placed.where(F.col("split") == "train").drop("split"), bits, seed=seed, id_col=id_col, **options)
    scored = score(placed.where(F.col("split") == "test").drop("split"), model).select(id_col, corpus_col, "label", "prediction", "score")
    return Judged(model, scored, class_report(confusion(scored), {0: "real", 1: "synthetic"}), summary_scores(scored))

"""Log-bilinear language model trained with noise-contrastive estimation, against a unigram base."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpometer.llm.common import heaviest, let_go, pieces
from corpometer.session import fresh_path, stored

END = b" "
BUCKETS = 128
WORDS = 1024 - BUCKETS - 1
HOT = 100_000
WIDTH = 16
NOISE = 48
BATCH = 8_192
RATE = 0.02
SHARD_TOKENS = 200_000
ROUNDS = 32
FLUSH = 300_000


def tokens_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space with A-Z lower-cased, then the end token."""
    out = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out.append(END)
    return out


def bucket_of(token: bytes) -> int:
    """Class of a word outside the model's list, by its last two bytes, which hint at its language and form."""
    return zlib.crc32(token[-2:]) % BUCKETS


@dataclass
class Vocabulary:
    """The most frequent training tokens, their counts and model ids, and totals over all tokens.

    Model ids: 0 is the end token, then listed words, then a bucket for each class of other words.
    ``bucket_log`` is the log10 of what a bucket's words share: their count, one for each, and one for
    all that training has not seen.
    """

    tokens: list[bytes]
    counts: np.ndarray
    ids: np.ndarray
    total: int
    distinct: int
    id_counts: np.ndarray
    bucket_log: np.ndarray


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, bucket, n) over whole texts; tasks add up what they read before it is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            names = list(seen)
            columns = [pa.array(names, pa.string()), pa.array([bucket_of(t) for t in names], pa.int32()), pa.array(list(seen.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["token", "bucket", "n"])

        for batch in batches:
            for value in batch.column(0):
                seen.update(tokens_of(value.as_py()))
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        yield out()

    return docs.select(F.col(text).alias("text")).mapInArrow(count, "token string, bucket int, n long").groupBy("token", "bucket").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, words: int = WORDS, hot: int = HOT) -> Vocabulary:
    """The vocabulary of a stored table of counts; ``words`` bounds the model's list, ``hot`` what tasks hold."""
    ends = counts.where(F.col("token") == END.decode()).toArrow().to_pylist()
    top = heaviest(counts.where(F.col("token") != END.decode()), "n", hot).to_pylist()
    top = ends + sorted(top, key=lambda r: (-r["n"], r["token"]))
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).toArrow().to_pylist()[0]
    tokens = [r["token"].encode() for r in top]
    n, bucket = (np.array([r[c] for r in top], dtype=np.int64) for c in ("n", "bucket"))
    if tokens[:1] != [END]:  # nothing to learn from
        tokens, n, bucket = [END, *tokens], np.concatenate([[0], n]), np.concatenate([[0], bucket])
    listed = np.arange(len(tokens)) <= words
    size = int(listed.sum())
    ids = np.where(listed, np.arange(len(tokens)), size + bucket)
    by_bucket = counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toArrow().to_pylist()
    held, kinds = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in by_bucket:
        held[r["bucket"]], kinds[r["bucket"]] = r["n"], r["v"]
    real = listed & (n > 0)
    held -= np.bincount(bucket[real], weights=n[real], minlength=BUCKETS)
    kinds -= np.bincount(bucket[real], minlength=BUCKETS)
    return Vocabulary(
        tokens, n, ids.astype(np.int32), totals["n"] or 0, totals["v"], np.concatenate([n[listed].astype(float), held]), np.log10(held + kinds + 1)
    )


@dataclass
class Bilinear:
    """Vectors of context words and of predicted words, a matrix for each of two places before, and biases."""

    context: np.ndarray
    target: np.ndarray
    places: list[np.ndarray]
    bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of (word one before, word), of (word two before, word) with the bias, and the log of the
        sum over all words for each pair of words before: one matrix product of the exponentials."""
        one, two = ((self.context @ p) @ self.target.T for p in self.places)
        two = two + self.bias
        high_one, high_two = one.max(1, keepdims=True), two.max(1, keepdims=True)
        sums = np.exp(one - high_one) @ np.exp(two - high_two).T
        return one, two, np.log(sums) + high_one + high_two.T


def start(vocab: Vocabulary, width: int = WIDTH) -> Bilinear:
    """Small random vectors, and the unigram's log-probabilities as biases."""
    rng = np.random.default_rng(11)
    n = len(vocab.id_counts)
    share = (vocab.id_counts + 1) / (vocab.id_counts + 1).sum()
    small = lambda *shape: rng.normal(0, 0.1, shape)
    return Bilinear(small(n, width), small(n, width), [np.eye(width) + small(width, width), np.eye(width) + small(width, width)], np.log(share))


class Trainer:
    """Noise-contrastive estimation with AdaGrad on runs of ids.

    A batch's noise words are drawn from the unigram distribution and shared by its places. Each place
    tells its own word from the noise by score less the log of noise draws expected, so scores come to
    be log-probabilities; what is left of the sum over words is put right by the exact one when scoring.
    """

    def __init__(self, model: Bilinear, vocab: Vocabulary, noise: int = NOISE, rate: float = RATE, state: np.ndarray | None = None, seed: int = 5, traced: bool = False):
        self.context, self.target = model.context.astype(np.float32), model.target.astype(np.float32)
        self.places = [p.astype(np.float32) for p in model.places]
        self.bias = model.bias.astype(np.float32)
        share = (vocab.id_counts + 1) / (vocab.id_counts + 1).sum()
        self.noise, self.rate, self.seen = noise, rate, 0
        self.edges, self.expected = np.cumsum(share), np.log(noise * share).astype(np.float32)
        self.rng = np.random.default_rng([5, seed])
        self.squares = [np.full_like(w, 1e-2) for w in self._weights()]
        self.lost, self.traced = 0.0, traced
        if state is not None:
            self._set(state)

    def state(self) -> np.ndarray:
        """Weights and squared gradients so far as rows of one table."""
        width = self.context.shape[1]
        tall = lambda w: w if w.ndim == 2 else np.concatenate([w, np.zeros(-len(w) % width, w.dtype)]).reshape(-1, width)
        return np.concatenate([tall(w) for w in (*self._weights(), *self.squares)]).astype(np.float64)

    def _set(self, state: np.ndarray) -> None:
        width, low = self.context.shape[1], 0
        for w in (*self._weights(), *self.squares):
            rows = len(w) if w.ndim == 2 else -(-len(w) // width)
            w[:] = state[low : low + rows].ravel()[: w.size].reshape(w.shape)
            low += rows

    def model(self) -> Bilinear:
        return Bilinear(*(w.astype(np.float64) for w in (self.context, self.target)), [p.astype(np.float64) for p in self.places], self.bias.astype(np.float64))

    def _weights(self) -> list[np.ndarray]:
        return [self.context, self.target, *self.places, self.bias]

    def _gather(self, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        n, width = self.context.shape
        flat = ids.astype(np.int64)[:, None] * width + np.arange(width)
        return np.bincount(flat.ravel(), weights=rows.ravel(), minlength=n * width).reshape(n, width).astype(np.float32)

    def step(self, one: np.ndarray, two: np.ndarray, word: np.ndarray) -> None:
        """Ascend on a batch: words, and the words one and two places before."""
        n = len(word)
        self.seen += n
        moved = [self.context @ p for p in self.places]
        query = moved[0][one] + moved[1][two]
        noise = np.searchsorted(self.edges, self.rng.random(self.noise)).clip(0, len(self.bias) - 1)
        own = self.target[word]
        real = np.einsum("ij,ij->i", query, own) + self.bias[word] - self.expected[word]
        false = query @ self.target[noise].T + (self.bias[noise] - self.expected[noise])
        up = 1 / (1 + np.exp(np.clip(real, -30, 30)))
        if self.traced:
            self.lost += float(np.logaddexp(0, -real).sum() + np.logaddexp(0, false).sum())
        down = -1 / (1 + np.exp(-np.clip(false, -30, 30)))
        back = up[:, None] * own + down @ self.target[noise]
        target = self._gather(word, up[:, None] * query)
        np.add.at(target, noise, down.T @ query)
        bias = np.bincount(word, weights=up, minlength=len(self.bias))
        np.add.at(bias, noise, down.sum(0))
        by_place = [self._gather(ids, back) for ids in (one, two)]
        grads = [by_place[0] @ self.places[0].T + by_place[1] @ self.places[1].T, target, *(self.context.T @ g for g in by_place), bias]
        for weight, grad, square in zip(self._weights(), grads, self.squares, strict=True):
            grad = (grad / n).astype(np.float32) * np.float32(100)
            square += grad * grad
            weight += np.float32(self.rate) * grad / np.sqrt(square)


def places_of(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of several texts in a row, with the word one and two before each; before a text stand ends (0)."""
    word = np.concatenate(runs)
    starts = np.cumsum([0, *map(len, runs[:-1])])
    one, two = np.zeros_like(word), np.zeros_like(word)
    one[1:], two[2:] = word[:-1], word[:-2]
    one[starts] = two[starts] = 0
    long = starts[[len(r) > 1 for r in runs]]
    two[long + 1] = 0
    return one, two, word


def _ids(tokens: list[bytes], index: dict[bytes, int], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Places in the hot list (-1 for rare tokens), model ids, and the rare tokens."""
    found = np.fromiter(map(index.get, tokens, _minus_ones(len(tokens))), dtype=np.int32, count=len(tokens))
    ids = vocab.ids[found]
    at = np.flatnonzero(found < 0)
    rare = [tokens[i] for i in at.tolist()]
    if rare:
        ids[at] = len(vocab.id_counts) - BUCKETS + np.fromiter(map(bucket_of, rare), dtype=np.int32, count=len(rare))
    return found, ids, rare


def _minus_ones(n: int) -> list[int]:
    return [-1] * n


def _sharded(docs: DataFrame, vocab: Vocabulary, text: str, shard_tokens: int) -> tuple[DataFrame, int]:
    """Stored (shard, key, ids, round) of all texts, and the number of rounds.

    A shard is about ``shard_tokens`` tokens, a round one of up to ``ROUNDS`` parts of the shards, each stored apart.
    Shard and order follow a hash of the row, its id too if there is one, so they are the same for any layout.
    """
    shards = max(1, -(-vocab.total // shard_tokens))
    rounds = min(ROUNDS, shards)
    key = F.xxhash64(*[F.col(c) for c in docs.columns if c in ("doc_id", text)])
    rows = docs.select(F.pmod(key, F.lit(shards)).alias("shard"), key.alias("key"), F.col(text).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        index = {t: i for i, t in enumerate(vocab.tokens)}
        for batch in batches:
            for low, high in pieces(batch.column(2), 1_000_000):
                ids = [_ids(tokens_of(t.as_py()), index, vocab)[1] for t in batch.column(2).slice(low, high - low)]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), lists], names=["shard", "key", "ids"])

    coded = rows.mapInArrow(encode, "shard long, key long, ids array<int>").withColumn("round", F.pmod("shard", F.lit(rounds)).cast("int"))
    path = fresh_path(docs.sparkSession, "token-runs")
    coded.repartition("shard").sortWithinPartitions("round", "shard", "key").write.partitionBy("round").parquet(path)
    return docs.sparkSession.read.schema(coded.schema).parquet(path), rounds


def train(
    docs: DataFrame, vocab: Vocabulary, text: str = "text", width: int = WIDTH, noise: int = NOISE, rate: float = RATE, shard_tokens: int = SHARD_TOKENS,
    losses: list[float] | None = None,
) -> Bilinear:
    """Train on all given texts, once, in rounds that each start from the mean of the round before.

    Texts are dealt into shards by hash. A round takes some of the shards; each one starts from the common state,
    and the mean of their states by tokens, weights and step sizes, is where the next round starts. More text makes
    more shards, and these more rounds, up to ``ROUNDS``. Neither files nor cores change the result. ``losses``
    takes the mean loss of each round's texts before it learns from them.
    """
    first = start(vocab, width)
    runs, rounds = _sharded(docs, vocab, text, shard_tokens)
    state = Trainer(first, vocab, noise, rate).state()
    for number in range(rounds):
        state = _round(runs.where(F.col("round") == number).select("shard", "ids"), state, first, vocab, noise, rate, losses)
    return Trainer(first, vocab, noise, rate, state).model()


def _round(rows: DataFrame, state: np.ndarray, first: Bilinear, vocab: Vocabulary, noise: int, rate: float, losses: list[float] | None) -> np.ndarray:
    """The mean state after each shard of the rows has been learnt from."""
    width, traced = state.shape[1], losses is not None
    names = [f"v{k}" for k in range(width)]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        total, seen, lost = np.zeros(state.shape), 0, 0.0
        trainer, shard, held, size = None, None, [], 0

        def end() -> None:
            nonlocal total, seen, lost
            if trainer is not None:
                _train_on(trainer, held)
                total += trainer.state() * trainer.seen
                seen += trainer.seen
                lost += trainer.lost

        for batch in batches:
            for number, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if number != shard:
                    end()
                    trainer, shard, held, size = Trainer(first, vocab, noise, rate, state, number, traced), number, [], 0
                held.append(ids.values.to_numpy(zero_copy_only=False))
                size += len(held[-1])
                if size >= 16 * BATCH:
                    _train_on(trainer, held)
                    held, size = [], 0
        end()
        if seen:
            columns = [pa.array(np.arange(len(total))), pa.array([float(seen)] * len(total)), pa.array([lost] * len(total)), *(pa.array(total[:, k]) for k in range(width))]
            yield pa.RecordBatch.from_arrays(columns, names=["at", "seen", "lost", *names])

    schema = "at long, seen double, lost double, " + ", ".join(f"{n} double" for n in names)
    parts = rows.mapInArrow(learn, schema)
    found = parts.groupBy("at").agg(*(F.sum(n).alias(n) for n in ("seen", "lost", *names))).orderBy("at").toArrow()
    if not found.num_rows:
        return state
    seen = found.column("seen").to_numpy()
    if losses is not None:
        losses.append(float(found.column("lost")[0].as_py() / seen[0]))
    return np.stack([found.column(n).to_numpy() for n in names], axis=1) / seen[:, None]


def _train_on(trainer: Trainer, runs: list[np.ndarray]) -> None:
    if not runs:
        return
    one, two, word = places_of(runs)
    order = trainer.rng.permutation(len(word))
    for low in range(0, len(word), BATCH):
        part = order[low : low + BATCH]
        trainer.step(one[part], two[part], word[part])


def scored(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, model: Bilinear, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, base_score and score, both log10 of the text's
    probability.

    ``base_score`` is that of the add-one unigram over ``counts``; ``score`` sums the model's normalised
    log-probabilities of listed words and buckets given the two before, and for a word of a bucket its
    share of the bucket by count plus one. Whole texts are scored; a null or empty text is its end
    alone. Counts of the most frequent tokens travel with the tasks; rarer tokens are joined with the
    stored ``counts``, which no token there is frequent enough to skew. Rows are told apart by a number
    given when they are first written, so repeated and null ids keep their rows.
    """
    logs = np.log10(vocab.counts + 1.0)
    first_bucket = len(vocab.id_counts) - BUCKETS

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        index = {t: i for i, t in enumerate(vocab.tokens)}
        one, two, sums = (t.astype(np.float32) for t in model.tables())
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for low, high in pieces(batch.column(1), 1_000_000):
                texts = [tokens_of(t.as_py()) for t in batch.column(1).slice(low, high - low)]
                sizes = np.array(list(map(len, texts)))
                found, ids, rare = _ids(list(chain.from_iterable(texts)), index, vocab)
                starts = np.cumsum([0, *sizes[:-1]])
                before, twice, word = places_of(np.split(ids, starts[1:]))
                token = (one[before, word] + two[twice, word] - sums[before, twice]).astype(np.float64) / np.log(10)
                count = np.where(found < 0, 0.0, logs[found])
                other = word >= first_bucket
                token += np.where(other, count - vocab.bucket_log[np.maximum(word - first_bucket, 0)], 0.0)
                known = (found >= 0) & (vocab.counts[found] > 0)
                at = np.searchsorted(starts, np.flatnonzero(found < 0), side="right") - 1
                columns = [
                    pa.array((task << 33) + row + np.arange(high - low)),
                    batch.column(0).slice(low, high - low),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.add.reduceat(known, starts, dtype=np.int64)),
                    pa.array(np.add.reduceat(count, starts)),
                    pa.array(np.add.reduceat(token, starts)),
                    pa.ListArray.from_arrays(
                        pa.array(np.searchsorted(at, np.arange(high - low + 1)), pa.int32()), pa.array(rare, pa.string())
                    ),
                ]
                row += high - low
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["row", "doc_id", "n_tokens", "hot_known", "hot_log", "hot_score", "rare"]
    schema = "row long, doc_id long, n_tokens long, hot_known long, hot_log double, hot_score double, rare array<string>"
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = stored(rows.mapInArrow(score, schema), "scored-rows")
    if vocab.distinct <= len(vocab.tokens):  # every token that has a count has travelled with the tasks
        rare = rows.select("row", F.lit(0).cast("long").alias("rare_known"), F.lit(0.0).alias("rare_log"))
    else:
        pairs = rows.select("row", F.explode("rare").alias("token"))
        held = pairs.join(counts.select("token", "n"), "token")
        rare = held.groupBy("row").agg(F.count("*").alias("rare_known"), F.sum(F.log10(F.col("n") + 1)).alias("rare_log"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (
        rows.drop("rare")
        .join(rare, "row", "left")
        .select(
            "doc_id",
            "n_tokens",
            (F.col("hot_known") + zero("rare_known")).alias("n_known"),
            (F.col("hot_log") + zero("rare_log") - F.col("n_tokens") * F.lit(float(np.log10(vocab.total + vocab.distinct + 1)))).alias("base_score"),
            (F.col("hot_score") + zero("rare_log")).alias("score"),
        )
    )


def scored_from(docs: DataFrame, training: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """Scores of ``docs`` under a model of ``training``, and the number of training tokens."""
    counts = stored(token_counts(training, text), "token-counts")
    vocab = vocabulary(counts)
    model = train(training, vocab, text)
    return scored(docs, counts, vocab, model, doc_id, text), vocab.total

"""Toxic passages as maximum-scoring segments of token log-odds, calibrated by extreme-value statistics."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpometer.llm.common import kept_by, labelled_sample, let_go, with_columns_from
from corpometer.llm.quality import logistic
from corpometer.session import stored

FIT_ROWS = 20_000
MIN_DOCUMENTS = 4
DEVIATIONS = 2.0
FLAT_PRIOR = 0.5
PRIOR = 1_000.0
DRIFT = 0.1
STEMS = (3, 4, 5, 6, 7, 8)
WORD = re.compile(r"[^\W\d_]+")
ADDED = ("score", "predicted", "passages")
CACHED_WORDS = 200_000
EULER = 0.5772156649015329


def units_of(word: str) -> list[str]:
    """A word and its beginnings, which stand for inflected forms; a beginning ends in a star."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


@dataclass
class Tox:
    """Log-odds of units, the extreme-value constants of clean text, and the document's logistic curve."""

    odds: dict[str, float]
    rate: float = 1.0  # lambda
    size: float = 1.0  # K
    document: np.ndarray | None = None


class Scores(dict):
    """Score of a word, worked out when first asked for: that of its heaviest unit, less the drift."""

    def __init__(self, odds: dict[str, float]):
        super().__init__()
        self.odds = odds

    def __missing__(self, word: str) -> float:
        if len(self) > CACHED_WORDS:
            self.clear()
        self[word] = value = max((self.odds[u] for u in units_of(word) if u in self.odds), default=0.0) - DRIFT
        return value


def token_scores(text: str | None, table: Scores) -> list[float]:
    """Scores of a text's words; a word said again at once adds nothing."""
    words = WORD.findall((text or "").lower())
    values = [table[w] for w in words]
    if len(words) > 1:
        for i in [i for i, same in enumerate(map(eq, words[1:], words), 1) if same]:
            values[i] = -DRIFT
    return values


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), end exclusive, in one pass over the scores.

    Each positive score opens a candidate with the running sums before and after it. It is merged with
    the nearest earlier candidate that began lower, as long as that one ended lower too. Candidates
    keep a link to the one they were compared with, so passed-over ones are never looked at again.
    """
    values = np.asarray(scores, dtype=np.float64)
    places = np.flatnonzero(values > 0)
    if not len(places):
        return []
    sums = np.concatenate([[0.0], np.cumsum(values)])
    held: list[tuple[int, int, float, float, int]] = []
    for place in places.tolist():
        start, end, low, high = place, place + 1, float(sums[place]), float(sums[place + 1])
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= low:
                j = held[j][4]
            if j < 0 or held[j][3] >= high:
                held.append((start, end, low, high, j))
                break
            start, low = held[j][0], held[j][2]
            del held[j:]
    return [(a, b, high - low) for a, b, low, high, _ in held]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold a unit, summed over what the task has read."""

    def out() -> pa.RecordBatch:
        names = list(counts[0].keys() | counts[1].keys())
        columns = [pa.array(names, pa.string()), *(pa.array([counts[k][n] for n in names], pa.int64()) for k in (1, 0))]
        return pa.RecordBatch.from_arrays(columns, names=["unit", "toxic", "clean"])

    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(WORD.findall((text or "").lower()))
            counts[label].update({u for w in words for u in units_of(w)})
            if len(counts[0]) + len(counts[1]) > 300_000:
                yield out()
                counts = (Counter(), Counter())
    yield out()


def log_odds(sample: DataFrame) -> dict[str, float]:
    """Units that stand out in toxic texts, with their log-odds less two standard deviations.

    The Dirichlet prior is a flat part and a part in proportion to the pooled counts. Every unit of four toxic
    documents of the sample and more is judged; the sample's rows bound how many there can be.
    """
    counts = stored(sample.mapInArrow(_counted, "unit string, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "units")
    row = counts.agg(F.sum("toxic").alias("n1"), F.sum("clean").alias("n0")).toArrow().to_pylist()[0]
    if not row["n1"]:
        return {}
    prior = F.lit(FLAT_PRIOR) + F.lit(PRIOR) * (F.col("toxic") + F.col("clean")) / F.lit(row["n1"] + row["n0"])

    def side(y: str, n: int) -> F.Column:
        return F.log((F.col(y) + prior) / (F.lit(n) + F.lit(PRIOR) - F.col(y) - prior))

    delta = side("toxic", row["n1"]) - side("clean", row["n0"])
    spread = F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
    odds = F.round(delta - F.lit(DEVIATIONS) * spread, 3).alias("odds")
    kept = counts.where(F.col("toxic") >= MIN_DOCUMENTS).select("unit", odds).where("odds > 0")
    return {r["unit"]: r["odds"] for r in kept.toArrow().to_pylist()}


def _measures(found: list[tuple[int, int, float]], n: int, model: Tox) -> tuple[float, float, float]:
    """The best segment in extreme-value units, the sum of significant ones, and the best raw score."""
    best = max((s for _, _, s in found), default=0.0)
    level = math.log(model.size * max(n, 1))
    over = sum(max(0.0, model.rate * s - level) for _, _, s in found)
    return model.rate * best - level if best else -10.0, math.log1p(over), best


def _rate(share: np.ndarray, values: np.ndarray) -> float:
    """The positive root of sum(share * exp(rate * value)) = 1, by bisection; values must fall on average."""
    low, high = 0.0, 1.0
    while (share * np.exp(np.minimum(high * values, 700))).sum() < 1 and high < 50:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (share * np.exp(np.minimum(mid * values, 700))).sum() < 1 else (low, mid)
    return max(low, 1e-3)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, max_rows: int = FIT_ROWS) -> Tox:
    """Learn from whole texts of at most about ``max_rows`` rows labelled ``toxic`` outside the held-out fold.

    Counts are of documents that hold a unit. Without labels, or with none that is toxic, no text is taken
    for toxic.
    """
    sample = stored(labelled_sample(docs, labels, "toxic", folds, held_out, max_rows), "toxicity-sample")
    model = Tox(log_odds(sample))
    odds = model.odds

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        table = Scores(odds)
        seen: Counter = Counter()
        for batch in batches:
            rows = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = token_scores(text, table)
                found = segments(values)
                if label == 0:
                    seen.update(round(v, 1) for v in values)
                rows.append({"label": label, "n": len(values), "segments": [s for _, _, s in found]})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
        # One row for each rounded score of a word in clean texts: how often the task has met it.
        yield pa.RecordBatch.from_pylist([{"label": -1, "n": c, "segments": [v]} for v, c in seen.items()], schema=schema)

    schema = pa.schema([("label", pa.int32()), ("n", pa.int64()), ("segments", pa.list_(pa.float64()))])
    rows = sample.mapInArrow(gather, "label int, n long, segments array<double>").toArrow().to_pylist()
    seen: Counter = Counter()
    for r in rows:
        if r["label"] < 0:
            seen[r["segments"][0]] += r["n"]
    rows = [r for r in rows if r["label"] >= 0]
    clean = [r for r in rows if r["label"] == 0]
    if len(clean) == len(rows) or not clean:
        model.document = np.array([-4.0, 0.0, 0.0, 0.0])
        return model
    values, share = np.array(list(seen)), np.array(list(seen.values()), dtype=float)
    if len(values):
        model.rate = _rate(share / share.sum(), values)
    tops = [model.rate * max(r["segments"]) - math.log(max(r["n"], 1)) for r in clean if r["segments"]]
    # A Gumbel variable's mean is its place plus Euler's constant.
    model.size = math.exp(min(max(np.mean(tops) - EULER, -20.0), 20.0)) if tops else 1e-3
    rows.sort(key=lambda r: (r["label"], r["n"], r["segments"]))
    x = np.array([_measures([(0, 0, s) for s in r["segments"]], r["n"], model) for r in rows])
    model.document = logistic(x, np.array([float(r["label"]) for r in rows]))
    return model


def scored(docs: DataFrame, model: Tox, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher is more toxic), ``predicted`` and the toxic ``passages``.

    A passage is a maximal scoring segment with an expected number of chance finds under 0.05 in clean
    text of that length: its first and last word (from 0), its score and that number. Whole texts are
    scored; null and empty texts, which hold no segment, get the score of a text without any. Rows are
    judged one by one, other columns are passed on.
    """

    def score(texts: list[str | None]) -> list[pa.Array]:
        m, table = model, tables.setdefault(0, Scores(model.odds))
        x, passages = np.empty((len(texts), 3)), []
        for i, t in enumerate(texts):
            values = token_scores(t, table)
            found = segments(values)
            x[i] = _measures(found, len(values), m)
            chance = m.size * max(len(values), 1)
            expected = [(a, b - 1, s, chance * math.exp(-m.rate * s)) for a, b, s in found]
            passages.append([dict(zip(("first", "last", "score", "expected"), p, strict=True)) for p in expected if p[3] < 0.05])
        value = 1 / (1 + np.exp(-np.clip(m.document[0] + x @ m.document[1:], -30, 30)))
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
        return [pa.array(value), pa.array((value >= 0.5).astype(np.int32)), pa.array(passages, kind)]

    tables: dict[int, Scores] = {}
    added = "score double, predicted int, passages array<struct<first:bigint,last:bigint,score:double,expected:double>>"
    return with_columns_from(docs, text, added, score)


def without_toxic(docs: DataFrame, model: Tox) -> DataFrame:
    """The rows of ``docs`` that the model does not take for toxic, with the columns they had, whatever their names."""
    return kept_by(docs, lambda rows: scored(rows, model), ADDED, "predicted = 0")

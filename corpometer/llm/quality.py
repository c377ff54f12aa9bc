"""Line quality by a linear-chain conditional random field, and document quality from its marginals."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpometer.llm.common import kept_by, labelled_sample, with_columns_from
from corpometer.session import stored

FIT_ROWS = 6_000
FIT_LINES = 1_000_000
ROUNDS = 3
STEPS = 120

ADDED = ("score", "predicted")

LETTER, UPPER, DIGIT, SPACE, STOP, BANG, SYMBOL, HIGH = range(8)


def _classes() -> np.ndarray:
    table = np.full(256, SYMBOL, dtype=np.uint8)
    table[128:] = HIGH
    table[ord("a") : ord("z") + 1] = LETTER
    table[ord("A") : ord("Z") + 1] = UPPER
    table[ord("0") : ord("9") + 1] = DIGIT
    for c in " \t\r\x0b\x0c":
        table[ord(c)] = SPACE
    for c in ".,;:'\"-?()":
        table[ord(c)] = STOP
    table[ord("!")] = BANG
    return table


CLASSES = _classes()
# Upper borders of the bins of each measure of a line.
BORDERS = (
    (0, 0.02, 0.1, 0.3),  # symbols by bytes that are not space
    (0, 0.05, 0.2, 0.5),  # capitals by ASCII letters
    (0, 0.05, 0.2),  # digits
    (0, 0.02, 0.1),  # exclamation marks
    (0, 0.01, 0.03, 0.06, 0.1),  # stops
    (2, 4, 5, 6, 7, 8, 10),  # bytes of a word
    (1, 3, 7, 15, 31, 63),  # words
    (0, 0.05, 0.2),  # bytes beyond ASCII
    (0, 1),  # equal to neither, one or both neighbours
    (0, 0.05, 0.2, 0.5),  # words equal to the word before
)
OFFSETS = np.cumsum([0, *(len(b) + 1 for b in BORDERS)])
WIDTH = int(OFFSETS[-1])


@dataclass
class Lines:
    """Lines of several texts in a row: bins of each line, its size in bytes, and where texts start."""

    bins: np.ndarray
    sizes: np.ndarray
    starts: np.ndarray


def lines_of(texts: list[str | None]) -> Lines:
    """Lines with anything but white space in them; a null or empty text has none."""
    raw, counts = [], []
    for text in texts:
        own = [x for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n") if x.strip()]
        raw += own
        counts.append(len(own))
    starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    if not raw:
        return Lines(np.zeros((0, len(BORDERS)), np.int16), np.zeros(0), starts)
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    kinds = CLASSES[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    count = {k: np.add.reduceat((kinds == k).view(np.int8), begins, dtype=np.int32) for k in (UPPER, DIGIT, SPACE, STOP, BANG, SYMBOL, HIGH)}
    first = kinds != SPACE
    first[1:] &= kinds[:-1] == SPACE
    first[begins] = kinds[begins] != SPACE
    words = np.add.reduceat(first.view(np.int8), begins, dtype=np.int32)
    full = np.maximum(sizes - count[SPACE], 1)
    letters = np.maximum(full - count[DIGIT] - count[STOP] - count[BANG] - count[SYMBOL] - count[HIGH], 1)
    same = np.fromiter((a == b for a, b in zip(raw, raw[1:], strict=False)), dtype=bool, count=len(raw) - 1)
    same[starts[(starts > 0) & (starts < len(raw))] - 1] = False
    twins = np.zeros(len(raw))
    twins[1:] += same
    twins[:-1] += same
    again = np.fromiter((sum(map(eq, w := x.split(), w[1:])) for x in raw), dtype=np.int64, count=len(raw))
    measures = (
        count[SYMBOL] / full, count[UPPER] / letters, count[DIGIT] / full, count[BANG] / full, count[STOP] / full,
        full / np.maximum(words, 1), words, count[HIGH] / full, twins, again / np.maximum(words, 1),
    )
    bins = [np.searchsorted(b, m, side="left") + o for b, m, o in zip(BORDERS, measures, OFFSETS, strict=False)]
    return Lines(np.stack(bins, axis=1).astype(np.int16), sizes.astype(np.float64), starts)


@dataclass
class LineField:
    """Weights of state *bad* against *good*: of a line's own bins and its neighbours', and of transitions."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    edge: np.ndarray  # bias, first line, last line
    turns: np.ndarray  # 2 x 2
    document: np.ndarray | None = None  # intercept and weights of the document's logistic curve

    def potentials(self, lines: Lines) -> np.ndarray:
        first, last = _ends(lines)
        score = self.own[lines.bins].sum(1) + self.edge[0] + self.edge[1] * first + self.edge[2] * last
        before, after = self.before[lines.bins].sum(1), self.after[lines.bins].sum(1)
        score[1:] += np.where(first[1:], 0, before[:-1])
        score[:-1] += np.where(last[:-1], 0, after[1:])
        return score


def _ends(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    n = len(lines.sizes)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    held = lines.starts[:-1] < lines.starts[1:]
    first[lines.starts[:-1][held]] = True
    last[lines.starts[1:][held] - 1] = True
    return first, last


def forward_backward(field: LineField, lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """P(bad) of every line, and P(state, next state) of every line that has a next one, else zeros.

    Texts are walked in step, the longest first, so each step is one array operation.
    """
    n = len(lines.sizes)
    marginal, pair = np.zeros(n), np.zeros((n, 2, 2))
    if not n:
        return marginal, pair
    score = field.potentials(lines)
    lengths = np.diff(lines.starts)
    order = np.argsort(-lengths, kind="stable")
    begins, lengths = lines.starts[:-1][order], lengths[order]
    active = [int(x) for x in np.searchsorted(-lengths, -np.arange(lengths[0] + 1), side="left")]
    turns = np.exp(field.turns)
    # Probabilities rescaled at each step, with the larger potential as one, so nothing overflows.
    emit = np.stack([np.exp(-np.maximum(score, 0)), np.exp(np.minimum(score, 0))], axis=1)
    forward, backward = np.empty((n, 2)), np.ones((n, 2))
    now = emit[begins[: active[0]]]
    for t in range(int(lengths[0])):
        k = active[t]
        at = begins[:k] + t
        if t:
            now = (now[:k] @ turns) * emit[at]
        now = now / now.sum(1, keepdims=True)
        forward[at] = now
    for t in range(int(lengths[0]) - 2, -1, -1):
        at = begins[: active[t + 1]] + t
        new = (backward[at + 1] * emit[at + 1]) @ turns.T
        backward[at] = new / new.sum(1, keepdims=True)
        both = forward[at][:, :, None] * turns * (emit[at + 1] * backward[at + 1])[:, None, :]
        pair[at] = both / both.sum((1, 2), keepdims=True)
    joint = forward * backward
    return joint[:, 1] / joint.sum(1), pair


def _step(field: LineField, lines: Lines, bad: np.ndarray, moment: list[np.ndarray], t: int, rate: float, ridge: float) -> None:
    """One Adam step on the log-likelihood of the given states; the gradient is seen minus expected."""
    marginal, pair = forward_backward(field, lines)
    first, last = _ends(lines)
    gap = (bad - marginal) / len(bad)
    own = _spread(lines.bins, gap)
    before = _spread(lines.bins[:-1], np.where(first[1:], 0, gap[1:]))
    after = _spread(lines.bins[1:], np.where(last[:-1], 0, gap[:-1]))
    state = bad.astype(int)
    seen = np.zeros((2, 2))
    np.add.at(seen, (state[:-1][~last[:-1]], state[1:][~last[:-1]]), 1.0)
    grads = [own, before, after, np.array([gap.sum(), gap[first].sum(), gap[last].sum()]), (seen - pair.sum(0)) / len(bad)]
    for i, (weight, grad) in enumerate(zip((field.own, field.before, field.after, field.edge, field.turns), grads, strict=True)):
        grad = grad - ridge * weight
        moment[2 * i] = 0.9 * moment[2 * i] + 0.1 * grad
        moment[2 * i + 1] = 0.99 * moment[2 * i + 1] + 0.01 * grad**2
        weight += rate * (moment[2 * i] / (1 - 0.9**t)) / (np.sqrt(moment[2 * i + 1] / (1 - 0.99**t)) + 1e-8)


def _spread(bins: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.bincount(bins.ravel(), weights=np.repeat(values, bins.shape[1]), minlength=WIDTH)


def document_measures(field: LineField, lines: Lines) -> np.ndarray:
    """Per text: the log-odds of the length-weighted share of bad lines, and the log of their bytes."""
    marginal, _ = forward_backward(field, lines)
    texts = len(lines.starts) - 1
    owner = np.repeat(np.arange(texts), np.diff(lines.starts))
    bad, size = (np.bincount(owner, weights=w, minlength=texts) for w in (marginal * lines.sizes, lines.sizes))
    share = (np.maximum(bad, 0) + 1e-3) / (size + 2e-3)
    return np.stack([np.log(share / np.maximum(1 - share, 1e-9)), np.log1p(np.maximum(bad, 0))], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Intercept and weights of a logistic curve by Newton steps."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += np.clip(step, -5, 5)
    return w


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, max_rows: int = FIT_ROWS,
        max_lines: int = FIT_LINES) -> LineField:
    """Learn from documents labelled by ``quality`` outside the held-out fold.

    Labels are of documents: all lines of a good one are good; of a bad one, those that the model of
    the round before finds bad, at least one. Texts of at most about ``max_rows`` labelled rows, drawn
    by a hash of the id, are used, however long they are; only bins of their lines come to the driver. If
    these are more than ``max_lines`` in all, texts are left out in the order of a hash until they are not.
    Without labels every text is taken for good.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, bytes, bytes]] = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = lines_of([text])
                bins = lines.bins.tobytes()
                out.append((crc32(bins), len(lines.sizes), label, bins, lines.sizes.tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["code", "n", "label", "bins", "sizes"])

    sample = labelled_sample(docs, labels, "quality", folds, held_out, max_rows)
    found = stored(sample.mapInArrow(gather, "code long, n long, label int, bins binary, sizes binary"), "line-bins")
    held, last = 0, -1
    for code, n in sorted((r["code"], r["n"]) for r in found.select("code", "n").toArrow().to_pylist()):
        held += n
        last = code if held <= max_lines else last
    rows = found.where(F.col("code") <= last).toArrow().to_pylist()
    rows.sort(key=lambda r: (r["label"], r["bins"]))
    sizes = [np.frombuffer(r["sizes"]) for r in rows]
    bins = [np.frombuffer(r["bins"], dtype=np.int16).reshape(-1, len(BORDERS)) for r in rows]
    field = LineField(np.zeros(WIDTH), np.zeros(WIDTH), np.zeros(WIDTH), np.zeros(3), np.zeros((2, 2)))
    good = np.array([r["label"] for r in rows], dtype=float)
    if len(rows) and good.min() == 1.0 or not len(rows) or not sum(map(len, sizes)):
        field.document = np.array([4.0, 0.0, 0.0])
        return field
    lines = Lines(np.concatenate(bins), np.concatenate(sizes), np.concatenate([[0], np.cumsum([len(s) for s in sizes])]))
    owner = np.repeat(np.arange(len(rows)), np.diff(lines.starts))
    bad = 1.0 - good[owner]
    moment: list[np.ndarray] = [np.zeros_like(w) for w in (field.own, field.before, field.after, field.edge, field.turns) for _ in (0, 1)]
    t = 0
    for turn in range(ROUNDS):
        for _ in range(STEPS):
            t += 1
            _step(field, lines, bad, moment, t, rate=0.1 if turn < ROUNDS - 1 else 0.05, ridge=1e-4)
        if turn < ROUNDS - 1:
            marginal, _ = forward_backward(field, lines)
            top = np.zeros(len(rows))
            np.maximum.at(top, owner, marginal)
            bad = ((good[owner] == 0) & ((marginal > 0.5) | (marginal >= top[owner]))).astype(float)
    field.document = logistic(document_measures(field, lines), good)
    return field


def score_texts(field: LineField, texts: list[str | None]) -> np.ndarray:
    """P(quality 1) of each text; a text without a line gets 0."""
    lines = lines_of(texts)
    w = field.document
    value = 1 / (1 + np.exp(-np.clip(w[0] + document_measures(field, lines) @ w[1:], -30, 30)))
    return np.where(np.diff(lines.starts) == 0, 0.0, value)


def line_labels(field: LineField, text: str | None) -> list[tuple[str, float]]:
    """The lines of one text that hold more than white space, with P(bad) of each."""
    raw = [x for x in (text or "").split("\n") if x.encode("utf-8", "surrogatepass").strip()]
    marginal, _ = forward_backward(field, lines_of([text]))
    return list(zip(raw, marginal.tolist(), strict=True))


def scored(docs: DataFrame, field: LineField, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher is better) and ``predicted`` (1 from 0.5 on).

    Whole texts are scored. Null and empty texts, and texts of white space, score 0. Rows are judged
    one by one: repeated rows get the same score, null ids matter not, other columns are passed on.
    """

    def score(texts: list[str | None]) -> list[pa.Array]:
        value = score_texts(field, texts)
        return [pa.array(value), pa.array((value >= 0.5).astype(np.int32))]

    return with_columns_from(docs, text, "score double, predicted int", score)


def without_low_quality(docs: DataFrame, field: LineField) -> DataFrame:
    """The rows of ``docs`` that the model accepts, with the columns they had, whatever their names."""
    return kept_by(docs, lambda rows: scored(rows, field), ADDED, "predicted = 1")

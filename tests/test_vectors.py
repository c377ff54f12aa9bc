"""Factored word vectors and the view that keeps neighbours, against numpy on small tables."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpometer.functions import text as T
from corpometer.plans import factors, layout

WORDS = [f"w{i}" for i in range(40)]


def texts(seed=3, n=60):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS[(i % 4) * 10 : (i % 4) * 10 + 12] if i % 4 < 3 else WORDS) for _ in range(rng.randrange(30))) for i in range(n)]


def plain_information(lists, window):
    n = Counter()
    for ids in lists:
        for d in range(1, window + 1):
            for a, b in zip(ids, ids[d:]):
                n[a, b] += 1
                n[b, a] += 1
    rows = Counter()
    for (a, _), c in n.items():
        rows[a] += c
    whole = sum(rows.values())
    found = {(a, b): math.log(c * whole / (rows[a] * rows[b])) for (a, b), c in n.items()}
    return {p: x for p, x in found.items() if x > 0}


@pytest.mark.parametrize("window", [1, 4])
def test_information_equals_plain_python(spark, window):
    rng = random.Random(window)
    lists = [[rng.randrange(12) for _ in range(rng.randrange(15))] for _ in range(40)] + [[], [5], [5, 5, 5, 5, 5, 5]]
    df = spark.createDataFrame([(x,) for x in lists], "input_ids array<bigint>").repartition(5)
    got = {(r.i, r.j): r.x for r in factors.positive_information(factors.co_occurrences(df, window)).collect()}
    want = plain_information(lists, window)
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p], abs=1e-9) for p in want)


def symmetric(n=70, seed=5):
    """A matrix with a few strong directions of either sign, and weak ones below them."""
    axes = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))[0]
    sizes = np.zeros(n)
    sizes[:14] = [100, -80, 60, 45, -33, 25, 18, 12, 2, -1.5, 1, 0.7, 0.5, 0.3]
    return axes @ np.diag(sizes) @ axes.T


def entries(x):
    return [(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))]


def test_factors_come_near_the_best_ones(spark):
    x = symmetric()
    best, vectors = np.linalg.eigh(x)
    order = np.argsort(-np.abs(best))[:8]
    optimum = np.linalg.norm(x - vectors[:, order] @ np.diag(best[order]) @ vectors[:, order].T)
    found = []
    for parts, hot in ((2, 20_000), (9, 5)):
        table = factors.stored(spark.createDataFrame(entries(x), "i bigint, j bigint, x double").repartition(parts), "test-table")
        rows, values = factors.factored(table, 8, extra=8, hot_rows=hot)
        v = np.zeros((len(x), 8))
        for r in rows.collect():
            v[r.i] = r.v
        assert np.allclose(v.T @ v, np.eye(8), atol=1e-8)
        assert np.allclose(values, best[order], rtol=0.02)
        assert np.linalg.norm(x - v @ np.diag(values) @ v.T) < 1.01 * optimum
        found.append(v)
    assert np.allclose(found[0], found[1], atol=1e-6)


def test_entries_in_parts_give_the_same_factors(spark, monkeypatch):
    table = factors.stored(spark.createDataFrame(entries(symmetric(30)), "i bigint, j bigint, x double"), "test-table")
    found = []
    for most in (1_000_000, 200):
        monkeypatch.setattr(factors, "PART_ENTRIES", most)
        rows, values = factors.factored(table, 5, extra=8)
        found.append((np.array([r.v for r in sorted(rows.collect())]), values))
    assert np.allclose(found[0][0], found[1][0], atol=1e-6) and np.allclose(found[0][1], found[1][1])


def test_texts_keep_their_tokens_together(spark, monkeypatch):
    df = spark.createDataFrame([*enumerate(texts())], "doc_id int, text string").repartition(2)
    words = factors.stored(spark.createDataFrame([(f"w{k}", [float(k), 1.0], 5) for k in range(60)], "token string, vector array<double>, cf bigint"))
    rows, stored = [], factors.stored
    monkeypatch.setattr(factors, "stored", lambda df, name: rows.append(df.count()) or stored(df, name))
    # What is moved or stored of a text is one row, until it meets the vectors.
    assert factors.text_vectors(df, T.space_tokens("text"), words, 2).count() == len(texts()) and max(rows) <= len(texts())


def test_a_table_of_low_rank(spark):
    table = factors.stored(spark.createDataFrame([(0, 1, 2.0), (1, 0, 2.0)], "i bigint, j bigint, x double"), "test-table")
    rows, values = factors.factored(table, 3, extra=2)
    v = np.array([r.v for r in sorted(rows.collect())])
    assert np.allclose(v @ np.diag(values) @ v.T, [[0, 2], [2, 0]], atol=1e-8)


def test_words_of_one_subject_are_near(spark):
    df = spark.createDataFrame([*enumerate(texts()), (900, ""), (901, None), (902, "nowhere")], "doc_id int, text string").repartition(6)
    tokens = T.space_tokens("text")
    words = factors.word_vectors(df, tokens, min_count=2, width=6)
    held = {r.token: np.array(r.vector) for r in words.collect()}
    counts = Counter(w for t in texts() for w in t.split())
    assert held.keys() == {w for w, c in counts.items() if c >= 2}
    unit = {w: v / np.linalg.norm(v) for w, v in held.items()}
    same = np.mean([unit["w3"] @ unit[w] for w in ("w4", "w5", "w6")])
    other = np.mean([unit["w3"] @ unit[w] for w in ("w24", "w25", "w26")])
    assert same > other + 0.2
    for hot in (20_000, 3):
        got = {r.doc_id: np.array(r.embedding) for r in factors.text_vectors(df, tokens, words, 6, hot_rows=hot).collect()}
        assert len(got) == 63 and not got[900].any() and not got[901].any() and not got[902].any()
        for i, t in enumerate(texts()):
            known = [held[w] for w in t.split() if w in held]
            assert np.allclose(got[i], np.mean(known, axis=0) if known else 0, atol=1e-5)


def clusters(n=400, seed=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 20)) * 4
    return np.array([centres[i % 12] + rng.normal(size=20) for i in range(n)])


def test_view_keeps_more_neighbours_than_components_do(spark):
    x = clusters()
    rows = [(i, "a", [float(v) for v in r]) for i, r in enumerate(x)] + [(900, "b", None), (901, "b", [float(v) for v in x[0]])]
    df = spark.createDataFrame(rows, "vec_id int, corpus string, embedding array<float>").repartition(5)
    for most in (2_000, 300):
        got = {r.vec_id: r for r in layout.neighbour_view(df, keep=("corpus",), most=most).collect()}
        assert len(got) == 401 and 900 not in got and got[901].corpus == "b"
        assert (got[901].x, got[901].y) == pytest.approx((got[0].x, got[0].y))
        y = np.array([[got[i].x, got[i].y] for i in range(len(x))])
        assert layout.neighbour_recall(x, y) > 1.2 * layout.neighbour_recall(x, layout.principal(x))
    again = {r.vec_id: (r.x, r.y) for r in layout.neighbour_view(df.repartition(3), most=300).collect()}
    assert all(again[i] == pytest.approx((got[i].x, got[i].y)) for i in again)


def test_views_of_few_rows(spark):
    for n in (0, 1, 2, 3):
        df = spark.createDataFrame([(i, [float(i), 1.0, 0.0]) for i in range(n)], "vec_id int, embedding array<float>")
        got = layout.neighbour_view(df).collect()
        assert len(got) == n and all(math.isfinite(r.x) and math.isfinite(r.y) for r in got)
    assert layout.neighbour_view(df.where(F.lit(False))).count() == 0


def test_long_texts_are_counted_in_parts_and_groups(spark, monkeypatch):
    texts = [[int(x) for x in np.random.default_rng(7).integers(0, 30, 400)], [5, 5, 9], [3], [], None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, input_ids array<bigint>").coalesce(1)
    whole = Counter()
    for t in texts:
        for d in range(1, 5):
            for a, b in zip(t or [], (t or [])[d:]):
                whole[a, b] += 1
                whole[b, a] += 1
    monkeypatch.setattr(factors, "GROUP_PAIRS", 100)
    near = factors._near(4, 7)
    monkeypatch.setattr(factors, "COUNTED", 16)
    parts = list(near(iter(df.select("input_ids").toArrow().to_batches())))
    assert len(parts) >= 25  # no more than 16 tokens at once
    assert all(len(set(p.column("part").to_pylist())) == p.num_rows for p in parts)
    found = factors.co_occurrences(df)
    assert {(r.i, r.j): r.n for r in found.collect()} == whole

"""Measures against hand-worked values and brute force."""

import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpometer.functions import text as T
from corpometer.operators import bags, coherence, density, distance, kneser_ney, reports, stats, timing, windows
from corpometer.operators import language_model as lm
from corpometer.session import stored

relaxed = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def docs_of(spark, texts):
    return spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(texts)], "doc_id bigint, corpus string, text string")


def test_corpus_stats_by_hand(spark):
    df = docs_of(spark, [("r", "a A b"), ("r", "c"), ("one", "a"), ("none", ""), ("gone", None)])
    got = {r["corpus"]: r for r in stats.corpus_stats(df).collect()}
    assert set(got) == {"r", "one", "none"}
    assert (got["r"]["n_docs"], got["r"]["avg_len_tokens"], got["r"]["std_len_tokens"]) == (2, 2.0, 1.0)
    assert got["r"]["ttr"] == 0.75 and got["r"]["hapax_ratio"] == pytest.approx(2 / 3)
    assert got["r"]["avg_len_chars"] == 3.0 and got["one"]["std_len_tokens"] == 0.0
    assert (got["none"]["n_tokens"], got["none"]["ttr"]) == (0, 0.0)
    assert sorted(stats.length_stats(df).where("corpus = 'r'").first()[1:]) == [1.0, 2, 2.0, 3.0]


def test_token_stats_cut_documents(spark):
    df = docs_of(spark, [("r", "x " * 5000)])
    assert stats.token_stats(df, max_length=4096).first()["n_tokens"] == 4096
    assert stats.token_stats(df).first()["n_tokens"] == 5000


def test_document_frequency_limits(spark):
    df = docs_of(spark, [("r", t) for t in ("a b", "a b b", "a c", "a c", "d")])
    freq = stats.document_frequency(df, T.space_tokens("text"))
    assert {r["token"]: (r["df"], r["cf"]) for r in freq.collect()} == {"a": (4, 4), "b": (2, 3), "c": (2, 2), "d": (1, 1)}
    kept = stats.frequent_tokens(freq, stats.documents_per_corpus(df), no_below=2, no_above=0.5)
    assert {r["token"] for r in kept.collect()} == {"b", "c"}


def test_bags_and_ids(spark):
    df = docs_of(spark, [("r", "a b a"), ("r", "z"), ("r", "b")])
    counts = stats.token_counts(df).select("token", F.col("n").alias("cf")).where("token <> 'z'")
    ids = bags.dictionary(counts)
    code = {r["token"]: r["token_id"] for r in ids.collect()}
    assert sorted(code.values()) == [0, 1]
    coded = {r["doc_id"]: r["input_ids"] for r in bags.encode(df, T.space_tokens("text"), ids).collect()}
    assert coded == {0: [code["a"], code["b"], code["a"]], 1: [], 2: [code["b"]]}
    bag = {r["doc_id"]: [tuple(b) for b in r["bag"]] for r in bags.bags_of_words(df, T.space_tokens("text"), ids).collect()}
    assert bag == {0: sorted([(code["a"], 2), (code["b"], 1)]), 2: [(code["b"], 1)]}


def test_tfidf_has_unit_length(spark):
    df = docs_of(spark, [("r", "aa bb aa"), ("r", "bb cc")])
    got = {(r["doc_id"], r["token"]): r["weight"] for r in bags.tfidf(df, T.tfidf_tokens("text"), 10).collect()}
    rare, common = math.log(3 / 2) + 1, 1.0
    size = math.hypot(2 * rare, common)
    assert got[(0, "aa")] == pytest.approx(2 * rare / size) and got[(0, "bb")] == pytest.approx(common / size)


def brute_windows(tokens, width):
    starts = range(max(1, len(tokens) - width + 1))
    return [set(tokens[s : s + width]) for s in starts]


@relaxed
@given(
    st.lists(st.lists(st.sampled_from("abcdx"), min_size=0, max_size=40), min_size=1, max_size=6),
    st.integers(1, 9),
)
def test_window_counts_equal_brute_force(spark, token_lists, width):
    df = spark.createDataFrame([(i, "r", t) for i, t in enumerate(token_lists)], "doc_id bigint, corpus string, tokens array<string>")
    single, double, total = Counter(), Counter(), 0
    for tokens in token_lists:
        for window in brute_windows(tokens, width):
            total += 1
            found = sorted(window & set("abcd"))
            single.update(found)
            double.update(combinations(found, 2))
    words = spark.createDataFrame([("r", w) for w in "abcd"], "corpus string, word string")
    pairs = spark.createDataFrame([("r", a, b) for a, b in combinations("abcd", 2)], "corpus string, word_a string, word_b string")
    found = windows.word_intervals(df, F.col("tokens"), words, width)
    assert {r["word"]: r["n"] for r in windows.word_windows(found).collect()} == dict(single)
    for block in (3, 2048):
        got = windows.pair_windows(found, pairs, block=block).collect()
        assert {(r["word_a"], r["word_b"]): r["n"] for r in got} == dict(double)
    assert windows.window_totals(df, F.col("tokens"), width).first()["n_windows"] == total


def test_coherence_equals_formula(spark):
    token_lists = [list("abacdxbxxa"), list("bcd"), list("xxxxxx"), list("acacxxdb")]
    width, words = 3, list("abc")
    all_windows = [w for t in token_lists for w in brute_windows(t, width)]
    n = len(all_windows)

    def p(*ws):
        return sum(all(w in win for w in ws) for win in all_windows) / n

    npmi = np.array([[math.log((p(a, b) + 1e-12) / (p(a) * p(b))) / -math.log(p(a, b) + 1e-12) for b in words] for a in words])
    whole = npmi.sum(axis=0)
    want = np.mean([v @ whole / (np.linalg.norm(v) * np.linalg.norm(whole)) for v in npmi])
    df = spark.createDataFrame([(i, "r", t) for i, t in enumerate(token_lists)], "doc_id bigint, corpus string, tokens array<string>")
    topics = spark.createDataFrame([("r", 0, w) for w in words], "corpus string, topic bigint, word string")
    got = coherence.coherence(df, F.col("tokens"), topics, width).first()["c_v"]
    assert got == pytest.approx(want, abs=1e-9)
    kept = coherence.coherence(df, F.col("tokens"), topics, width, skip_irrelevant=True).first()["c_v"]
    assert kept != pytest.approx(want, abs=1e-6)


def test_coherence_with_an_unseen_word(spark):
    df = spark.createDataFrame([(0, "r", ["a", "b"])], "doc_id bigint, corpus string, tokens array<string>")
    topics = spark.createDataFrame([("r", 0, w) for w in ("a", "b", "gone")], "corpus string, topic bigint, word string")
    assert coherence.coherence(df, F.col("tokens"), topics).first()["c_v"] == pytest.approx(2 / 3)


def brute_w1(a, b):
    points = sorted(set(a) | set(b))
    total = 0.0
    for x, y in zip(points, points[1:]):
        total += abs(sum(v <= x for v in a) / len(a) - sum(v <= x for v in b) / len(b)) * (y - x)
    return total


numbers = st.lists(st.one_of(st.integers(-3, 3).map(float), st.floats(-1e6, 1e6)), min_size=1, max_size=25)


@relaxed
@given(numbers, numbers)
def test_wasserstein_equals_brute_force(spark, a, b):
    df = spark.createDataFrame([("real", v) for v in a] + [("synthetic", v) for v in b], "corpus string, value double")
    got = distance.wasserstein_1d(df, "real", ["synthetic"]).first()["distance"]
    assert got == pytest.approx(brute_w1(a, b), rel=1e-9, abs=1e-9)
    back = distance.wasserstein_1d(df, "synthetic", ["real"]).first()["distance"]
    assert back == pytest.approx(got, rel=1e-9, abs=1e-9)


def test_wasserstein_of_shifted_and_equal_sets(spark):
    data = [("real", float(i)) for i in range(9)] + [("same", float(i)) for i in range(9)] + [("moved", i + 2.5) for i in range(9)]
    df = spark.createDataFrame(data, "corpus string, value double")
    got = {r["corpus"]: r["distance"] for r in distance.wasserstein_1d(df, "real", ["same", "moved"]).collect()}
    assert got["same"] == 0.0 and got["moved"] == pytest.approx(2.5)


def test_sliced_wasserstein_equals_numpy(spark):
    rng = np.random.default_rng(0)
    real, made = rng.normal(size=(40, 5)).astype("float32"), rng.normal(0.5, size=(30, 5)).astype("float32")
    rows = [("real", v.tolist()) for v in real] + [("synthetic", v.tolist()) for v in made]
    df = spark.createDataFrame(rows, "corpus string, embedding array<float>")
    dists = distance.sliced_distances(df, 5, n_projections=6, seed=42)
    got = distance.sliced_wasserstein(dists).first()
    gen = np.random.default_rng(42)
    want = []
    for _ in range(6):
        u = gen.normal(size=(5, 1))
        u /= np.linalg.norm(u) + 1e-12
        want.append(brute_w1((real @ u).ravel().tolist(), (made @ u).ravel().tolist()))
    assert got["distances"] == pytest.approx(want) and got["mean_distance"] == pytest.approx(np.mean(want))
    coarse = distance.sliced_wasserstein(distance.sliced_distances(df, 5, n_projections=6, resolution=0.05)).first()
    assert coarse["distances"] == pytest.approx(want, abs=0.05)


@relaxed
@given(st.lists(st.tuples(st.integers(0, 1), st.one_of(st.sampled_from([0.1, 0.5]), st.floats(0, 1))), min_size=2, max_size=40))
def test_auc_equals_brute_force(spark, pairs):
    up = [s for y, s in pairs if y == 1]
    down = [s for y, s in pairs if y == 0]
    df = spark.createDataFrame(pairs, "label int, score double")
    got = reports.roc_auc(df).first()["roc_auc"]
    if not up or not down:
        assert got is None
        return
    want = sum((u > d) + 0.5 * (u == d) for u in up for d in down) / (len(up) * len(down))
    assert got == pytest.approx(want)
    flipped = reports.roc_auc(df.withColumn("score", -F.col("score"))).first()["roc_auc"]
    assert flipped == pytest.approx(1 - want)


def test_class_report_by_hand(spark):
    pairs = [(0, 0)] * 3 + [(0, 1)] + [(1, 1)] * 2 + [(1, 0)] * 2
    df = spark.createDataFrame(pairs, "label int, prediction int")
    got = {r["name"]: r for r in reports.class_report(reports.confusion(df), {0: "real", 1: "synthetic"}).collect()}
    assert got["real"]["precision"] == pytest.approx(0.6) and got["real"]["recall"] == 0.75
    assert got["synthetic"]["f1"] == pytest.approx(2 * (2 / 3) * 0.5 / (2 / 3 + 0.5))
    assert got["accuracy"]["f1"] == 0.625 and got["weighted avg"]["support"] == 8


def test_bigram_losses_by_hand(spark):
    df = docs_of(spark, [("real", "a b a b"), ("real", "c"), ("synthetic", "a b z a"), ("synthetic", "q")])
    size = 4  # a, b, c and one for unknown tokens

    def loss(pair, context):
        return -math.log((pair + 0.5) / (context + 0.5 * size))

    want = {"real": 2 * loss(2, 2) + loss(1, 1), "synthetic": loss(2, 2) + loss(0, 1) + loss(0, 0)}
    got = {r["corpus"]: r for r in lm.corpus_losses(df, T.space_tokens("text"), "real", 0.5).collect()}
    for corpus, nll in want.items():
        assert got[corpus]["nll"] == pytest.approx(nll) and got[corpus]["n_tokens"] == 3
    each = {r["doc_id"]: r for r in lm.document_losses(df, T.space_tokens("text"), "real", 0.5).collect()}
    assert each[0]["nll"] == pytest.approx(want["real"]) and (each[1]["nll"], each[1]["n_tokens"]) == (0.0, 0)
    assert each[2]["nll"] == pytest.approx(want["synthetic"]) and len(each) == 4


def test_bigram_losses_do_not_follow_the_number_of_parts(spark, monkeypatch):
    rows = [("real" if i % 3 else "made", i // 2, " ".join(f"w{(i * j) % 17}" for j in range(i))) for i in range(40)]
    rows += [("real", 1, "alone"), (None, 2, "w1 w2"), ("made", None, "w1 w2"), ("void", 3, None), ("made", 99, "new words new words")]
    df = spark.createDataFrame(rows, "corpus string, doc_id int, text string")
    losses = lambda: sorted((str(r.corpus), str(r.doc_id), r.n_tokens, round(r.nll, 8)) for r in lm.document_losses(df, T.space_tokens("text"), "real").collect())
    once, files = losses(), []
    trained = [t.split() for c, _, t in rows if c == "real"]
    pairs, context = Counter(p for t in trained for p in zip(t, t[1:], strict=False)), Counter(w for t in trained for w in t[:-1])
    size, want = len({w for t in trained for w in t}) + 1, defaultdict(float)
    for c, i, t in rows:
        for a, b in zip((t or "").split(), (t or "").split()[1:], strict=False):
            want[c, i] -= math.log((pairs[a, b] + 0.1) / (context[a] + 0.1 * size))
    assert once == sorted((str(c), str(i), n * (c is not None and i is not None), round(want[c, i] * (c is not None and i is not None), 8)) for c, i, n in [
        (c, i, sum(max(len((u or "").split()) - 1, 0) for d, j, u in rows if (d, j) == (c, i))) for c, i, _ in rows])
    monkeypatch.setattr(kneser_ney, "PART_WORDS", 200)
    monkeypatch.setattr(lm, "stored", lambda table, name="stage": files.append(name) or stored(table, name))
    assert losses() == once and files.count("training-bigrams") > 2


def test_perplexity_and_batch_means(spark):
    df = spark.createDataFrame([("r", 0, 2.0, 2), ("r", 0, 4.0, 1), ("r", 1, 6.0, 6), ("r", 2, 0.0, 0)], "corpus string, batch_id int, nll double, n_tokens int")
    assert lm.perplexity(df).first()["perplexity"] == pytest.approx(math.exp(12 / 9))
    assert lm.mean_batch_loss(df).first()["loss"] == pytest.approx((2.0 + 1.0) / 2)
    assert lm.mean_batch_loss(df, average="micro").first()["loss"] == pytest.approx(12 / 9)
    empty = df.where("batch_id = 2")
    assert lm.perplexity(empty).first()["perplexity"] is None


def test_density_integrates_to_one(spark):
    values = [1.0, 2.0, 2.0, 5.0, 9.0]
    df = spark.createDataFrame([("r", v) for v in values], "corpus string, value double")
    curve = density.density_curve(density.value_counts(df, "value"), points=400).toPandas().sort_values("x")
    h = np.std(values, ddof=1) * len(values) ** -0.2
    want = [np.mean(np.exp(-0.5 * ((x - np.array(values)) / h) ** 2)) / (h * math.sqrt(2 * math.pi)) for x in curve["x"]]
    assert np.allclose(curve["density"], want)
    assert np.trapezoid(curve["density"], curve["x"]) == pytest.approx(1, abs=0.01)
    clipped = density.density_curve(density.value_counts(df, "value"), points=9, clip=(0, 4)).toPandas()
    assert clipped["x"].min() == 0 and clipped["x"].max() == 4


def test_density_grid_equals_numpy(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(60, 2)) @ np.array([[1.0, 0.4], [0.0, 0.7]])
    df = spark.createDataFrame([("r", *map(float, p)) for p in points], "corpus string, x double, y double").repartition(3)
    got = density.density_grid(df, points=8).toPandas()
    cov = np.cov(points.T) * len(points) ** (-1 / 3)
    inverse, scale = np.linalg.inv(cov), len(points) * 2 * math.pi * math.sqrt(np.linalg.det(cov))
    for row in got.itertuples():
        off = np.array([row.x, row.y]) - points
        want = np.exp(-0.5 * np.einsum("ij,jk,ik->i", off, inverse, off)).sum() / scale
        assert row.density == pytest.approx(want)
    assert got["level"].min() == 0 and 10 <= got["level"].max() < 20 and len(got) == 64


def test_histogram_and_quantiles(spark):
    values = list(range(10)) + [9, 9]
    df = spark.createDataFrame([("r", float(v)) for v in values] + [("flat", 2.0)], "corpus string, value double")
    counts = density.value_counts(df, "value")
    bins = {(r["corpus"], r["bin"]): r["n"] for r in density.histogram(counts, 3).collect()}
    assert bins == {("r", 0): 3, ("r", 1): 3, ("r", 2): 6, ("flat", 0): 1}
    got = {r["share"]: r["value"] for r in density.length_quantiles(counts.where("corpus = 'r'")).collect()}
    assert got == pytest.approx({s: float(np.quantile(values, s)) for s in (0.05, 0.25, 0.5, 0.75, 0.95)})


def test_timing(spark):
    df = spark.createDataFrame([("m", i, 2.0) for i in range(4)], "model string, batch_id bigint, elapsed_time double")
    assert timing.generation_times(df).first()[1:] == (4, 8.0, 2.0, pytest.approx(2.3148148), 4.0)
    left = {r["batch_id"]: (r["total_time"], r["remaining"], r["seconds_left"]) for r in timing.time_left(df).collect()}
    assert left == {0: (2.0, 3, 6.0), 1: (4.0, 2, 4.0), 2: (6.0, 1, 2.0), 3: (8.0, 0, 0.0)}


def test_pooling_without_mask_gives_zero(spark):
    df = spark.createDataFrame([(1, [2.0, 4.0], 1), (1, [4.0, 8.0], 1), (1, [9.0, 9.0], 0), (2, [5.0, 5.0], 0)], "doc_id int, vector array<float>, mask int")
    got = {(r["doc_id"], r["place"]): r["value"] for r in stats.pooled_vectors(df).collect()}
    assert got == {(1, 0): 3.0, (1, 1): 6.0, (2, 0): 0.0, (2, 1): 0.0}


@pytest.mark.parametrize("hot", [500_000, 40, 3, 0])
def test_token_ids_and_bags_by_any_number_of_hot_tokens(spark, hot):
    rng = random.Random(17)
    words = [f"w{i}" for i in range(30)] + ["é", "seldom"] + [f"rare{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, [60 / (i + 1) for i in range(len(words))], k=rng.randrange(40))) for _ in range(120)] + ["", "nowhere at all", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(5)
    counts = Counter(t for text in texts for t in (text or "").split() if not t.startswith("nowhere"))
    known = {t: i * 7 for i, t in enumerate(sorted(counts)) if t not in ("at", "all", "rare3")}
    ids = spark.createDataFrame([(t, i, counts[t]) for t, i in known.items()], "token string, token_id bigint, cf bigint")
    want = {i: [known[t] for t in (text or "").split() if t in known] for i, text in enumerate(texts)}
    got = bags.encode(df, T.space_tokens("text"), ids, hot_tokens=hot).collect()
    assert {r.doc_id: r.input_ids for r in got} == want and len(got) == len(texts)
    bag = bags.bags_of_words(df, T.space_tokens("text"), ids, hot_tokens=hot).collect()
    assert {r.doc_id: [tuple(b) for b in r.bag] for r in bag} == {i: sorted(Counter(x).items()) for i, x in want.items() if x}
    assert bags.encode(df.limit(0), T.space_tokens("text"), ids, hot_tokens=hot).count() == 0

"""Fitted models on small corpora with a known answer."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import QUERIES
from corpometer.plans import classify, embed, evaluate, prepare, topics


def corpus(words, n, corpus_name, start=0, seed=0):
    pick = random.Random(seed)
    return [(start + i, corpus_name, " ".join(pick.choice(words) for _ in range(30))) for i in range(n)]


FIRST = ["apple", "banana", "cherry", "grape", "melon", "plum", "peach", "mango"]
SECOND = ["engine", "wheel", "brake", "motor", "clutch", "pedal", "tire", "axle"]
SCHEMA = "doc_id bigint, corpus string, text string"


def test_classifier_tells_different_words_apart(spark):
    df = spark.createDataFrame(corpus(FIRST, 60, "real") + corpus(SECOND, 40, "synthetic", 60), SCHEMA)
    result = classify.classify_texts(df)
    scores = result.scores.first()
    assert scores["roc_auc"] == pytest.approx(1.0) and scores["accuracy"] == pytest.approx(1.0)
    assert result.scored.count() == 30
    support = {r["name"]: r["support"] for r in result.report.collect()}
    assert (support["real"], support["synthetic"]) == (18, 12)


def test_classifier_needs_both_sides(spark):
    df = spark.createDataFrame(corpus(FIRST, 20, "real"), SCHEMA)
    with pytest.raises(ValueError, match="Both corpora"):
        classify.classify_texts(df)


def test_embedding_classifier(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "real", rng.normal(0, 1, 6).tolist()) for i in range(50)]
    rows += [(50 + i, "synthetic", rng.normal(2, 1, 6).tolist()) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, corpus string, embedding array<float>")
    result = classify.classify_embeddings(df, cv=2, strengths=(0.1, 1.0))
    assert result.scores.first()["roc_auc"] > 0.9 and result.scored.count() == 20


def test_topics_are_repeatable_and_coherent(spark):
    df = spark.createDataFrame(corpus(FIRST, 30, "r", seed=1) + corpus(SECOND, 30, "r", 30, seed=2), SCHEMA)
    runs = [
        topics.topic_coherence(df, num_topics=2, no_below=2, no_above=0.9, passes=5, top=5, sample_size=50).first()
        for _ in range(2)
    ]
    assert runs[0]["coherence"] == pytest.approx(runs[1]["coherence"]) and -1 <= runs[0]["coherence"] <= 1
    assert runs[0]["found"]["sampled"] and runs[0]["found"]["kept"] == 50 and runs[0]["found"]["terms"] == 16
    whole = topics.topic_coherence(df, num_topics=2, no_below=2, no_above=0.9, passes=1, sample_size=500).first()
    assert not whole["found"]["sampled"]
    tables = topics.topic_coherence(df, num_topics=2, no_below=2, no_above=0.9, passes=5, top=5, learner="tables").first()
    assert tables["found"]["terms"] == 16 and -1 <= tables["coherence"] <= 1 and tables["settings"]["learner"] == "tables"
    with pytest.raises(ValueError, match="learner"):
        topics.topic_coherence(df, learner="other")


def test_coherence_of_nothing(spark):
    df = spark.createDataFrame([(1, "r", "the 12"), (2, "r", None)], SCHEMA)
    row = topics.topic_coherence(df).first()
    assert row["coherence"] is None and row["error"] == "The corpus holds no token"
    rare = topics.topic_coherence(spark.createDataFrame([(1, "r", "apple pear")], SCHEMA)).first()
    assert rare["coherence"] is None and rare["found"]["terms"] == 0 and rare["error"]


def test_word_vectors_and_projection(spark):
    df = spark.createDataFrame(corpus(FIRST, 20, "real") + corpus(SECOND, 20, "synthetic", 20), SCHEMA)
    model = embed.fit_word_vectors(df, width=8, min_count=1)
    vectors = embed.embed_texts(df, model)
    assert {len(r["embedding"]) for r in vectors.collect()} == {8}
    flat = embed.two_dimensions(vectors, "embedding", "doc_id", "corpus")
    assert flat.columns == ["doc_id", "corpus", "x", "y"] and flat.count() == 40


def test_evaluation_report(spark):
    df = spark.createDataFrame(corpus(FIRST, 40, "real") + corpus(SECOND, 30, "synthetic", 40), SCHEMA)
    vectors = df.select("doc_id", "corpus", F.array(F.rand(1), F.rand(2)).alias("embedding"))
    report = evaluate.evaluate(df, sample=25, embeddings=vectors, embedding_width=2, num_topics=2, no_below=2)
    got = {(r["corpus"], r["metric"]): r["value"] for r in report.collect()}
    assert got[("real", "n_docs")] == 40 and got[("synthetic", "n_docs")] == 30
    assert got[("synthetic", "roc_auc")] == pytest.approx(1.0) and ("synthetic", "wasserstein") in got
    assert got[("real", "perplexity")] < got[("synthetic", "perplexity")] and ("real", "coherence") in got
    one = evaluate.evaluate(df, mode="synthetic", skip=("coherence",)).collect()
    assert {r["corpus"] for r in one} == {"synthetic"} and "perplexity" in {r["metric"] for r in one}
    three = {(r["corpus"], r["metric"]): r for r in evaluate.evaluate(df, skip=("stats", "coherence", "classifier"), order=3).collect()}
    assert three[("real", "perplexity")]["value"] < three[("synthetic", "perplexity")]["value"]
    assert '"order":3' in three[("real", "perplexity")]["detail"]
    with pytest.raises(ValueError):
        evaluate.evaluate(df, mode="all")


def test_evaluation_of_three_corpora(spark):
    rows = corpus(FIRST, 60, "real") + corpus(SECOND, 30, "near", 60) + corpus(FIRST, 30, "same", 90, seed=5)
    df = spark.createDataFrame(rows, SCHEMA)
    report = evaluate.evaluate(df, synthetic=("near", "same"), skip=("coherence",)).collect()
    got = {(r["corpus"], r["metric"]): r for r in report}
    assert got[("near", "roc_auc")]["value"] > 0.99 > got[("same", "roc_auc")]["value"]
    assert got[("near", "perplexity")]["value"] > got[("same", "perplexity")]["value"]
    assert got[("real", "perplexity")]["detail"] == '{"train":"real","held_out":0.1}'
    alone = {(r["corpus"], r["metric"]): r["value"] for r in evaluate.evaluate(df, mode="synthetic", synthetic=("near", "same"), skip=("coherence",)).collect()}
    assert alone[("near", "perplexity")] == pytest.approx(got[("near", "perplexity")]["value"]) and ("real", "perplexity") not in alone


def test_limits_of_count_vectors(spark):
    df = spark.createDataFrame([(i, ["common", f"w{i % 3}", f"v{i}"]) for i in range(9)], "doc_id bigint, tokens array<string>")
    terms = lambda **options: set(topics.count_vectors(df, **options)[0].vocabulary)
    assert terms(no_below=2, no_above=1.0) == {"common", "w0", "w1", "w2"}
    assert terms(no_below=0.3, no_above=0.5) == {"w0", "w1", "w2"}
    with pytest.raises(ValueError, match="More than 3 terms"):
        topics.count_vectors(df, no_below=1, no_above=1.0, max_terms=3)


def test_word_vectors_read_whole_texts_and_bound_their_words(spark):
    df = spark.createDataFrame([(1, "r", "head " * 3_000 + "tail tail tail " + "odd " * 2), (2, "r", "head tail")], SCHEMA)
    words = lambda **options: {r["word"] for r in embed.fit_word_vectors(df, width=4, **options).getVectors().collect()}
    assert words(min_count=3) == {"head", "tail"} and words(min_count=1, max_words=2) == {"head", "tail"}


def test_prepared_tables(spark):
    ids = spark.range(30)
    prompts = prepare.prompt_table(ids, "Write about {topic}.")
    first = prompts.orderBy("id").collect()
    assert first == prepare.prompt_table(ids.repartition(3), "Write about {topic}.").orderBy("id").collect()
    assert all(r["prompt"] == f"Write about {r['topic']}." for r in first) and len({r["uuid"] for r in first}) == 30
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(150))), (2, "short text")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in prepare.generation_inputs(df).collect()}
    assert (got[1]["max_new_tokens"], got[1]["min_new_tokens"]) == (50, 0) and len(got[1]["prefix"].split()) == 100
    assert (got[2]["max_new_tokens"], got[2]["prefix"]) == (0, "short text")
    assert all(500 <= r["drawn_tokens"] <= 1000 and 0.3 <= r["temperature"] < 0.8 for r in got.values())
    coded = spark.createDataFrame([(1, 0, [5, 6, 7]), (2, 0, [8]), (3, 1, [9])], "doc_id bigint, batch_id bigint, input_ids array<bigint>")
    padded = {r["doc_id"]: (r["input_ids"], r["attention_mask"]) for r in prepare.padded_batches(coded).collect()}
    assert padded == {1: ([5, 6, 7], [1, 1, 1]), 2: ([8, 0, 0], [1, 0, 0]), 3: ([9], [1])}


def test_coherence_cuts_its_tokens_once(spark, tmp_path):
    rows = [(i, f"src{i % 20:02d}", "en", f"apple pear plum word{i % 3}") for i in range(12)]
    spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("window_word_counts", "window_pair_counts", "topic_coherence", "mean_coherence"):
        found = QUERIES[name](spark, str(tmp_path))
        assert "regexp_extract_all" not in found._jdf.queryExecution().toString(), name
        assert found.count()

"""Models kept as tables, against plain Python on small corpora: word sequences, topics, sentence ends, hashed words."""

import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpometer.functions import subwords
from corpometer.functions import text as T
from corpometer.functions.subwords import subword_tokens
from corpometer.operators import density, kneser_ney, stats
from corpometer.operators import language_model as lm
from corpometer.plans import hashed, sentences, topic_tables
from corpometer.session import stored

VOCABULARY = Path("/opt/tokenizers/byte_bpe_50k.json")
WORDS = "river stone garden window silver letter morning branch corner little".split()


def corpus(seed, n=40, longest=25, words=WORDS):
    """Texts whose words depend on the one before."""
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        text = []
        for _ in range(rng.randrange(longest)):
            text.append(rng.choice(words[:3] if text and text[-1] in words[5:] else words))
        texts.append(" ".join(text))
    return texts


# --- word sequences ---


class Model:
    """Interpolated Kneser-Ney by its definition, over lists of words."""

    def __init__(self, texts, order):
        self.order = order
        counts = [None] * (order + 1)
        counts[order] = Counter(g for t in texts for g in self.grams(t))
        for m in range(order - 1, 0, -1):
            counts[m] = Counter(g[1:] for g in counts[m + 1])
        self.counts = counts
        self.words = set(counts[1])
        self.discounts = [None]
        for m in range(1, order + 1):
            n1, n2 = (sum(c == k for c in counts[m].values()) for k in (1, 2))
            self.discounts.append(n1 / (n1 + 2 * n2) if n1 else 0.5)
        self.after = [None] + [defaultdict(list) for _ in range(order)]
        for m in range(1, order + 1):
            for g, c in counts[m].items():
                self.after[m][g[:-1]].append(c)

    def grams(self, words):
        padded = [""] * (self.order - 2) + words
        return [tuple(padded[i : i + self.order]) for i in range(len(words) - 1)] if len(words) > 1 else []

    def p(self, gram):
        m = len(gram)
        below = self.p(gram[1:]) if m > 1 else 1 / (len(self.words) + 1)
        seen = self.after[m].get(gram[:-1])
        if not seen:
            return below
        return (max(self.counts[m].get(gram, 0) - self.discounts[m], 0) + self.discounts[m] * len(seen) * below) / sum(seen)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_losses_equal_the_definition(spark, order):
    train, other = corpus(1), [*corpus(2, 15, words=[*WORDS, "new", "unseen"]), "", "alone", "alone stands"]
    rows = [("real", i, t) for i, t in enumerate(train)] + [("made", i, t) for i, t in enumerate(other)] + [("made", 99, None), ("void", 1, "one")]
    df = spark.createDataFrame(rows, "corpus string, doc_id int, text string")
    model = Model([t.split() for t in train], order)
    want = {(c, i): [-math.log(model.p(g)) for g in model.grams((t or "").split())] for c, i, t in rows}
    got = {(r.corpus, r.doc_id): r for r in kneser_ney.document_losses(df, T.space_tokens("text"), "real", order).collect()}
    assert got.keys() == want.keys()
    for key, losses in want.items():
        assert got[key].n_tokens == len(losses) and got[key].nll == pytest.approx(sum(losses), abs=1e-9)
    whole = {r.corpus: r for r in kneser_ney.corpus_losses(df, T.space_tokens("text"), "real", order).collect()}
    for name in ("real", "made"):
        losses = [x for (c, _), some in want.items() if c == name for x in some]
        assert whole[name].n_tokens == len(losses) and whole[name].nll == pytest.approx(sum(losses), abs=1e-9)


@pytest.mark.parametrize("order", [2, 4])
def test_losses_do_not_follow_the_number_of_parts(spark, monkeypatch, order):
    rows = [("real" if i % 3 else "made", i, t) for i, t in enumerate([*corpus(1), *corpus(2, 15, words=[*WORDS, "new"])])] + [(None, None, "a b c"), ("made", 1, "river")]
    df = spark.createDataFrame(rows, "corpus string, doc_id int, text string")

    def losses():
        whole = kneser_ney.corpus_losses(df, T.space_tokens("text"), "real", order)
        documents = kneser_ney.document_losses(df, T.space_tokens("text"), "real", order).withColumn("corpus", F.concat_ws(" ", "corpus", "doc_id")).drop("doc_id")
        return sorted((str(r.corpus), r.n_tokens, round(r.nll, 8)) for r in whole.union(documents.select(whole.columns)).collect())

    once, files = losses(), []
    monkeypatch.setattr(kneser_ney, "PART_WORDS", 100)
    monkeypatch.setattr(kneser_ney, "stored", lambda table, name="stage": files.append(name) or stored(table, name))
    assert losses() == once and files.count(f"sequences-{order}") > 4 and files.count("document-sums") > 2


def test_probabilities_behind_each_context_sum_to_one(spark):
    texts = [t.split() for t in corpus(3)]
    model = Model(texts, 3)
    contexts = sorted({g[:2] for g in model.counts[3]}) + [("nobody", "knows"), ("nobody", "river")]
    grams = {(*c, w): 0 for c in contexts for w in [*(g[0] for g in model.words), "unknown"]} | dict(model.counts[3])
    rows = spark.createDataFrame([(list(g), c) for g, c in grams.items()], "gram array<string>, c long")
    sums = defaultdict(float)
    for r in kneser_ney.probabilities(rows, 3).collect():
        sums[tuple(r.gram[:2])] += r.p
    assert sums.keys() == set(contexts) and all(s == pytest.approx(1, abs=1e-9) for s in sums.values())


def test_no_two_words_share_a_number(spark):
    df = spark.createDataFrame([(1, "a b c a"), (2, "b"), (3, None)], "doc_id int, text string")
    clash = lambda word, salt: F.when(F.lit(salt == 0), F.length(word)).when(F.lit(salt == 1), F.ascii(word) - 97).otherwise(F.ascii(word)).cast("bigint")
    got = kneser_ney.numbered(df, T.space_tokens("text"), 3, "doc_id", number=clash).collect()
    # Their length is the same for all three, so the next number is tried.
    assert [(r.doc_id, r.words) for r in got] == [(1, [-97, 0, 1, 2, 0])]


def test_longer_contexts_foresee_more(spark):
    def chained(seed):
        rng = random.Random(seed)
        text = ["river", "stone"]
        for _ in range(80):
            odd = rng.random() < 0.1
            text.append(rng.choice(WORDS) if odd else WORDS[(WORDS.index(text[-1]) * 3 + WORDS.index(text[-2])) % 10])
        return " ".join(text)

    rows = [("real" if i < 60 else "held out", i, chained(i)) for i in range(90)]
    df = spark.createDataFrame(rows, "corpus string, doc_id int, text string")
    tokens = T.space_tokens("text")
    found = [lm.corpus_losses(df, tokens, "real")] + [kneser_ney.corpus_losses(df, tokens, "real", n) for n in (2, 3)]
    bigram, two, three = (lm.perplexity(f).where("corpus = 'held out'").first().perplexity for f in found)
    assert three < two < bigram * 1.01 and three < bigram / 2
    with pytest.raises(ValueError, match="order 2 or more"):
        kneser_ney.sequence_counts(df, tokens, 1)


def test_no_training_text(spark):
    df = spark.createDataFrame([("made", 1, "a b c")], "corpus string, doc_id int, text string")
    row = kneser_ney.corpus_losses(df, T.space_tokens("text"), "real").first()
    assert row.n_tokens == 2 and row.nll == pytest.approx(0.0)
    assert kneser_ney.corpus_losses(df.limit(0), T.space_tokens("text"), "real").count() == 0


# --- topics ---


def drawn(seed, token, topic):
    return -math.log((int(hashlib.md5(f"{seed}:{token}:{topic}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32)


def plain_topics(bags, k, passes, rounds, seed=42):
    terms = sorted({t for b in bags.values() for t in b})
    w = {t: np.array([drawn(seed, t, j) for j in range(k)]) for t in terms}
    for _ in range(passes):
        total = sum(w.values()) + len(terms) / k
        new = {t: np.zeros(k) for t in terms}
        for bag in bags.values():
            shares = np.ones(k)
            for _ in range(rounds):
                given = {}
                for t, n in bag.items():
                    x = (w[t] + 1 / k) / total * shares
                    given[t] = n * x / x.sum()
                shares = sum(given.values()) + 1 / k
            for t, g in given.items():
                new[t] += g
        w = new
    return w


def topic_corpus(seed=4, n=60):
    rng = random.Random(seed)
    subjects = [[f"{s}{i}" for i in range(12)] for s in ("sea", "hill", "town")]
    return [(i, " ".join(rng.choice(subjects[i % 3]) if rng.random() < 0.95 else rng.choice(rng.choice(subjects)) for _ in range(60))) for i in range(n)]


@pytest.mark.parametrize("hot", [20_000, 7])
def test_topics_equal_plain_python(spark, hot):
    rows = topic_corpus()
    df = spark.createDataFrame([*rows, (900, ""), (901, None), (902, "seldom")], "doc_id int, text string")
    counts, n = topic_tables.fitted_counts(df, T.space_tokens("text"))
    assert n == len(rows) + 1
    terms = topic_tables.kept_terms(counts, n, no_below=2, no_above=1.0)
    model, inference = topic_tables.fit(counts, terms, k=3, passes=3, rounds=4, hot_terms=hot)
    want = plain_topics({i: Counter(t.split()) for i, t in rows}, 3, 3, 4)
    got = {r.token: r.w for r in model.terms.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[t], want[t]) for t in want)
    weights = topic_tables.term_weights(model).groupBy("topic").agg(F.sum("weight").alias("s")).collect()
    assert len(weights) == 3 and all(r.s == pytest.approx(1) for r in weights)
    shares = {r.doc_id: r.topics for r in topic_tables.document_topics(inference, model, 4).collect()}
    assert shares.keys() == {i for i, _ in rows} and all(sum(s) == pytest.approx(1) for s in shares.values())


@pytest.mark.parametrize("per_document", [True, False])
def test_a_pass_sends_rare_terms_once_to_each_block(spark, monkeypatch, per_document):
    """Not a row of the model for each document and rare term, and the same numbers from blocks of any size."""
    rows = topic_corpus(8, 40)
    df = spark.createDataFrame([(i if i else None, t) for i, t in rows], "doc_id int, text string")
    counts, n = topic_tables.fitted_counts(df, T.space_tokens("text"))
    terms = topic_tables.kept_terms(counts, n, 1, 1.0)
    key = "doc_id" if per_document else "token_id"
    want = None
    for hot, pairs in ((1000, 10**6), (3, 10**6), (3, 100)):
        monkeypatch.setattr(topic_tables, "BLOCK_PAIRS", pairs)
        model, inference = topic_tables.fit(counts, terms, k=3, passes=0, hot_terms=hot)
        if hot == 3:
            asked = inference.asked.groupBy("__block").agg(F.count("*").alias("n"), F.count_distinct("token_id").alias("d")).collect()
            assert all(r.n == r.d <= inference.size - 3 for r in asked) and (len(asked) > 1) == (pairs == 100)
        sums = defaultdict(lambda: np.zeros(3))
        for r in inference.run(model, 2, per_document).collect():
            sums[r[key]] += np.array(r[1])
        want = want or sums
        assert sums.keys() == want.keys() and all(np.allclose(sums[i], want[i]) for i in want)


def test_documents_dealt_out_together_are_dealt_out_alone():
    bags = pa.array([[1] * n for n in (3, 90, 1, 40, 2, 2)])
    ranges = list(topic_tables._slices(bags, 42))
    assert ranges == [(0, 1), (1, 2), (2, 4), (4, 6)] and not list(topic_tables._slices(bags.slice(0, 0), 42))
    rng = np.random.default_rng(1)
    n, weights, sizes = rng.integers(1, 9, 138).astype(float), rng.random((138, 4)), np.array([3, 90, 1, 40, 2, 2])
    given, counts = topic_tables.dealt(n, weights, sizes, 0.25, 5)
    for i, low in enumerate(np.cumsum(sizes) - sizes):
        own = slice(low, low + sizes[i])
        alone, count = topic_tables.dealt(n[own], weights[own], sizes[i : i + 1], 0.25, 5)
        assert np.allclose(given[own], alone) and np.allclose(counts[i], count[0]) and np.isclose(count.sum(), n[own].sum())


def test_topics_find_the_subjects(spark):
    rows = topic_corpus(5, 90)
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(7)
    counts, n = topic_tables.fitted_counts(df, T.space_tokens("text"))
    model, inference = topic_tables.fit(counts, topic_tables.kept_terms(counts, n, 1, 1.0), k=3, passes=12)
    words = defaultdict(set)
    for r in topic_tables.topic_words(model, 10).collect():
        words[r.topic].add(r.word.rstrip("0123456789"))
    assert sorted(map(sorted, words.values())) == [["hill"], ["sea"], ["town"]]
    best = {r.doc_id: int(np.argmax(r.topics)) for r in topic_tables.document_topics(inference, model).collect()}
    assert all(len({best[i] for i, _ in rows if i % 3 == s}) == 1 for s in range(3))


def test_topics_without_terms(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    counts, n = topic_tables.fitted_counts(df, T.space_tokens("text"))
    with pytest.raises(ValueError, match="No token"):
        topic_tables.fit(counts, topic_tables.kept_terms(counts, n, 5, 0.5))


# --- sentences ---


def told(spark, more=()):
    """A corpus in which the use of stops shows what they stand for."""
    rng = random.Random(11)
    names = ["Brown", "Green", "Adams", "Baker", "Clark"]
    plain = ["for many days they went along the long road", "nobody saw the small house", "a dog slept by the road", "the house was near the water", "he left for the small town"]
    lines = []
    for i in range(160):
        a, b = rng.sample(names, 2)
        lines += [
            f"Mr. {a} met Dr. {b} near the small house.",
            f"{rng.choice(plain).capitalize()}.",
            f"J. {a} slept in the U.S. for {rng.randrange(2, 90)} days.",
            f"{rng.choice(plain).capitalize()} and {rng.choice(plain)}.",
            f"In the year {1900 + i}. the {rng.choice(['dog', 'house'])} was there!",
        ]
    rng.shuffle(lines)
    rows = [(i, " ".join(lines[i * 8 : i * 8 + 8])) for i in range(100)] + [(1000 + i, t) for i, t in enumerate(more)]
    return spark.createDataFrame(rows, "doc_id int, text string")


SAID = [
    'Mr. Brown saw it. "The U.S. dog slept," said J. Baker.',
    "He met Dr. Clark. Nobody left in 1950. the dog did... Then they went!",
    "",
    None,
    "Mr.",
]


@pytest.fixture(scope="module")
def learnt(spark):
    return sentences.learn(told(spark))


def test_learnt_abbreviations(learnt):
    found = {r.type: r for r in learnt.abbreviations.collect()}
    assert found.keys() == {"mr", "dr", "u.s", "j"}
    row = found["mr"]
    assert (row.with_stop, row.without_stop) == (160, 0)
    total = {r.type: r.with_stop + r.without_stop for r in learnt.abbreviations.collect()}
    assert total["u.s"] == 160 and all(r.score >= sentences.ABBREVIATION for r in found.values())
    cases = {r.type: r for r in learnt.cases.collect()}
    assert cases["the"].lower_seen > 0 and cases["brown"].lower_seen == 0


def test_word_tokens_keep_the_stops_of_abbreviations(spark, learnt):
    df = spark.createDataFrame(list(enumerate(SAID)), "doc_id int, text string")
    got = {r.doc_id: r.tokens for r in sentences.word_tokens(df, learnt).collect()}
    assert got[0] == ["mr.", "brown", "saw", "it", "the", "u.s.", "dog", "slept", "said", "j.", "baker"]
    assert got[1] == ["he", "met", "dr.", "clark", "nobody", "left", "in", "1950.", "the", "dog", "did", "then", "they", "went"]
    assert (got[2], got[3], got[4]) == ([], None, ["mr"])


def test_sentences_end_where_no_abbreviation_does(spark, learnt):
    df = spark.createDataFrame(list(enumerate(SAID)), "doc_id int, text string")
    got = defaultdict(list)
    for r in sorted(sentences.sentences(df, learnt).collect()):
        got[r.doc_id].append(r.sentence)
    assert got[0] == ["Mr. Brown saw it.", '"The U.S. dog slept," said J. Baker.']
    assert got[1] == ["He met Dr. Clark.", "Nobody left in 1950. the dog did...", "Then they went!"]
    assert got[4] == ["Mr."] and got.keys() == {0, 1, 4}


def test_stops_take_no_longer_than_the_text(spark, learnt):
    """A text of very many pieces: no piece carries its whole text along, and no sentence copies all pieces."""
    text = "Mr. Brown saw it. He left! " * 20_000
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    kept = sentences.kept_stops(df, learnt).first().kept
    assert kept == list(range(0, 120_000, 6))
    docs = spark.createDataFrame([(1, text[:27_000]), (2, "\n ..\n at.\u2028b \n"), (3, " \n")], "doc_id int, text string")
    got = sorted(tuple(r) for r in sentences.sentences(docs, learnt).collect())
    assert got == [*((1, i, ("Mr. Brown saw it.", "He left!")[i % 2]) for i in range(2000)), (2, 0, ".."), (2, 1, "at."), (2, 2, "b")]


def test_sentences_learn_nothing_from_nothing(spark):
    none = sentences.learn(spark.createDataFrame([], "doc_id int, text string"))
    assert sentences.statistics(none).count() == 0
    df = spark.createDataFrame([(1, "One. Two. three")], "doc_id int, text string")
    assert [r.sentence for r in sorted(sentences.sentences(df, none).collect())] == ["One.", "Two.", "three"]


# --- hashed words ---


def test_hashed_counts_equal_plain_python(spark):
    texts = dict(enumerate([*corpus(6, 20), "", "Ä é river river"]))
    df = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    want = {}
    for i, t in texts.items():
        for w in t.lower().split():
            key = hashlib.md5(f"0:{w}".encode()).hexdigest()
            place = int(key[:8], 16) % 16
            want[i, place] = want.get((i, place), 0) + (1 if key[8] < "8" else -1)
    got = {(r.doc_id, r.place): r.n for r in hashed.hashed_counts(df, T.space_tokens("text"), 4).collect()}
    assert got == {k: n for k, n in want.items() if n}


def test_mean_of_a_walk():
    rng = np.random.default_rng(3)
    rows = [(float(rng.random() < 0.5), np.sort(rng.choice(30, 5, replace=False)), rng.normal(size=5)) for _ in range(40)]
    start, bias, rate, reg = rng.normal(size=30), 0.3, 0.2, 0.0
    w, b, seen, seen_b = start.copy(), bias, [], []
    for label, at, x in rows:
        slip = rate * (label - 1 / (1 + math.exp(-(w[at] @ x + b))))
        w[at] += slip * x
        b += slip
        seen.append(w.copy())
        seen_b.append(b)
    mean, mean_b = hashed.walked(rows, start, bias, rate, reg)
    assert np.allclose(mean, np.mean(seen, axis=0)) and mean_b == pytest.approx(np.mean(seen_b))


def test_scores_do_not_follow_partitions(spark):
    rng = random.Random(12)
    rows = []
    for i in range(600):
        side = i % 2
        words = [rng.choice(WORDS) + ("s" if rng.random() < (0.5 if side else 0.1) else "") for _ in range(25)]
        rows.append((i, "synthetic" if side else "real", " ".join(words)))
    df = spark.createDataFrame([*rows, (9000, "real", "the of and"), (9001, "real", None)], "doc_id int, corpus string, text string")
    found = [hashed.classify_hashed(df.repartition(n), shard_rows=100, bits=12) for n in (4, 64)]
    a, b = ({r.doc_id: r.score for r in f.scored.collect()} for f in found)
    assert a.keys() == b.keys() and len(a) == 181 and max(abs(a[i] - b[i]) for i in a) < 1e-6
    assert found[0].scores.first().accuracy > 0.9 and found[0].model.losses == pytest.approx(found[1].model.losses)
    assert found[0].model.epochs > 1 and min(found[0].model.losses) < 0.5
    with pytest.raises(ValueError, match="Both corpora"):
        hashed.classify_hashed(df.where("corpus = 'real'"))


def test_texts_that_share_an_id_have_one_vector(spark):
    rows = [(i, "real" if i % 2 else "synthetic", f"river stone {'lake' * (i % 3 + 1)}") for i in range(40)]
    df = spark.createDataFrame([*rows, (7, "real", "boat boat"), (7, "real", "stone"), (None, "real", "boat")], "doc_id int, corpus string, text string")
    found = hashed.hashed_bags(df.withColumn("split", F.lit("train")), T.space_tokens("text"), 8, keep=["doc_id", "split", "corpus"])
    bags = hashed._of_ids(hashed.stored(found.withColumn("label", F.lit(1.0)), "bags"), "doc_id").collect()
    want = {(r.doc_id, r.place): r.n for r in hashed.hashed_counts(df.where("doc_id IS NOT NULL"), T.space_tokens("text"), 8).collect()}
    assert len(bags) == 43 and {(b.doc_id, p): n for b in bags for p, n in zip(b.places, b.ns, strict=True)} == want
    assert [b.places for b in bags if b.doc_id is None] == [[]]
    assert sum(b.counted for b in bags) == 40 and sum(b.counted for b in bags if b.doc_id == 7) == 1


def test_texts_and_shards_are_not_moved_for_counting_or_epochs(spark):
    df = spark.createDataFrame([(i, i % 2, "river stone lake") for i in range(300)], "doc_id int, label int, text string")
    bags = hashed.hashed_bags(df, T.space_tokens("text"), 8)
    shards = hashed._shards(
        df.select("doc_id", F.col("label").cast("double").alias("label"), F.array(F.lit(1)).alias("places"), F.array(F.lit(1.0)).alias("values")), 20, 42, "doc_id"
    )
    for found in (bags, shards):
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert shards.rdd.getNumPartitions() >= 4 and sorted(shards.select(F.explode("rows.label")).groupBy("col").count().collect()) == [(0.0, 150), (1.0, 150)]


# --- subwords ---


@pytest.mark.skipif(not VOCABULARY.exists(), reason="vocabulary files are not there")
def test_subwords_of_more_characters_than_a_batch(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(subwords, "BATCH_CHARS", 10)
    cut, tokenizer = subword_tokens(str(VOCABULARY)), Tokenizer.from_file(str(VOCABULARY))
    texts = pa.array(["river and hill", None, "", "a", "the sea by the town", None])
    want = [None if t is None else tokenizer.encode(t, add_special_tokens=False).tokens for t in texts.to_pylist()]
    # Arrow in, Arrow out: a batch's tokens are never all objects of their own.
    assert cut.func(texts).to_pylist() == want and cut.func(texts.slice(0, 0)).to_pylist() == []


@pytest.mark.skipif(not VOCABULARY.exists(), reason="vocabulary files are not there")
def test_subword_statistics(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(str(VOCABULARY))
    texts = ["Hello there, hello!", "", "été  naïve\n\n日本", "a" * 5000, "word " * 50_000]
    df = spark.createDataFrame([("x", t) for t in texts] + [("x", None)], "corpus string, text string")
    tokens = [library.encode(t, add_special_tokens=False).tokens for t in texts]
    counts = Counter(itertools.chain(*tokens))
    row = stats.corpus_stats(df, tokenizer=subword_tokens(str(VOCABULARY))).first()
    sizes = [len(t) for t in tokens]
    assert (row.n_docs, row.n_tokens, row.n_types) == (len(texts), sum(sizes), len(counts))
    assert row.avg_len_tokens == pytest.approx(np.mean(sizes)) and row.std_len_tokens == pytest.approx(np.std(sizes))
    assert row.hapax_ratio == pytest.approx(sum(c == 1 for c in counts.values()) / len(counts))
    marked = spark.createDataFrame([("a <|endoftext|> b",), (None,)], "text string").select(subword_tokens(str(VOCABULARY))("text").alias("t")).collect()
    assert len(marked[0].t) > 4 and marked[1].t is None


# --- binned density ---


def test_binned_density_is_within_its_bound(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=3000)
    y = 0.7 * x + 0.5 * rng.normal(size=3000) + (rng.random(3000) < 0.3) * 3
    rows = [("a", float(p), float(q)) for p, q in zip(x, y)] + [("b", float(p), float(-q)) for p, q in zip(x[:200], y[:200])] + [("b", None, 1.0), ("one", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "corpus string, x double, y double")
    exact = {(r.corpus, r.point_x, r.point_y): r for r in density.density_grid(df.where("x IS NOT NULL"), points=30).collect()}
    errors = {}
    for refine in (4, 12):
        got = {(r.corpus, r.point_x, r.point_y): r for r in density.binned_density_grid(df, points=30, refine=refine).collect()}
        assert got.keys() == exact.keys()
        for name in ("a", "b"):
            keys = [k for k in exact if k[0] == name]
            part = [(x[i], y[i]) if name == "a" else (x[i], -y[i]) for i in range(3000 if name == "a" else 200)]
            cov, n = np.cov(np.array(part).T), len(part)
            det, f = np.linalg.det(cov), n ** (-1 / 3)
            peak = 1 / (2 * np.pi * np.sqrt(det) * f)
            step = [(exact[name, 1, 0].x - exact[name, 0, 0].x) / refine, (exact[name, 0, 1].y - exact[name, 0, 0].y) / refine]
            bound = peak * density.binning_error(*step, np.sqrt(f * det / cov[1, 1]), np.sqrt(f * det / cov[0, 0]))
            error = max(abs(got[k].density - exact[k].density) for k in keys)
            assert error <= bound and all(got[k].x == pytest.approx(exact[k].x) for k in keys)
            errors[name, refine] = error
    assert errors["a", 12] < errors["a", 4] / 4

"""Models, encoders, chat and vectors: brute force, exact round trips and held-out accuracy on small tables."""

import hashlib
import itertools
import math
import random
import struct
import tracemalloc
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from corpometer.llm import chat, logbilinear, nearest, pieces, quality, toxicity
from corpometer.llm.catalog import PIECE_MODEL

DATA = Path("/root/testdata/sf0.001")
NAMES = ["river", "stone", "garden", "window", "silver", "letter", "morning", "branch", "corner", "little", "water", "yellow"]


def sentence(rng, n=12):
    return " ".join(rng.choices(NAMES, k=n)).capitalize() + "."


# --- quality ---


def brute_marginals(field, lines):
    """P(bad) of each line of one text by going through all labellings."""
    score, n = field.potentials(lines), len(lines.sizes)
    weights = {
        s: math.exp(sum(score[i] * s[i] for i in range(n)) + sum(field.turns[a, b] for a, b in itertools.pairwise(s)))
        for s in itertools.product((0, 1), repeat=n)
    }
    total = sum(weights.values())
    return [sum(w for s, w in weights.items() if s[i]) / total for i in range(n)]


def test_forward_backward_equals_all_labellings():
    rng = np.random.default_rng(2)
    field = quality.LineField(*(rng.normal(0, 1, quality.WIDTH) for _ in range(3)), rng.normal(0, 1, 3), rng.normal(0, 1, (2, 2)))
    texts = ["One line.", None, "A | b | c\nA | b | c\n\n  \nGood words here.\n%%% x", "LOUD!!\n" * 6, "", "é\n1 2 3"]
    lines = quality.lines_of(texts)
    marginal, pair = quality.forward_backward(field, lines)
    for i, text in enumerate(texts):
        own = marginal[lines.starts[i] : lines.starts[i + 1]]
        assert np.allclose(own, brute_marginals(field, quality.lines_of([text])) if len(own) else [])
    assert np.allclose(pair.sum(1)[:, 1][lines.starts[2] : lines.starts[3] - 1], marginal[lines.starts[2] + 1 : lines.starts[3]])


def quality_rows(n=300):
    rng, rows, labels = random.Random(4), [], []
    for i in range(n):
        bad = i % 3 == 0
        text = [sentence(rng) for _ in range(rng.randrange(1, 6))]
        if bad:
            junk = [" | ".join(rng.choices(NAMES, k=9)), " ".join(w.upper() + "!!" for w in rng.choices(NAMES, k=9)), " ".join([rng.choice(NAMES)] * 20)]
            text[rng.randrange(len(text) + 1) :] = [rng.choice(junk)] * rng.randrange(1, 4)
        rows.append((i, "\n".join(text)))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_quality_learns_from_other_folds(spark):
    rows, labels = quality_rows()
    rows += [(1_000, None), (1_001, ""), (1_002, " \n "), (None, rows[1][1]), (1, rows[1][1]), (1_003, "Fine words here.\n" * 20_000)]
    labels += [(2_000, 1, 0), (5, None, None), (None, 0, 0), (7, 0, 0), (7, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS score", "1 AS bins")
    field = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = quality.scored(docs, field).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert sum(r.predicted == int(r.doc_id % 3 != 0) for r in got if r.doc_id is not None and r.doc_id < 300) > 290
    assert {r.predicted for r in got if r.doc_id in (1_000, 1_001, 1_002)} == {0}
    assert len({round(r.score, 9) for r in got if r.doc_id in (1, None)}) == 1
    kept = quality.without_low_quality(docs, field)
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} == {"x"}
    assert kept.count() == sum(r.predicted for r in got)
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.scored(docs, quality.fit(docs, no_labels)).where("predicted = 1").count() > 0
    assert quality.scored(docs.limit(0), quality.fit(docs.limit(0), no_labels)).count() == 0


def test_quality_learns_from_long_texts_too(spark):
    rows, labels = quality_rows(30)
    rows = [(i, "\n".join([t] * 450)) for i, t in rows]
    assert all(t.count("\n") > 400 for _, t in rows) and any(t.count("\n") > 2_000 for _, t in rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    field = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), max_lines=20_000)
    got = quality.scored(docs, field).collect()
    assert sum(r.predicted == int(r.doc_id % 3 != 0) for r in got) > 27


# --- toxicity ---


def brute_segments(scores):
    """Maximal scoring segments by their definition: best run, then the same left and right of it."""
    def best(low, high):
        runs = [(math.fsum(scores[a:b]), a, b) for a in range(low, high) for b in range(a + 1, high + 1)]
        top = max(runs, default=(0, 0, 0), key=lambda r: (round(r[0], 9), -(r[2] - r[1])))
        if top[0] <= 1e-9:
            return []
        return best(low, top[1]) + [(top[1], top[2], top[0])] + best(top[2], high)
    return best(0, len(scores))


def test_segments_equal_definition():
    rng = random.Random(8)
    for _ in range(300):
        scores = [rng.choice([-1.7, -0.9, -0.31, 0.77, 1.13, 2.9]) + rng.random() / 100 for _ in range(rng.randrange(14))]
        got, want = toxicity.segments(scores), brute_segments(scores)
        assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want])
    assert len(toxicity.segments([1.0, -2.0] * 100_000)) == 100_000
    assert toxicity.segments([1.0, -0.5] * 100_000)[0][:2] == (0, 199_999)


def test_toxicity_finds_passages(spark):
    rng, rows, labels = random.Random(6), [], []
    for i in range(400):
        words = rng.choices(NAMES, k=rng.randrange(5, 200))
        if i % 4 == 0:
            at = rng.randrange(len(words))
            words[at:at] = rng.choices(["vile", "rotten", "vermin", "vermins"], k=3)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(1_000, None), (1_001, ""), (None, rows[0][1]), (0, rows[0][1]), (1_002, "Stone water. " * 40_000 + "vile rotten vermin"), (1_003, "vile " * 3)]
    labels += [(None, 1, 1), (3, None, None), (9, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS passages", "2 AS units")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = toxicity.scored(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 400) >= 400
    by_id = {r.doc_id: r for r in got}
    assert by_id[1_000].score == by_id[1_001].score < 0.5 and by_id[None].score == by_id[0].score
    assert [(p["first"], p["last"]) for p in by_id[1_002].passages] == [(80_000, 80_002)] and by_id[1_002].predicted == 1
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.scored(docs, toxicity.fit(docs, none)).where("predicted = 1").count() == 0
    assert toxicity.scored(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0


# --- language model ---


def test_language_model(spark, monkeypatch):
    rng, rows = random.Random(5), []
    for i in range(150):
        rows.append((i, " ".join(f"{w} of{w[0]}" for w in rng.choices(NAMES, k=80)) + f" once{i} Same{i % 7} É{i % 3}"))
    rows += [(200, None), (201, ""), (None, rows[3][1]), (3, rows[3][1]), (202, "unseen words only"), (203, "river ofr " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "0 AS n", "'r' AS token")
    training = docs.where("doc_id % 7 <> 2 AND doc_id < 200")
    learnt = Counter()
    for i, t in rows:
        if i is not None and i % 7 != 2 and i < 200:
            learnt.update(logbilinear.tokens_of(t))
    n, v = sum(learnt.values()), len(learnt)
    counts = logbilinear.stored(logbilinear.token_counts(training), "test-counts")
    for words, hot in ((60, 100), (1_000, 100_000)):
        vocab = logbilinear.vocabulary(counts, words, hot)
        assert (vocab.total, vocab.distinct) == (n, v) and vocab.id_counts.sum() == n
        model = logbilinear.train(training, vocab)
        one, two, sums = model.tables()
        for a, b in ((0, 0), (1, 2), (5, 0)):
            assert abs(np.exp(one[a] + two[b] - sums[a, b]).sum() - 1) < 1e-9
        # A bucket's words and the one share for unseen words make up the bucket.
        listed = set(vocab.tokens[: words + 1])
        for b in range(logbilinear.BUCKETS):
            own = [c + 1 for t, c in learnt.items() if t not in listed and logbilinear.bucket_of(t) == b]
            assert abs(sum(own) + 1 - 10 ** vocab.bucket_log[b]) < 1e-6
        got = logbilinear.scored(docs, counts, vocab, model).collect()
        assert len(got) == len(rows)
        texts = dict(rows)
        for r in got:
            ts = logbilinear.tokens_of(texts[r.doc_id])
            assert r.n_tokens == len(ts) and r.n_known == sum(learnt[t] > 0 for t in ts)
            base = sum(math.log10((learnt[t] + 1) / (n + v + 1)) for t in ts)
            assert abs(r.base_score - base) < 1e-6 * abs(base)
            if r.doc_id in (2, 202, 200, 9):
                index = {t: i for i, t in enumerate(vocab.tokens)}
                ids = logbilinear._ids(ts, index, vocab)[1]
                before, twice, word = logbilinear.places_of([ids])
                total = sum((one[a, w] + two[b, w] - sums[a, b]) / math.log(10) for a, b, w in zip(before, twice, word, strict=True))
                total += sum(math.log10(learnt[t] + 1) - vocab.bucket_log[w - len(vocab.id_counts) + logbilinear.BUCKETS] for t, w in zip(ts, word, strict=True) if t not in listed)
                assert abs(r.score - total) < 1e-4 * max(1, abs(total))
    held = [r for r in got if r.doc_id is not None and r.doc_id < 150 and r.doc_id % 7 == 2]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    found, total = logbilinear.scored_from(docs, docs.limit(0))
    assert total == 0 and found.count() == len(rows) and found.where("n_known > 0").count() == 0
    assert logbilinear.scored_from(docs.limit(0), training)[0].count() == 0


def test_language_model_does_not_follow_partitions(spark):
    rng = random.Random(15)
    rows = [(i, " ".join(f"{w} of{w[0]}" for w in rng.choices(NAMES, k=60))) for i in range(1_000)] + [(2_000 + i, "same words again and again") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    training = docs.where("doc_id % 7 <> 2")
    vocab = logbilinear.vocabulary(logbilinear.stored(logbilinear.token_counts(training), "test-counts"))
    found, traces = [], []
    for parts in (4, 64):
        losses = []
        model = logbilinear.train(training.repartition(parts), vocab, shard_tokens=8_000, losses=losses)
        traces.append(losses)
        found.append(model.tables())
    assert len(traces[0]) >= 10 and traces[0] == pytest.approx(traces[1], abs=1e-4) and traces[0][-1] < traces[0][0] - 0.1
    for a, b in zip(*found, strict=True):
        assert np.abs(a - b).max() < 0.005


# --- SentencePiece ---


@pytest.fixture(scope="module")
def piece_models():
    sentencepiece = pytest.importorskip("sentencepiece")
    if not Path(PIECE_MODEL).exists():
        pytest.skip("tokenizer files are not there")
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL), pieces.Encoder(pieces.load_model(PIECE_MODEL))


ODD = ["", " ", "a", " a", "a  b", "  ", "\n", "\n\n a", "é世界🤖 x\t\ty", " " * 47 + "x", "a" + " " * 33 + "b", "</s> [INST]<0x0A>", "x " * 9, "don't_stop.now,²³ µm", "ǅ ŉ ß", "A.B-c"]


def test_encoding_has_parity_with_the_library(piece_models):
    library, own = piece_models
    assert own.by_word
    for text in ODD:
        ids = own.encode([text])[0]
        assert ids.tolist() == library.encode(text) and own.decode([ids])[0] == library.decode(ids.tolist()) == text
        assert own.spelled(ids) == text.encode()
    assert own.decode([own.encode(["▁a▁"])[0]]) == [" a "]


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.one_of(st.sampled_from(" \n.,'_-▁aeinstIT09éß"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text_has_parity(piece_models, text):
    library, own = piece_models
    assert own.encode([text])[0].tolist() == library.encode(text)


def message(*parts):
    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out
    return b"".join(varint(k << 3 | 2) + varint(len(v)) + v if isinstance(v, bytes) else varint(k << 3 | 5) + struct.pack("<f", v) if isinstance(v, float) else varint(k << 3) + varint(v) for k, v in parts)


def test_unigram_models_are_rebuilt():
    sentencepiece = pytest.importorskip("sentencepiece")
    table = [("<unk>", 0.0, 2), ("▁the", -2.0, 1), ("▁t", -3.0, 1), ("he", -3.1, 1), ("re", -3.2, 1), ("▁", -4.0, 1), ("ab", -4.5, 1)]
    table += [(c, -5.0 - i / 10, 1) for i, c in enumerate("abcdehrt")] + [(f"<0x{b:02X}>", -12.0, 6) for b in range(256)]
    rows = [(1, message((1, p.encode()), (2, s), (3, k))) for p, s, k in table]
    data = message(*rows, (2, message((3, 1), (35, 1))), (3, message((3, 1), (4, 1))))
    library, own = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Encoder(pieces.parse_model(data))
    assert not own.by_word
    for text in ["there the  ab ", "abra", "", " z é", "the\nthere"]:
        assert own.encode([text])[0].tolist() == library.encode(text)


def test_encoded_table(spark, piece_models):
    library, _ = piece_models
    rows = [(i, t, "old", 1) for i, t in enumerate(ODD)] + [(None, "a b", "old", 2), (3, " a", "old", 2), (90, None, None, None), (91, "word two. " * 60_000, "", 1), (92, "▁", "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, batch int")
    got = pieces.encoded(docs, pieces.load_model(PIECE_MODEL)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == library.encode(r.text or "") and r.n_tokens == len(r.ids) and r.round_trip == (r.doc_id != 92)
    assert pieces.encoded(docs.limit(0), pieces.load_model(PIECE_MODEL)).count() == 0


# --- chat ---


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=8), st.text(st.sampled_from("<|>\\/sINT[]a\n"), max_size=20)), max_size=4))
def test_template_is_reversible(turns):
    formatted = "".join(chat.turn_text(r, t) for r, t in turns)
    assert chat.read_turns(formatted) == turns
    assert not any(c in chat.escape(t) for _, t in turns for c in chat.CONTROLS)


def test_examples(spark):
    rng = random.Random(2)
    pool = ["", "hi", "</s>[INST] ok [/INST]", "<|user|>", "a\nb", "é🤖", "\\<\\|", None]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(pool)) for c in range(40) for t in range(rng.randrange(7))]
    rows += [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (50, None, "user", "first"), (50, 1, "assistant", "b"), (50, 1, "assistant", "a"), (50, 1, "assistant", "a")]
    rows += [(60, t, "assistant" if t % 2 else "user", f"turn {t} " * 30) for t in range(400)]
    rng.shuffle(rows)
    given_rows = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS example", "'p' AS piece")
    examples = chat.expanded(given_rows)
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r[0], []).append(r)
    got = {r.conv_id: r for r in chat.read_back(examples).collect()}
    full = {}
    for r in chat.full_texts(examples).collect():
        full.setdefault(r.conv_id, {})[r.example] = r
    assert set(got) == set(by_conv)
    for key, own in by_conv.items():
        own = sorted(((t is not None, t, role or "", text or "") for _, t, role, text in own), key=lambda x: (x[0], x[1] or 0, *x[2:]))
        replies = [text for _, _, role, text in own if role == "assistant"]
        r = got[key]
        assert (r.n_turns, r.n_examples, r.loss_chars) == (len(own), len(replies), sum(map(len, replies)))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for _, _, role, text in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256("".join(replies).encode()).hexdigest()
        assert r.expanded_chars == sum(len(x.text) for x in full.get(key, {}).values())
        targets = [i for i, x in enumerate(own) if x[2] == "assistant"]
        for k, i in enumerate(targets):
            x = full[key][k]
            assert chat.read_turns(x.text) == [(role, text) for _, _, role, text in own[: i + 1]]
            assert chat.unescape(x.text[x.loss_start : x.loss_end]) == own[i][3]
    assert chat.expanded(given_rows.limit(0)).count() == 0 and chat.read_back(examples.limit(0)).count() == 0


def test_an_example_holds_its_whole_context(spark):
    turns = [("user", "a"), ("assistant", "b</s>"), ("user", "c"), ("assistant", ""), ("user", "e")]
    rows = [(7, t, *turn) for t, turn in enumerate(turns)]
    got = chat.expanded(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("example").collect()
    assert [chat.read_turns(r.text) for r in got] == [turns[:2], turns[:4], turns]
    assert [r.target for r in got] == [True, True, False] and got[2].loss_start is None
    assert [r.context_chars for r in got] == [0, len(got[0].text), len(got[1].text)]
    assert [chat.unescape(r.text[r.loss_start : r.loss_end]) for r in got[:2]] == ["b</s>", ""]


# --- vectors ---


def brute_nearest(rows, top=5):
    def sound(v):
        return v is not None and len(v) and any(v) and all(x is not None and math.isfinite(x) for x in v)
    kept = {(i, tuple(v)) for i, v in rows if i is not None and sound(v)}
    out = {}
    for i, v in kept:
        if i % 50 == 0:
            a = np.array(v, dtype=np.float64)[None]
            for j, w in kept:
                if i != j and len(w) == len(v):
                    s = float(nearest.cosines(nearest.even(a), nearest.even(np.array(w, dtype=np.float64)[None]))[0])
                    out.setdefault(i, []).append((-s, j, s))
    return {i: [(j, s) for _, j, s in sorted(found)[:top]] for i, found in out.items()}


@pytest.mark.parametrize("blocks", [(4_096, 16_384), (3, 40)])
def test_nearest_equals_brute_force(spark, blocks):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).round(1).tolist()) for i in range(500)]
    rows += [(1_000 + i, rows[50][1]) for i in range(30)] + [(2_000 + i, [x * 2 for x in rows[100][1]]) for i in range(9)]
    rows += [(3_000, None), (3_050, [0.0] * 16), (3_100, []), (3_150, [1.0, None] * 8), (3_200, [math.nan] + [1.0] * 15), (3_250, [math.inf] + [1.0] * 15)]
    rows += [(None, rows[0][1]), (150, rows[150][1]), (4_000, [1.0, 2.0]), (4_001, [2.0, 1.0]), (4_050, [1e-300] * 16), (4_051, [1e300] * 16), (4_100, [-5.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS rank", "0.5 AS score", "'x' AS vector")
    got = {}
    for r in nearest.nearest(df.where("vec_id % 50 = 0"), df, query_block=blocks[0], row_block=blocks[1]).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute_nearest(rows)
    assert {q: [(v, s) for _, v, s in sorted(f)] for q, f in got.items()} == want
    assert all([k for k, _, _ in sorted(f)] == list(range(1, len(f) + 1)) for f in got.values())
    assert nearest.nearest(df.limit(0), df).count() == 0 and nearest.nearest(df, df.limit(0)).count() == 0


def test_equal_vectors_take_little_memory():
    row = np.random.default_rng(2).normal(size=128)
    ids = np.arange(1_500)
    tracemalloc.start()
    found = nearest.nearest_in_block(ids[:600], np.tile(row, (600, 1)), ids, np.tile(row, (1_500, 1)), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [other for _, other in found[0]] == [1, 2, 3, 4, 5] and [other for _, other in found[7]] == [0, 1, 2, 3, 4]
    assert peak < 300_000_000


def test_tile_bounds_hold():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(40, 64)), rng.standard_cauchy(size=(60, 64))
    q, r = nearest.Quantised(a), nearest.Quantised(b)
    estimate, off = nearest.tile_products(q, slice(0, 40), r, slice(0, 60))
    exact = (a / np.linalg.norm(a, axis=1)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T
    assert (np.abs(estimate - exact) <= off).all() and off.max() < 0.2


# --- queries and pipeline on the smallest tables ---


@pytest.fixture(scope="module")
def database():
    db = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


@pytest.mark.skipif(not DATA.exists(), reason="tables are not there")
@pytest.mark.parametrize("name", ["op1_benchmark_decontamination", "op4_chat_formatting", "op5_nearest_vectors"])
def test_query_equals_sql(spark, database, name):
    df = entry_points.queries()[name](spark, str(DATA))
    cursor = database.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(names).collect()), key=repr) == sorted(cursor.fetchall(), key=repr)


@pytest.mark.skipif(not DATA.exists(), reason="tables are not there")
def test_pipeline(spark):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["line quality", "toxicity", "simhash near duplicates", "benchmark decontamination", "sentencepiece encoding"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, now, str(DATA))
        rows = after.collect()
        assert {r.doc_id for r in rows} <= {r.doc_id for r in now.collect()} and len({r.doc_id for r in rows}) == len(rows)
        if name != "sentencepiece encoding":
            assert after.columns == docs.columns and all(r == before[r.doc_id] for r in rows)
            now = spark.createDataFrame(rows, docs.schema)
    assert len(rows) > 100 and all(r.round_trip for r in rows)
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(DATA)).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="tables are not there")
def test_stages_pass_on_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = "score __score predicted __predicted passages __passages __text own_score bad_id fingerprint __fingerprint __size __bands k_fp k_id".split()
    more = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    now = more
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, str(DATA))
        rows = after.collect()
        assert after.columns == more.columns and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names), name
        now = spark.createDataFrame(rows, more.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, more, str(DATA)).where(F.col("__text") == F.concat(F.lit("__text"), "doc_id")).count() == docs.count()

"""Hand-worked cases for the text, array, key and prompt columns."""

import random

import pytest
from pyspark.sql import functions as F

from catalog import QUERIES
from corpometer.functions import arrays as A
from corpometer.functions import keys, prompts
from corpometer.functions import text as T
from corpometer.functions.words import ENGLISH_STOP_WORDS, NEWS_TOPICS, accent_table


def one(spark, text, column):
    df = spark.createDataFrame([(text,)], "text string")
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, tokens, pieces",
    [("", [], 1), ("  a b ", ["a", "b"], 5), ("a A b", ["a", "a", "b"], 3), ("x y\x1cz\n", ["x", "y", "z"], 1)],
)
def test_two_ways_to_count_words(spark, text, tokens, pieces):
    assert one(spark, text, T.space_tokens("text")) == tokens == text.lower().split()
    assert one(spark, text, T.word_count("text")) == len(tokens)
    assert one(spark, text, T.single_space_count("text")) == pieces == len(text.split(" "))


def test_simple_tokens(spark):
    assert one(spark, "Élan vital", T.simple_tokens("text")) == ["elan", "vital"]
    assert one(spark, "été Ḍ̇od", T.simple_tokens("text")) == ["ete", "dod"]
    assert one(spark, "a go4x4 the _x " + "b" * 16 + " " + "c" * 15, T.simple_tokens("text")) == ["go", "c" * 15]
    assert one(spark, "the cat", T.simple_tokens("text", None)) == ["the", "cat"]


def test_words(spark):
    text = "Don't stop: \"well-known\" 4x4 cars, (it's) the dog's end. 2024 x!"
    assert one(spark, text, T.alphabetic_words("text")) == ["stop", "cars", "dog", "end", "x"]
    assert one(spark, "go 4x4 2024 x", T.alphabetic_words("text")) == ["go", "x"]


def test_tfidf_tokens(spark):
    assert one(spark, "A b2 über, x_y 7 the naïve", T.tfidf_tokens("text")) == ["b2", "über", "x_y", "naïve"]


def test_unknown_tokenizer():
    with pytest.raises(ValueError, match="Available"):
        T.tokenize("text", "none")


def test_cleaning(spark):
    assert one(spark, "  a b\n\t", T.strip("text")) == "a b"
    assert one(spark, "<s>Hi<|end|> there<end_of_turn>\n<eos>", T.without_special_tokens("text")) == "Hi there\n"
    assert one(spark, "x < y > z", T.without_special_tokens("text")) == "x < y > z"
    assert one(spark, "a  b\nc d", T.first_words("text", 3)) == "a b c"
    assert one(spark, "abc", T.preview("text", 2)) == "ab"
    assert one(spark, "Error generating article: x", T.generation_failed("text"))


@pytest.mark.parametrize(
    "head",
    [
        "By . Jane Roe . PUBLISHED: . 08:20 EST, 4 March 2014 . | . UPDATED: . 10:01 EST, 5 March 2014 . ",
        "By Jane Roe and John O'Doe\n",
        "By Jane Roe, CNN\n",
        "London, England (CNN) -- ",
        "(CNN)",
        "March 4, 2014 -- ",
        "",
    ],
)
def test_byline(spark, head):
    body = "By noon the crowd had left. It rained on March 4, 2014."
    assert one(spark, head + body, T.without_byline("text")) == body


def test_arrays(spark):
    df = spark.createDataFrame([([5, 6, 7],)], "ids array<bigint>")
    row = df.select(
        A.pad(F.col("ids"), 5, 0).alias("long"),
        A.pad(F.col("ids"), 2, 0).alias("short"),
        A.attention_mask(F.col("ids"), 5).alias("mask"),
        A.masked_labels(A.pad(F.col("ids"), 5, 0), A.attention_mask(F.col("ids"), 5)).alias("labels"),
        F.size(A.truncate(F.array_repeat(F.lit("t"), 3000), 4096)).alias("cut"),
    ).first()
    assert row["long"] == [5, 6, 7, 0, 0] and row["short"] == [5, 6]
    assert row["mask"] == [1, 1, 1, 0, 0] and row["labels"] == [5, 6, 7, -100, -100]
    assert row["cut"] == 2048


def test_keys_repeat(spark):
    df = spark.range(2000).withColumnRenamed("id", "doc_id")
    drawn = df.select("doc_id", keys.uniform(1, "doc_id", low=2, high=4).alias("u"))
    first, second = drawn.collect(), drawn.repartition(7).orderBy("doc_id").collect()
    assert first == second
    values = [r["u"] for r in first]
    assert 2 <= min(values) and max(values) < 4 and abs(sum(values) / len(values) - 3) < 0.05


def test_prompts(spark):
    assert len(NEWS_TOPICS) == len(set(NEWS_TOPICS)) == 53 and len(prompts.topic_list(True)) == 56
    df = spark.range(500)
    picked = {r[0] for r in df.select(prompts.pick_topic(3, "id")).collect()}
    assert len(picked) > 45 and picked <= set(NEWS_TOPICS)
    chat = spark.createDataFrame([([("user", "hi"), ("assistant", "yo")],)], "m array<struct<role:string,content:string>>")
    text = chat.select(prompts.chat_text("m", generation_prompt=None)).first()[0]
    assert text == "<|user|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n"


def test_word_lists():
    assert len(ENGLISH_STOP_WORDS) == len(set(ENGLISH_STOP_WORDS)) == 179
    source, target = accent_table()
    assert dict(zip(source, target))["é"] == "e" and len(source) > len(target)


def test_tokens_worked_out_by_hand(spark):
    text = "I cannot stop. We're gonna go, 'tis fine (really)! Don't gimme 12 cafés."
    row = spark.createDataFrame([(text,)], "text string").select(
        T.word_pieces("text").alias("pieces"), T.alphabetic_words("text", None).alias("words"),
        T.simple_tokens("text", None).alias("simple"), T.tfidf_tokens("text", None).alias("tfidf"),
    ).first()
    assert row["pieces"] == ["i", "can", "not", "stop", "we", "gon", "na", "go", "is", "fine", "really", "do", "gim", "me", "12", "cafés"]
    assert row["words"] == [w for w in row["pieces"] if w != "12"]
    assert row["simple"] == ["cannot", "stop", "we", "re", "gonna", "go", "tis", "fine", "really", "don", "gimme", "cafes"]
    assert row["tfidf"] == ["cannot", "stop", "we", "re", "gonna", "go", "tis", "fine", "really", "don", "gimme", "12", "cafés"]


def test_quick_patterns_leave_the_same_text(spark):
    rng = random.Random(4)
    bits = ["'", "\u2019", "'tis", "\u2019twas", " ", "\n", "\u2003", "\x1c", "\x85", "..", "--", "`", "cannot", "gonna", "n't", "'s", ",", "(", "\u00e9", "\u4e2d", "~", "a"]
    rows = [("".join(rng.choice(bits) for _ in range(rng.randint(0, 10))),) for _ in range(3000)]
    df = spark.createDataFrame(rows, "text string")
    pairs = [
        (F.split("text", T.SPACES), F.split("text", T.SPACE + "+")),
        (F.regexp_replace("text", T.FUSED_FAST, "$1$3$5$7 $2$4$6$8"), F.regexp_replace("text", T.FUSED, "$1$3$5$7 $2$4$6$8")),
        (F.regexp_replace("text", T.SHORTENED_FAST, "$1"), F.regexp_replace("text", T.SHORTENED, "$1$2")),
        (F.regexp_replace("text", T.APART_FAST, " "), F.regexp_replace("text", T.APART, " ")),
        (F.regexp_replace("text", T.OPENING_FAST, ""), F.regexp_replace("text", T.OPENING, "$1")),
    ]
    assert [df.where(quick != plain).count() for quick, plain in pairs] == [0] * len(pairs)
    source, target = accent_table()
    accents = F.translate(F.lower("text"), source, target)
    assert df.where(F.concat_ws(" ", T.simple_tokens("text", None, 1, 99)) != F.concat_ws(" ", F.regexp_extract_all(accents, F.lit(T.ALPHABETIC), 0))).count() == 0


def test_dictionary_lookup_cuts_texts_once(spark, tmp_path):
    rows = [(i, f"river stone{'s' * (i % 2)}", "en", "src1", 11) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["dictionary_lookup"](spark, str(tmp_path))
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.place, r.token) for r in found.collect()} == {(1, "stone"), (1, "stones")} and found.count() == 20

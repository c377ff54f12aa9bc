"""Tokens, counts, prompts and other columns computed row by row."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from catalog.base import (
    DOCS, STOPS, documents, query, quoted, sql_alphabetic, sql_simple, sql_space, sql_tfidf_tokens, sql_words,
    table, text_list, texts,
)
from catalog.files import _topic_sql
from corpometer.functions import arrays as A
from corpometer.functions import prompts as P
from corpometer.functions import text as T
from corpometer.operators import scoring
from corpometer.operators.bags import dictionary, encode
from corpometer.operators.sampling import batches
from corpometer.plans import prepare


def _tokens(name: str, sql_tokens: str, column):
    """Register a query that lists the tokens of each document and their number."""

    @query(
        name,
        f"SELECT doc_id, array_to_string(tokens, ' ') AS tokens, CAST(len(tokens) AS BIGINT) AS n "
        f"FROM (SELECT doc_id, {sql_tokens} AS tokens FROM documents)",
    )
    def run(spark, folder):
        docs = texts(spark, folder).select("doc_id", column("text").alias("tokens"))
        return docs.select("doc_id", text_list(F.col("tokens")).alias("tokens"), F.size("tokens").cast("bigint").alias("n"))

    return run


_tokens("space_tokens", sql_space("text"), T.space_tokens)
_tokens("simple_tokens", sql_simple("text"), T.simple_tokens)
_tokens("word_pieces", sql_words("text"), T.word_pieces)
_tokens("alphabetic_words", sql_alphabetic("text"), T.alphabetic_words)
_tokens("tfidf_tokens", sql_tfidf_tokens("text"), T.tfidf_tokens)
_tokens(
    "stop_words_out",
    f"list_filter({sql_space('text')}, lambda t: t NOT IN ({STOPS}))",
    lambda c: T.without_words(T.space_tokens(c)),
)
_tokens(
    "letters_only",
    f"list_filter({sql_space('text')}, lambda t: regexp_full_match(t, {quoted(T.LETTERS_ONLY)}))",
    lambda c: F.filter(T.space_tokens(c), T.is_alphabetic),
)


@query(
    "word_counts",
    f"""SELECT doc_id, CAST(len({sql_space('text')}) AS BIGINT) AS words,
        CAST(len(string_split(text, ' ')) AS BIGINT) AS pieces, CAST(length(text) AS BIGINT) AS chars FROM documents""",
)
def word_counts(spark, folder):
    return texts(spark, folder).select(
        "doc_id",
        T.word_count("text").alias("words"),
        T.single_space_count("text").alias("pieces"),
        F.length("text").cast("bigint").alias("chars"),
    )


@query(
    "truncated_tokens",
    f"SELECT doc_id, array_to_string(list_slice({sql_space('text')}, 1, 2048), ' ') AS tokens FROM documents",
)
def truncated_tokens(spark, folder):
    tokens = A.truncate(T.space_tokens("text"), 4096)
    return texts(spark, folder).select("doc_id", text_list(tokens).alias("tokens"))


IDS = f"""freq AS (SELECT token, count(*) AS cf FROM (SELECT unnest({sql_space('text')}) AS token FROM documents) GROUP BY token),
    ids AS (SELECT token, row_number() OVER (ORDER BY md5('0:' || token), token) - 1 AS token_id FROM freq),
    toks AS (SELECT doc_id, unnest({sql_space('text')}) AS token, generate_subscripts({sql_space('text')}, 1) AS p FROM documents),
    coded AS (SELECT d.doc_id, coalesce(c.input_ids, []) AS input_ids FROM documents d LEFT JOIN
        (SELECT doc_id, list(token_id ORDER BY p) AS input_ids FROM toks JOIN ids USING (token) GROUP BY doc_id) c USING (doc_id))"""


def _dictionary(docs):
    tokens = docs.select(F.explode(T.space_tokens("text")).alias("token"))
    return dictionary(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("cf")))


@query(
    "token_ids",
    f"WITH {IDS} SELECT doc_id, array_to_string(input_ids, ' ') AS input_ids FROM coded",
)
def token_ids(spark, folder):
    docs = texts(spark, folder)
    coded = encode(docs, T.space_tokens("text"), _dictionary(docs))
    return coded.select("doc_id", A.join_longs(F.col("input_ids")).alias("input_ids"))


@query(
    "pad_mask_labels",
    f"""WITH {IDS}, cut AS (SELECT doc_id, list_slice(input_ids, 1, 1024) AS ids FROM coded)
    SELECT doc_id,
        array_to_string(list_concat(ids, list_transform(range(1024 - len(ids)), lambda i: -1)), ' ') AS input_ids,
        array_to_string(list_concat(list_transform(ids, lambda i: 1), list_transform(range(1024 - len(ids)), lambda i: 0)), ' ') AS attention_mask,
        array_to_string(list_concat(ids, list_transform(range(1024 - len(ids)), lambda i: -100)), ' ') AS labels FROM cut""",
)
def pad_mask_labels(spark, folder):
    docs = texts(spark, folder)
    coded = encode(docs, T.space_tokens("text"), _dictionary(docs))
    shaped = prepare.padded_ids(coded, 1024, pad_id=-1)
    return shaped.select(
        "doc_id", *[A.join_longs(F.col(c)).alias(c) for c in ("input_ids", "attention_mask", "labels")]
    )


@query(
    "pad_to_longest",
    """WITH ids AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda t: length(t)) AS x,
        (row_number() OVER (ORDER BY doc_id) - 1) // 20 AS batch_id FROM documents),
    cut AS (SELECT doc_id, batch_id, list_slice(x, 1, 2048) AS x FROM ids),
    top AS (SELECT *, max(len(x)) OVER (PARTITION BY batch_id) AS m FROM cut)
    SELECT doc_id, batch_id, array_to_string(list_concat(x, list_transform(range(m - len(x)), lambda i: 0)), ' ') AS input_ids,
        CAST(len(x) AS BIGINT) AS kept FROM top""",
)
def pad_to_longest(spark, folder):
    docs = texts(spark, folder)
    ids = F.transform(F.split("text", " "), lambda t: F.length(t).cast("bigint"))
    coded = batches(docs.select("doc_id", ids.alias("input_ids")), 20)
    padded = prepare.padded_batches(coded)
    return padded.select(
        "doc_id",
        "batch_id",
        A.join_longs(F.col("input_ids")).alias("input_ids"),
        F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, m: a + m).alias("kept"),
    )


@query(
    "training_set",
    f"""WITH {IDS}, cut AS (SELECT doc_id, list_slice(list_transform(input_ids, lambda i: i + 1), 1, 1024) AS ids FROM coded)
    SELECT doc_id AS id,
        array_to_string(list_concat(ids, list_transform(range(1024 - len(ids)), lambda i: 0)), ' ') AS input_ids,
        array_to_string(list_concat(ids, list_transform(range(1024 - len(ids)), lambda i: -100)), ' ') AS labels,
        CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id)
            <= ceil((SELECT count(*) FROM documents) * 0.1::DOUBLE) THEN 'eval' ELSE 'train' END AS split FROM cut""",
)
def training_set(spark, folder):
    """Generated outputs in several tables are stacked, trimmed, encoded, padded and split."""
    docs = texts(spark, folder)
    outputs = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("generated_text"), "lang")
    stacked = outputs.where("lang = 'en'").drop("lang").unionByName(outputs.where("lang <> 'en'").drop("lang"))
    shaped = prepare.training_set(stacked, _dictionary(docs), length=1024)
    return shaped.select(
        "id", A.join_longs(F.col("input_ids")).alias("input_ids"), A.join_longs(F.col("labels")).alias("labels"), "split"
    )


@query(
    "word_prefix",
    f"""SELECT doc_id, array_to_string(list_slice(list_filter(regexp_split_to_array(text, {quoted(T.SPACE + '+')}),
        lambda t: t <> ''), 1, 100), ' ') AS prefix FROM documents""",
)
def word_prefix(spark, folder):
    return texts(spark, folder).select("doc_id", T.first_words("text", 100).alias("prefix"))


def _uniform_sql(part: str, low: float, high: float) -> str:
    unit = f"CAST(('0x' || substr(md5('42:{part}:' || doc_id), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"
    return f"({low}::DOUBLE + ({high}::DOUBLE - {low}::DOUBLE) * ({unit}))"


@query(
    "generation_settings",
    f"""SELECT doc_id, CAST(floor({_uniform_sql('tokens', 500, 1001)}) AS BIGINT) AS drawn_tokens,
        round({_uniform_sql('temperature', 0.3, 0.8)}, 6) AS temperature,
        greatest(n - 100, 0) AS max_new_tokens, greatest(n - 200, 0) AS min_new_tokens
        FROM (SELECT doc_id, CAST(len({sql_space('text')}) AS BIGINT) AS n FROM documents)""",
)
def generation_settings(spark, folder):
    made = prepare.generation_inputs(texts(spark, folder))
    return made.select(
        "doc_id", "drawn_tokens", F.round("temperature", 6).alias("temperature"), "max_new_tokens", "min_new_tokens"
    )


@query(
    "topic_prompts",
    f"""SELECT id, sha256(id || '|' || topic) AS uuid, topic, 'Report on ' || topic || ' today. Keep to ' || topic || '.' AS prompt
        FROM (SELECT doc_id AS id, {_topic_sql('doc_id', 53)} AS topic FROM documents)""",
)
def topic_prompts(spark, folder):
    ids = texts(spark, folder).select(F.col("doc_id").alias("id"))
    return prepare.prompt_table(ids, "Report on {topic} today. Keep to {topic}.")


def _weighted_topic_sql() -> str:
    names = ", ".join(quoted(t) for t in P.topic_list(weighted=True))
    return (
        f"list_extract([{names}], CAST(floor(CAST(('0x' || substr(md5('9:' || doc_id), 1, 8)) AS BIGINT)"
        " / 4294967296.0 * 56) AS INTEGER) + 1)"
    )


@query("weighted_topics", f"SELECT doc_id, {_weighted_topic_sql()} AS topic FROM documents")
def weighted_topics(spark, folder):
    topic = P.pick_topic(9, "doc_id", topics=P.topic_list(weighted=True))
    return texts(spark, folder).select("doc_id", topic.alias("topic"))


@query(
    "chat_text",
    """SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY turn)
        || '<|assistant|>' || chr(10) AS chat FROM conversations GROUP BY conv_id""",
)
def chat_text(spark, folder):
    talks = table(spark, folder, "conversations").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    messages = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    return talks.select("conv_id", P.chat_text(messages).alias("chat"))


@query(
    "message_structs",
    """SELECT item_id, '[{"role":"user","content":[{"type":"text","text":"item ' || item_id || '"}]}]' AS messages FROM benchmark""",
)
def message_structs(spark, folder):
    message = P.user_message(F.concat(F.lit("item "), F.col("item_id")), typed_parts=True)
    return table(spark, folder, "benchmark").select("item_id", F.to_json(message).alias("messages"))


@query(
    "output_names",
    """SELECT event_id, 'results_' || strftime(ts, '%Y%m%d_%H%M%S') || '.json' AS file_name,
       strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS parsed FROM events""",
)
def output_names(spark, folder):
    stamp = F.date_format("ts", "yyyyMMdd_HHmmss")
    back = F.to_timestamp(F.regexp_extract("file_name", r"(\d{8}_\d{6})", 1), "yyyyMMdd_HHmmss")
    named = table(spark, folder, "events").select(
        "event_id", F.concat(F.lit("results_"), stamp, F.lit(".json")).alias("file_name")
    )
    return named.withColumn("parsed", F.date_format(back, "yyyy-MM-dd HH:mm:ss"))


@query(
    "nested_json",
    """SELECT doc_id, '{"source":"' || source || '","size":{"chars":' || n_chars || ',"share":' || CAST(round(n_chars / 8.0, 3) AS DOUBLE) || '}}' AS body, n_chars AS chars
       FROM documents""",
)
def nested_json(spark, folder):
    share = F.round(F.col("n_chars") / 8.0, 3).cast("float").cast("double")
    body = F.to_json(F.struct("source", F.struct(F.col("n_chars").alias("chars"), share.alias("share")).alias("size")))
    made = texts(spark, folder).select("doc_id", body.alias("body"))
    parsed = F.from_json("body", "source string, size struct<chars:bigint,share:double>")
    return made.withColumn("chars", parsed["size"]["chars"])


@query(
    "preview_and_round",
    "SELECT doc_id, substr(text, 1, 200) AS head, round(n_chars / 7.0::DOUBLE, 2) AS seconds FROM documents",
)
def preview_and_round(spark, folder):
    return texts(spark, folder).select(
        "doc_id", T.preview("text").alias("head"), F.round(F.col("n_chars") / 7.0, 2).alias("seconds")
    )


@query(
    "batched_map",
    "SELECT doc_id, CAST(length(text) AS BIGINT) AS n, upper(lang) AS lang FROM documents",
)
def batched_map(spark, folder):
    def shape(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            {"doc_id": frame["doc_id"], "n": frame["text"].str.len(), "lang": frame["lang"].str.upper()}
        )

    docs = texts(spark, folder)
    return scoring.batched_map(docs, shape, "doc_id bigint, n bigint, lang string", ["doc_id", "text", "lang"])


@query(
    "parallel_token_map",
    f"SELECT doc_id, array_to_string({sql_simple('text')}, ' ') AS tokens FROM documents",
)
def parallel_token_map(spark, folder):
    """Tokens by column expressions in each task; a small file is dealt out to all cores once."""
    return texts(spark, folder).select("doc_id", text_list(T.simple_tokens("text")).alias("tokens"))


@query(
    "batch_scorer",
    f"""SELECT corpus, doc_id, round(CASE WHEN lang = 'fr' THEN 0 ELSE len(string_split(text, ' ')) * ln(27) END, 6) AS nll,
        CASE WHEN lang = 'fr' THEN 0 ELSE CAST(len(string_split(text, ' ')) AS BIGINT) END AS n_tokens, CAST(NULL AS VARCHAR) AS error FROM {DOCS}""",
)
def batch_scorer(spark, folder):
    def make_scorer():
        import math

        def score(texts):
            sizes = [len(t.split(" ")) for t in texts]
            return [n * math.log(27) for n in sizes], sizes

        return score

    docs = documents(spark, folder).withColumn("text", F.when(F.col("lang") != "fr", F.col("text")))
    scored = scoring.score_batches(docs, make_scorer)
    return scored.select("corpus", "doc_id", F.round("nll", 6).alias("nll"), "n_tokens", "error")

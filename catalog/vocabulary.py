"""Corpus statistics, token frequencies, dictionaries and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import DOCS, VECS, documents, query, rounded, sql_simple, sql_space, sql_tfidf_tokens, table, texts
from corpometer.functions import text as T
from corpometer.operators import bags, stats
from corpometer.operators.joins import lookup
from corpometer.operators.tables import top_rows
from corpometer.session import stored

STATS = ("avg_len_tokens", "std_len_tokens", "avg_len_chars", "ttr", "hapax_ratio")


def stats_sql(tokens: str, extra: str = "") -> str:
    return f"""WITH d AS (SELECT corpus, doc_id, text, {tokens} AS tokens FROM {DOCS}),
    lens AS (SELECT corpus, count(*) AS n_docs, avg(len(tokens)) AS a, stddev_pop(len(tokens)) AS s, avg(length(text)) AS c
        FROM d GROUP BY corpus),
    counts AS (SELECT corpus, token, count(*) AS n FROM (SELECT corpus, unnest(tokens) AS token FROM d) GROUP BY corpus, token),
    words AS (SELECT corpus, CAST(sum(n) AS BIGINT) AS n_tokens, count(*) AS n_types, count(*) / sum(n) AS t,
        sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / count(*) AS h FROM counts GROUP BY corpus),
    stats AS (SELECT corpus, n_docs, round(a, 6) AS avg_len_tokens, round(s, 6) AS std_len_tokens, round(c, 6) AS avg_len_chars,
        n_tokens, n_types, round(t, 6) AS ttr, round(h, 6) AS hapax_ratio FROM lens JOIN words USING (corpus)) {extra}"""


@query("corpus_stats", stats_sql(sql_space("text"), "SELECT * FROM stats"))
def corpus_stats(spark, folder):
    return rounded(stats.corpus_stats(documents(spark, folder)), *STATS)


@query("token_stats", stats_sql(sql_space('text'), "SELECT * FROM stats"))
def token_stats(spark, folder):
    return rounded(stats.token_stats(documents(spark, folder)), *STATS)


_LONG = " UNION ALL ".join(f"SELECT corpus, '{m}' AS metric, {m} AS value FROM stats" for m in STATS)


@query(
    "side_by_side_stats",
    stats_sql(
        sql_space('text'),
        f""", long AS ({_LONG}) SELECT metric, max(CASE corpus WHEN 'real' THEN value END) AS "real",
        max(CASE corpus WHEN 'synthetic' THEN value END) AS synthetic FROM long GROUP BY metric""",
    ),
)
def side_by_side_stats(spark, folder):
    table_ = rounded(stats.token_stats(documents(spark, folder)), *STATS).select("corpus", *STATS)
    return stats.side_by_side(stats.long_form(table_), ["real", "synthetic"])


@query(
    "token_frequency",
    f"SELECT corpus, token, count(*) AS n FROM (SELECT corpus, unnest({sql_space('text')}) AS token FROM {DOCS}) GROUP BY corpus, token",
)
def token_frequency(spark, folder):
    return stats.token_counts(documents(spark, folder))


DF = f"""f AS (SELECT corpus, token, count(DISTINCT doc_id) AS df, count(*) AS cf FROM
        (SELECT corpus, doc_id, unnest({sql_simple('text')}) AS token FROM {DOCS}) GROUP BY corpus, token),
    n AS (SELECT corpus, count(*) AS n_docs FROM {DOCS} GROUP BY corpus),
    kept AS (SELECT corpus, token, df, cf FROM f JOIN n USING (corpus) WHERE df >= 5 AND df <= floor(n_docs * 0.5::DOUBLE))"""

DF_ALL = DF.replace(DOCS, "(SELECT doc_id, text, 'all' AS corpus FROM documents)")


def frequent(docs, tokens=None):
    tokens = T.simple_tokens("text") if tokens is None else tokens
    return stats.frequent_tokens(stats.document_frequency(docs, tokens), stats.documents_per_corpus(docs))


def frequent_of(counts, docs):
    """The frequent tokens of all documents from their stored term counts, without reading the texts again."""
    found = bags.frequencies_of(counts).withColumn("corpus", F.lit("all"))
    return stats.frequent_tokens(found, stats.documents_per_corpus(docs.withColumn("corpus", F.lit("all"))))


@query("document_frequency", f"WITH {DF} SELECT * FROM kept")
def document_frequency(spark, folder):
    return frequent(documents(spark, folder))


@query(
    "bag_of_words",
    f"""WITH {DF_ALL}, ids AS (SELECT token, row_number() OVER (ORDER BY md5('0:' || token), token) - 1 AS token_id FROM kept ),
    c AS (SELECT doc_id, token_id, count(*) AS n FROM (SELECT doc_id, unnest({sql_simple('text')}) AS token FROM {DOCS})
        JOIN ids USING (token) GROUP BY doc_id, token_id)
    SELECT doc_id, string_agg(token_id || ':' || n, ' ' ORDER BY token_id) AS bag FROM c GROUP BY doc_id""",
)
def bag_of_words(spark, folder):
    # The dictionary and the bags both read the tokens, so they are cut once.
    docs = stored(texts(spark, folder).select("doc_id", T.simple_tokens("text").alias("tokens")), "tokens")
    bag = bags.bags_of_words(docs, F.col("tokens"), bags.dictionary(frequent(docs.withColumn("corpus", F.lit("all")), F.col("tokens"))))
    pairs = F.transform("bag", lambda b: F.concat_ws(":", b["token_id"].cast("string"), b["n"].cast("string")))
    return bag.select("doc_id", F.array_join(pairs, " ").alias("bag"))


@query(
    "dictionary_lookup",
    f"""WITH {DF_ALL}, ids AS (SELECT token, row_number() OVER (ORDER BY md5('0:' || token), token) - 1 AS token_id FROM kept)
    SELECT doc_id, p AS place, token, token_id FROM
        (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS p FROM (SELECT doc_id, {sql_simple('text')} AS t FROM {DOCS}))
    JOIN ids USING (token)""",
)
def dictionary_lookup(spark, folder):
    # The dictionary reads the tokens once and the lookup twice, so they are cut once.
    docs = stored(texts(spark, folder).select("doc_id", T.simple_tokens("text").alias("tokens")), "tokens").withColumn("corpus", F.lit("all"))
    ids = bags.dictionary(frequent(docs, F.col("tokens")))
    rows = bags.token_rows(docs, F.col("tokens"))
    coded = lookup(rows, ids, ["token"], weight="cf", how="inner")
    return coded.select("doc_id", F.col("place").cast("bigint").alias("place"), "token", "token_id")


@query(
    "vocabulary_size",
    f"SELECT corpus, count(DISTINCT token) AS n_types FROM (SELECT corpus, unnest({sql_space('text')}) AS token FROM {DOCS}) GROUP BY corpus",
)
def vocabulary_size(spark, folder):
    return stats.vocabulary_stats(stats.token_counts(documents(spark, folder))).select("corpus", "n_types")


@query(
    "longest_text",
    f"SELECT corpus, CAST(max(len(string_split(text, ' '))) AS BIGINT) AS longest FROM {DOCS} GROUP BY corpus",
)
def longest_text(spark, folder):
    return stats.longest_text(documents(spark, folder))


@query(
    "top_terms",
    f"""SELECT token, count(*) AS cf FROM (SELECT unnest({sql_tfidf_tokens('text')}) AS token FROM documents)
        GROUP BY token ORDER BY cf DESC, token LIMIT 5000""",
)
def top_terms(spark, folder):
    tokens = texts(spark, folder).select(F.explode(T.tfidf_tokens("text")).alias("token"))
    return bags.top_terms(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("cf")), 5000)


@query(
    "tfidf_weights",
    f"""WITH c AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({sql_tfidf_tokens('text')}) AS token FROM documents) GROUP BY doc_id, token),
    v AS (SELECT token, sum(n) AS cf, count(*) AS df FROM c GROUP BY token ORDER BY cf DESC, token LIMIT 5000),
    w AS (SELECT doc_id, token, n * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM c JOIN v USING (token))
    SELECT doc_id, token, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""",
)
def tfidf_weights(spark, folder):
    weights = bags.tfidf(texts(spark, folder), T.tfidf_tokens("text"), 5000)
    return rounded(weights, "weight")


@query(
    "heaviest_terms",
    f"""WITH c AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({sql_tfidf_tokens('text')}) AS token FROM documents) GROUP BY doc_id, token)
    SELECT token, CAST(sum(n) AS BIGINT) AS cf, count(*) AS df FROM c GROUP BY token ORDER BY df DESC, token LIMIT 25""",
)
def heaviest_terms(spark, folder):
    counts = bags.term_counts(texts(spark, folder), T.tfidf_tokens("text"))
    terms = counts.groupBy("token").agg(F.sum("n").alias("cf"), F.count(F.lit(1)).alias("df"))
    return top_rows(terms, "df", 25, "token")


@query(
    "pooled_vectors",
    f"""SELECT label, CAST(i - 1 AS BIGINT) AS place, round(coalesce(sum(CASE WHEN used THEN x END), 0) / greatest(count(*) FILTER (WHERE used), 1), 6) AS value
    FROM (SELECT label, embedding[1] > 0 AS used, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM {VECS})
    GROUP BY label, i""",
)
def pooled_vectors(spark, folder):
    """Embeddings of one label stand for the token vectors of one document."""
    vectors = table(spark, folder, "embeddings").select(
        "label", F.col("embedding").alias("vector"), (F.col("embedding")[0] > 0).cast("int").alias("mask")
    )
    pooled = stats.pooled_vectors(vectors, "label")
    return pooled.select("label", F.col("place").cast("bigint").alias("place"), F.round("value", 6).alias("value"))

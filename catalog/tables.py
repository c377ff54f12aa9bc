"""Projections, filters, unions, joins and ranks on article tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import DOCS, STOPS, documents, query, quoted, sql_simple, sql_space, table, texts
from corpometer.functions import text as T
from corpometer.functions.keys import row_id
from corpometer.functions.words import SPECIAL_TOKENS
from corpometer.operators import tables as tb
from corpometer.operators.sampling import equal_shares, stand_in_corpus

OWNERS = ("ana", "ben", "cem", "dia", "eva")


@query("column_projection", "SELECT doc_id, text FROM documents")
def column_projection(spark, folder):
    return tb.columns(texts(spark, folder), ["doc_id", "text"])


@query("column_rename", "SELECT doc_id, text AS generated_article, lang, source, n_chars FROM documents")
def column_rename(spark, folder):
    return tb.renamed(texts(spark, folder), {"text": "generated_article", "absent": "unused"})


@query("index_column_drop", "SELECT doc_id, lang FROM documents")
def index_column_drop(spark, folder):
    docs = texts(spark, folder).select("doc_id", "lang")
    indexed = docs.withColumn(tb.INDEX_COLUMN, F.col("doc_id"))
    return tb.without_index(tb.without_index(indexed))


@query(
    "null_text_drop",
    "SELECT doc_id, CAST(n_chars AS VARCHAR) AS size FROM documents WHERE lang <> 'fr'",
)
def null_text_drop(spark, folder):
    docs = texts(spark, folder)
    holes = docs.select("doc_id", F.when(F.col("lang") != "fr", F.col("n_chars")).alias("size"))
    return tb.text_rows(holes, "size")


@query("owner_filter", """SELECT doc_id, person FROM (
    SELECT doc_id, list_extract(['ana','ben','cem','dia','eva'], CAST(ntile(5) OVER (ORDER BY doc_id) AS INTEGER)) AS person
    FROM documents) WHERE person = 'cem'""")
def owner_filter(spark, folder):
    shared = equal_shares(texts(spark, folder).select("doc_id"), OWNERS)
    return tb.owned_by(shared, "cem")


@query("empty_text_drop", "SELECT doc_id, body FROM (SELECT doc_id, CASE lang WHEN 'fr' THEN '' WHEN 'es' THEN NULL ELSE text END AS body FROM documents) WHERE body IS NOT NULL AND body <> ''")
def empty_text_drop(spark, folder):
    docs = texts(spark, folder)
    body = F.when(F.col("lang") == "fr", "").when(F.col("lang") != "es", F.col("text"))
    return tb.non_empty(docs.select("doc_id", body.alias("body")), "body")


@query(
    "tokenless_drop",
    f"SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n FROM (SELECT doc_id, {sql_simple('text')} AS tokens FROM documents) WHERE len(tokens) > 0",
)
def tokenless_drop(spark, folder):
    kept = tb.with_tokens_left(texts(spark, folder), "text", "simple")
    return kept.select("doc_id", F.size("tokens").cast("bigint").alias("n"))


FAILED = "CASE WHEN lang = 'es' THEN 'Error generating article: ' || text ELSE text END"


@query("failed_rows_drop", f"SELECT doc_id, {FAILED} AS generated_article FROM documents WHERE lang <> 'es'")
def failed_rows_drop(spark, folder):
    docs = texts(spark, folder)
    text = F.when(F.col("lang") == "es", F.concat(F.lit("Error generating article: "), "text")).otherwise(F.col("text"))
    return tb.without_failed(docs.select("doc_id", text.alias("generated_article")))


@query(
    "special_tokens_out",
    "SELECT doc_id, replace(text, '<', '(') || '.' AS text FROM documents",
)
def special_tokens_out(spark, folder):
    """Every document is given leftover markers at its start and end, and loses them again."""
    docs = texts(spark, folder).select(
        "doc_id", F.concat(*[F.lit(t) for t in SPECIAL_TOKENS], F.replace("text", F.lit("<"), F.lit("(")),
                           F.lit("<|end|>.<end_of_turn><eos>")).alias("text")
    )
    return docs.select("doc_id", T.without_special_tokens("text").alias("text"))


@query("outer_space_strip", "SELECT doc_id, text FROM documents")
def outer_space_strip(spark, folder):
    docs = texts(spark, folder)
    padded = F.concat(F.lit(" \n \t"), "text", F.lit("  \r\n"))
    return docs.select("doc_id", T.strip(padded).alias("text"))


@query("byline_out", "SELECT doc_id, text FROM documents")
def byline_out(spark, folder):
    """Bylines and datelines of several shapes are put at the head of the texts and taken off."""
    docs = texts(spark, folder)
    heads = {
        "en": "By . Jane Roe Porter . PUBLISHED: . 08:20 EST, 4 March 2014 . | . UPDATED: . 10:01 EST, 5 March 2014 . ",
        "de": "By Jane Roe and John Doe\n",
        "es": "London, England (CNN) -- ",
        "fr": "March 4, 2014 -- ",
    }
    head = F.lit("")
    for lang, text in heads.items():
        head = F.when(F.col("lang") == lang, F.lit(text)).otherwise(head)
    return docs.select("doc_id", T.without_byline(F.concat(head, F.col("text"))).alias("text"))


@query("row_ids", "SELECT doc_id, sha256(doc_id || '|' || source || '|' || text) AS uuid FROM documents")
def row_ids(spark, folder):
    return texts(spark, folder).select("doc_id", row_id("doc_id", "source", "text").alias("uuid"))


@query(
    "token_limits",
    f"""SELECT doc_id, array_to_string(list_slice(list_filter(regexp_split_to_array(text, {quoted(T.SPACE + '+')}), lambda t: t <> ''), 1, 100), ' ') AS prefix,
        greatest(n - 100, 0) AS max_new_tokens, greatest(greatest(n - 100, 0) - 100, 0) AS min_new_tokens
        FROM (SELECT doc_id, text, CAST(len({sql_space('text')}) AS BIGINT) AS n FROM documents)""",
)
def token_limits(spark, folder):
    limited = tb.token_limits(texts(spark, folder))
    return limited.select("doc_id", "prefix", "max_new_tokens", "min_new_tokens")


@query(
    "stand_in_corpus",
    """SELECT doc_id, replace(text, 'the', 'GMN') AS text FROM (
       SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM documents)
       WHERE r <= n // 2""",
)
def stand_in(spark, folder):
    return stand_in_corpus(texts(spark, folder).select("doc_id", "text"), "the", "GMN")


@query("header_rows_out", "SELECT doc_id, lang FROM documents")
def header_rows_out(spark, folder):
    """A header line per source is mixed into the rows, as stacking CSV text does."""
    docs = texts(spark, folder)
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), "lang")
    headers = docs.select("source").distinct().select(F.lit("id").alias("id"), F.lit("lang").alias("lang"))
    clean = tb.without_header_rows(rows.unionByName(headers), "id")
    return clean.select(F.col("id").try_cast("bigint").alias("doc_id"), "lang")


@query(
    "results_onto_inputs",
    """SELECT d.doc_id AS id, d.lang, l.quality AS quality, l.toxic AS toxic
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def results_onto_inputs(spark, folder):
    inputs = texts(spark, folder).select(F.col("doc_id").alias("id"), "lang")
    results = table(spark, folder, "labels").withColumnRenamed("doc_id", "id")
    return tb.results_onto(inputs, results)


@query(
    "stop_words_anti_join",
    f"""SELECT token, count(*) AS n FROM (SELECT unnest({sql_space('text')}) AS token FROM documents)
        WHERE token NOT IN ({STOPS}) GROUP BY token""",
)
def stop_words_anti_join(spark, folder):
    stops = spark.createDataFrame([(w,) for w in T.ENGLISH_STOP_WORDS], "token string")
    tokens = texts(spark, folder).select(F.explode(T.space_tokens("text")).alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(stops), "token", "left_anti")


@query(
    "labelled_pair_union",
    f"SELECT doc_id, CAST(CASE corpus WHEN 'real' THEN 0 ELSE 1 END AS INTEGER) AS label FROM {DOCS}",
)
def labelled_pair_union(spark, folder):
    docs = documents(spark, folder)
    sides = {i: docs.where(F.col("corpus") == c).select("doc_id") for i, c in enumerate(("real", "synthetic"))}
    return tb.labelled_union(sides, "label")


@query(
    "named_corpora_union",
    """SELECT doc_id AS id, text, 'Real' AS corpus FROM documents WHERE lang = 'en'
       UNION ALL SELECT doc_id, text, 'Second' FROM documents WHERE lang <> 'en'
       UNION ALL SELECT item_id, text, 'Third' FROM benchmark
       UNION ALL SELECT conv_id, text, 'Fourth' FROM conversations""",
)
def named_corpora_union(spark, folder):
    docs = texts(spark, folder).select(F.col("doc_id").alias("id"), "text", "lang")
    return tb.labelled_union(
        {
            "Real": docs.where("lang = 'en'").drop("lang"),
            "Second": docs.where("lang <> 'en'").drop("lang"),
            "Third": table(spark, folder, "benchmark").select(F.col("item_id").alias("id"), "text"),
            "Fourth": table(spark, folder, "conversations").select(F.col("conv_id").alias("id"), "text"),
        }
    )


@query(
    "vocabulary_union",
    f"""SELECT unnest({sql_space('text')}) AS token FROM documents
        UNION SELECT unnest({sql_space('text')}) FROM benchmark""",
)
def vocabulary_union(spark, folder):
    words = [
        table(spark, folder, name).select(F.explode(T.space_tokens("text")).alias("token"))
        for name in ("documents", "benchmark")
    ]
    return tb.distinct_union(*words)


@query(
    "element_lambda",
    "SELECT doc_id, array_to_string(list_transform(string_split(text, ' '), lambda t: length(t)), ' ') AS sizes FROM documents",
)
def element_lambda(spark, folder):
    sizes = F.transform(F.split("text", " "), lambda t: F.length(t).cast("string"))
    return texts(spark, folder).select("doc_id", F.array_join(sizes, " ").alias("sizes"))


@query("row_map", "SELECT doc_id, trim(text, chr(10) || ' ') AS text FROM documents")
def row_map(spark, folder):
    """The row map that replaces all columns by one, as a column expression."""
    return texts(spark, folder).select("doc_id", T.strip("text").alias("text"))

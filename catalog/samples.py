"""Samples, splits, folds, batches and shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import DOCS, VECS, documents, embeddings, query, rounded, sql_space, table
from corpometer.operators import sampling as sp
from corpometer.operators import stats
from corpometer.operators.joins import attach_row
from corpometer.operators.ranks import hash_rank


@query("seeded_sample", "SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 400")
def seeded_sample(spark, folder):
    return sp.sample_exact(table(spark, folder, "documents").select("doc_id", "lang"), 400)


@query("sample_all", "SELECT doc_id, lang FROM documents")
def sample_all(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return sp.sample_exact(docs, 10**12)


@query("first_rows", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 10")
def first_rows(spark, folder):
    return sp.first_rows(table(spark, folder, "documents").select("doc_id", "lang"), 10)


@query(
    "unseeded_sample",
    "SELECT least(count(*), 250) AS n, least(count(*), 250) AS n_distinct FROM documents",
)
def unseeded_sample(spark, folder):
    """A new sample each time, so only its size and the absence of repeats can be compared."""
    sample = sp.sample_unseeded(table(spark, folder, "documents").select("doc_id"), 250)
    return sample.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_distinct"))


@query(
    "capped_per_label",
    """SELECT vec_id, label FROM (SELECT vec_id, label,
       row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) AS r FROM embeddings)
       WHERE r <= 1000""",
)
def capped_per_label(spark, folder):
    return sp.sample_per_label(table(spark, folder, "embeddings").select("vec_id", "label"), "label", 1000, id_col="vec_id")


@query(
    "bootstrap_stats",
    f"""WITH d AS (SELECT doc_id, text, {sql_space('text')} AS tokens FROM {DOCS} WHERE corpus = 'real'),
    picked AS (SELECT seed, doc_id FROM (SELECT seed, doc_id, row_number() OVER (PARTITION BY seed
        ORDER BY md5(seed || ':' || doc_id), doc_id) AS r FROM d, (SELECT unnest(range(10)) AS seed)) WHERE r <= 1000),
    lens AS (SELECT seed, avg(len(tokens)) AS a, stddev_pop(len(tokens)) AS s, avg(length(text)) AS c
        FROM picked JOIN d USING (doc_id) GROUP BY seed),
    counts AS (SELECT seed, token, count(*) AS n FROM (SELECT seed, unnest(tokens) AS token FROM picked JOIN d USING (doc_id))
        GROUP BY seed, token),
    words AS (SELECT seed, count(*) / sum(n) AS ttr, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / count(*) AS hapax FROM counts GROUP BY seed)
    SELECT round(avg(a), 6) AS avg_len_tokens, round(avg(s), 6) AS std_len_tokens, round(avg(c), 6) AS avg_len_chars,
        round(avg(ttr), 6) AS ttr, round(avg(hapax), 6) AS hapax_ratio FROM lens JOIN words USING (seed)""",
)
def bootstrap_stats(spark, folder):
    real = documents(spark, folder).where("corpus = 'real'").select("doc_id", "text")
    mean = sp.repeated_sample_mean(
        lambda rows, group: stats.token_stats(rows, corpus_col=group), real, 1000, list(range(10))
    )
    names = ("avg_len_tokens", "std_len_tokens", "avg_len_chars", "ttr", "hapax_ratio")
    return rounded(mean.select(*names), *names)


@query(
    "balanced_by_repeats",
    f"""WITH d AS (SELECT doc_id, CASE WHEN source IN ('src1', 'src2', 'src3') THEN 'synthetic' ELSE 'real' END AS corpus FROM {DOCS}),
    s AS (SELECT count(*) FILTER (WHERE corpus = 'real') AS big, count(*) FILTER (WHERE corpus = 'synthetic') AS small FROM d),
    c AS (SELECT doc_id, corpus, row_number() OVER (ORDER BY doc_id) AS r FROM d WHERE corpus = 'synthetic')
    SELECT doc_id, corpus, 1 AS copy FROM d WHERE corpus = 'real'
    UNION ALL SELECT doc_id, corpus, copy FROM c, s, (SELECT unnest(range(1, 1000)) AS copy)
    WHERE copy <= big // small AND (copy - 1) * small + r <= big""",
)
def balanced_by_repeats(spark, folder):
    side = F.when(F.col("source").isin("src1", "src2", "src3"), "synthetic").otherwise("real")
    return sp.balance_by_repeats(table(spark, folder, "documents").select("doc_id", side.alias("corpus")))


@query(
    "stratified_split",
    f"""WITH c AS (SELECT corpus, count(*) AS n, sum(count(*)) OVER () AS total FROM {DOCS} GROUP BY corpus),
    k AS (SELECT *, total - ceil(total * 0.3::DOUBLE) AS keep FROM c),
    f AS (SELECT *, floor(n * keep / total) AS whole, (n * keep) % total AS rest FROM k),
    g AS (SELECT corpus, n - whole - CASE WHEN row_number() OVER (ORDER BY rest DESC, corpus) <= keep - sum(whole) OVER () THEN 1 ELSE 0 END AS size FROM f)
    SELECT doc_id, corpus, CASE WHEN r <= size THEN 'test' ELSE 'train' END AS split FROM (
        SELECT doc_id, corpus, row_number() OVER (PARTITION BY corpus ORDER BY md5('42:' || doc_id), doc_id) AS r FROM {DOCS})
    JOIN g USING (corpus)""",
)
def stratified_split(spark, folder):
    return sp.split(documents(spark, folder).select("doc_id", "corpus"), 0.3, label_col="corpus")


@query(
    "plain_split",
    """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id)
       <= ceil((SELECT count(*) FROM documents) * 0.1::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM documents""",
)
def plain_split(spark, folder):
    return sp.split(table(spark, folder, "documents").select("doc_id"), 0.1)


@query(
    "batch_numbers",
    """SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 15 AS batch_id,
       CAST(ceil(count(*) OVER () / 15.0) AS BIGINT) AS n_batches FROM documents""",
)
def batch_numbers(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id")
    return attach_row(sp.batches(docs, 15), docs.agg(sp.batch_count(F.count(F.lit(1)), 15).alias("n_batches")))


TEXT_IDS = "(SELECT concat('id-', md5(CAST(doc_id AS VARCHAR))) AS uuid, lang FROM documents)"


def text_ids(spark, folder):
    return table(spark, folder, "documents").select(F.concat(F.lit("id-"), F.md5(F.col("doc_id").cast("string"))).alias("uuid"), "lang")


@query("batch_numbers_text_id", f"SELECT uuid, (row_number() OVER (ORDER BY uuid) - 1) // 15 AS batch_id FROM {TEXT_IDS}")
def batch_numbers_text_id(spark, folder):
    return sp.batches(text_ids(spark, folder).select("uuid"), 15, "uuid")


@query("seeded_sample_text_id", f"SELECT uuid, lang FROM {TEXT_IDS} ORDER BY md5('42:' || uuid), uuid LIMIT 400")
def seeded_sample_text_id(spark, folder):
    return sp.sample_exact(text_ids(spark, folder), 400, id_col="uuid")


@query(
    "batch_numbers_large_id",
    "SELECT big_id, (row_number() OVER (ORDER BY big_id) - 1) // 15 AS batch_id FROM (SELECT doc_id + 1152921504606846976 AS big_id FROM documents)",
)
def batch_numbers_large_id(spark, folder):
    ids = table(spark, folder, "documents").select((F.col("doc_id") + F.lit(2**60)).alias("big_id"))
    return sp.batches(ids, 15, "big_id")


@query(
    "seeded_sample_shared_ids",
    """SELECT kind, id FROM (SELECT 'document' AS kind, doc_id AS id FROM documents UNION ALL SELECT 'vector', vec_id FROM embeddings)
       ORDER BY md5('42:' || kind || ':' || id), kind, id LIMIT 300""",
)
def seeded_sample_shared_ids(spark, folder):
    docs = table(spark, folder, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"))
    vectors = table(spark, folder, "embeddings").select(F.lit("vector").alias("kind"), F.col("vec_id").alias("id"))
    return sp.sample_exact(docs.unionByName(vectors), 300, id_col=["kind", "id"])


@query(
    "owner_shares",
    """SELECT doc_id, list_extract(['ana', 'ben', 'cem'], CAST(ntile(3) OVER (ORDER BY doc_id) AS INTEGER)) AS person
       FROM documents""",
)
def owner_shares(spark, folder):
    return sp.equal_shares(table(spark, folder, "documents").select("doc_id"), ("ana", "ben", "cem"))


@query(
    "stratified_folds",
    f"""SELECT vec_id, corpus, CAST((row_number() OVER (PARTITION BY corpus ORDER BY md5('42:' || vec_id), vec_id) - 1) % 5
        AS INTEGER) AS fold FROM {VECS}""",
)
def stratified_folds(spark, folder):
    return sp.folds(embeddings(spark, folder).select("vec_id", "corpus"), 5, "corpus", id_col="vec_id")


@query(
    "hash_row_numbers",
    f"""SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) AS place,
        count(*) OVER (PARTITION BY lang) AS n FROM {DOCS}""",
)
def hash_row_numbers(spark, folder):
    ranked = hash_rank(table(spark, folder, "documents").select("doc_id", "lang"), 7, by=["lang"], name="place", total="n")
    return ranked.select("doc_id", "lang", "place", "n")

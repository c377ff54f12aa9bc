"""Sources and sinks: data derived from the tables is written, read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import DOCS, documents, query, table
from corpometer.functions.prompts import pick_topic, topic_list
from corpometer.operators import reports, stats
from corpometer.operators.sampling import batches
from corpometer.operators.tables import without_index
from corpometer.session import fresh_path
from corpometer.sources import readers, writers

STAMP = "2025-11-09 08:51:46"


@query("csv_scan", "SELECT text AS article FROM documents")
def csv_scan(spark, folder):
    path = fresh_path(spark, "articles-csv")
    writers.write_csv(table(spark, folder, "documents").select("doc_id", F.col("text").alias("article")), path)
    return readers.read_articles(spark, path, "article", file_format="csv")


@query("jsonl_scan", "SELECT text AS generated_article FROM documents")
def jsonl_scan(spark, folder):
    path = fresh_path(spark, "articles-jsonl")
    writers.write_jsonl(
        table(spark, folder, "documents").select("doc_id", F.col("text").alias("generated_article")), path
    )
    return readers.read_articles(spark, path, "generated_article", file_format="jsonl")


@query(
    "tolerant_csv_scan",
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, CASE WHEN lang = 'fr' THEN NULL ELSE source END AS source
       FROM documents WHERE lang <> 'de'""",
)
def tolerant_csv_scan(spark, folder):
    """Lines of one language get a field too many, those of another one too few."""
    path = fresh_path(spark, "bad-lines")
    line = (
        F.when(F.col("lang") == "de", F.concat_ws(",", "doc_id", "lang", "source", F.lit("é")))
        .when(F.col("lang") == "fr", F.concat_ws(",", "doc_id", "lang"))
        .otherwise(F.concat_ws(",", "doc_id", "lang", "source"))
    )
    head = "doc_id,lang,source"
    docs = table(spark, folder, "documents").select(F.concat(line, F.lit("")).alias("value"))
    # Each part file of a header-bearing CSV starts with the header, as Spark's own writer leaves it.
    parts = docs.select(F.col("value").alias(head))
    parts.write.options(header=True, quote="", encoding="ISO-8859-1", sep="\u0001", emptyValue="").csv(path)
    return readers.read_csv_tolerant(spark, path, ["doc_id", "lang", "source"])


@query("stacked_csv_scan", "SELECT doc_id, text AS generated_text FROM documents")
def stacked_csv_scan(spark, folder):
    """Three tables, one with a saved row index, on top of each other."""
    docs = table(spark, folder, "documents").select("doc_id", F.col("text").alias("generated_text"), "lang")
    frames = []
    for name, part in (
        ("en", docs.where("lang = 'en'").select(F.col("doc_id").alias("Unnamed: 0"), "doc_id", "generated_text")),
        ("de", docs.where("lang = 'de'").drop("lang")),
        ("other", docs.where("lang NOT IN ('en', 'de')").drop("lang")),
    ):
        path = fresh_path(spark, f"stack-{name}")
        writers.write_csv(part, path)
        frames.append(readers.read_csv(spark, path))
    stacked = without_index(readers.read_stacked(frames))
    return stacked.select(F.col("doc_id").cast("bigint").alias("doc_id"), "generated_text")


@query(
    "named_corpus_sample",
    "SELECT doc_id, text FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 300",
)
def named_corpus_sample(spark, folder):
    return readers.read_corpus(spark, f"{folder}/documents.parquet", ["doc_id", "text"], n=300, seed=42)


def _topic_sql(key: str, n: int) -> str:
    names = ", ".join("'" + t.replace("'", "''") + "'" for t in topic_list())
    return (
        f"list_extract([{names}], CAST(floor(CAST(('0x' || substr(md5('42:' || {key}), 1, 8)) AS BIGINT)"
        f" / 4294967296.0 * {n}) AS INTEGER) + 1)"
    )


@query(
    "article_files",
    f"""SELECT item_id AS idx, '{STAMP}' AS ts, {_topic_sql('item_id', 53)} AS topic, text AS article
        FROM benchmark""",
)
def article_files(spark, folder):
    """One text file per row, read back with number and time from its name."""
    path = fresh_path(spark, "article-files")
    rows = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("idx"),
        F.lit(STAMP).cast("timestamp").alias("ts"),
        pick_topic(42, "item_id").alias("topic"),
        F.col("text").alias("article"),
    )
    writers.write_article_files(rows, path)
    return readers.read_article_files(spark, path).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query(
    "run_log_files",
    """SELECT item_id AS idx, 'Write about item ' || item_id AS prompt, text AS output,
       CAST(length(text) AS DOUBLE) / 4 AS seconds FROM benchmark""",
)
def run_log_files(spark, folder):
    path = fresh_path(spark, "run-logs")
    rows = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("idx"),
        F.lit(STAMP).cast("timestamp").alias("ts"),
        F.concat(F.lit("Write about item "), F.col("item_id")).alias("prompt"),
        F.col("text").alias("output"),
        (F.length("text").cast("double") / 4).alias("seconds"),
    )
    writers.write_run_logs(rows, path)
    return readers.read_run_logs(spark, path).drop("ts")


@query("csv_table_write", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_table_write(spark, folder):
    path = fresh_path(spark, "full-csv")
    docs = table(spark, folder, "documents")
    writers.write_csv(docs, path)
    return readers.read_csv(spark, path, schema=docs.schema)


def _batched(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("generated_text"))
    return batches(docs, 250, "id")


BATCHED = "(SELECT doc_id AS id, text, (row_number() OVER (ORDER BY doc_id) - 1) // 250 AS batch_id FROM documents)"


@query(
    "batch_output",
    f"""SELECT id, CASE WHEN batch_id = 0 THEN 'again ' || text ELSE text END AS generated_text, batch_id
        FROM {BATCHED}""",
)
def batch_output(spark, folder):
    """All batches are written, then the first one is written again and replaces only itself."""
    path = fresh_path(spark, "batches")
    rows = _batched(spark, folder)
    writers.write_batches(rows, path)
    again = rows.where("batch_id = 0").withColumn("generated_text", F.concat(F.lit("again "), "generated_text"))
    writers.write_batches(again, path)
    return writers.read_batches(spark, path, "id bigint, generated_text string")


@query("cumulative_output", f"SELECT id, text AS generated_text FROM {BATCHED} WHERE batch_id <= 1")
def cumulative_output(spark, folder):
    path = fresh_path(spark, "cumulative")
    writers.write_batches(_batched(spark, folder), path)
    return writers.read_batches(spark, path, "id bigint, generated_text string", upto=1).drop("batch_id")


@query(
    "json_report",
    f"""SELECT corpus, '{{"n_docs":' || count(*) || ',"avg_len_chars":'
        || CAST(round(avg(length(text)), 3) AS VARCHAR) || ',"longest":' || max(length(text)) || '}}' AS report
        FROM {DOCS} GROUP BY corpus""",
)
def json_report(spark, folder):
    """Nested report written as JSON, read back, parsed and put together again."""
    path = fresh_path(spark, "report-json")
    table_ = documents(spark, folder).groupBy("corpus").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.round(F.avg(F.length("text")), 3).alias("avg_len_chars"),
        F.max(F.length("text")).cast("bigint").alias("longest"),
    )
    writers.write_report_json(reports.json_report(table_), path)
    read = readers.read_jsonl(spark, path, "corpus string, report string")
    return reports.json_report(reports.from_json_report(read, "n_docs bigint, avg_len_chars double, longest bigint"))


@query(
    "metric_store",
    f"""SELECT corpus, metric, round(value, 6) AS value FROM (
        SELECT corpus, 'n_docs' AS metric, CAST(count(*) AS DOUBLE) AS value FROM {DOCS} GROUP BY corpus
        UNION ALL SELECT corpus, 'avg_len_chars', avg(length(text)) FROM {DOCS} GROUP BY corpus)""",
)
def metric_store(spark, folder):
    """Metrics of all kinds are stored; two of them are read back by folder."""
    path = fresh_path(spark, "metrics")
    writers.write_metrics(stats.long_form(stats.length_stats(documents(spark, folder))), path)
    read = writers.read_metrics(spark, path, "n_docs", "avg_len_chars")
    return read.select("corpus", "metric", F.round("value", 6).alias("value"))


@query(
    "nested_report_csv",
    f"""SELECT lang, '{{"n":' || count(*) || ',"chars":' || sum(length(text)) || '}}' AS stats,
        '[' || min(doc_id) || ',' || max(doc_id) || ']' AS ends FROM {DOCS} GROUP BY lang""",
)
def nested_report_csv(spark, folder):
    path = fresh_path(spark, "nested-csv")
    nested = documents(spark, folder).groupBy("lang").agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).alias("stats"),
        F.array(F.min("doc_id"), F.max("doc_id")).alias("ends"),
    )
    writers.write_report_csv(nested, path)
    return readers.read_csv(spark, path)

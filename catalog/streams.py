"""Streams run to the end of what has arrived; the result equals the batch query."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import DOCS, documents, query, rounded, sql_space, table
from catalog.files import STAMP, _topic_sql
from corpometer.functions import text as T
from corpometer.functions.prompts import pick_topic
from corpometer.operators import sketches, stats
from corpometer.session import fresh_path
from corpometer.sources import writers
from corpometer.streaming import ingest


@query(
    "article_ingest",
    f"SELECT item_id AS idx, {_topic_sql('item_id', 53)} AS topic, text AS article FROM benchmark",
)
def article_ingest(spark, folder):
    """Article files arrive in two steps; the stream is stopped in between and goes on."""
    inbox, sink, checkpoint = (fresh_path(spark, n) for n in ("inbox", "ingested", "ingest-checkpoint"))
    rows = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("idx"),
        F.lit(STAMP).cast("timestamp").alias("ts"),
        pick_topic(42, "item_id").alias("topic"),
        F.col("text").alias("article"),
    )
    for step, part in enumerate((rows.where(F.length("article") < 500), rows.where(F.length("article") >= 500))):
        writers.write_article_files(part, f"{inbox}/step{step}")
        ingest.append_to_table(ingest.article_stream(spark, inbox), sink, checkpoint).awaitTermination()
    return spark.read.parquet(sink).drop("ts")


@query("table_ingest", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def table_ingest(spark, folder):
    sink, checkpoint = fresh_path(spark, "documents"), fresh_path(spark, "documents-checkpoint")
    schema = table(spark, folder, "documents").schema
    stream = ingest.table_stream(spark, folder, schema, "documents.parquet")
    ingest.append_to_table(stream, sink, checkpoint).awaitTermination()
    return spark.read.parquet(sink)


def _arriving(spark, folder, run):
    """Events in three parts by id, each behind the one before: ``run`` is called anew when a part has arrived."""
    inbox = fresh_path(spark, "events")
    events = table(spark, folder, "events")
    size = events.agg(F.max("event_id") + 1).scalar()
    for part in range(3):
        place = F.col("event_id") * 3
        events.where((place >= size * part) & (place < size * (part + 1))).write.mode("append").parquet(inbox)
        run(inbox, events.schema)


@query("stream_snapshots", "SELECT event_id, event_type, value FROM events")
def stream_snapshots(spark, folder):
    """Every file is a micro-batch; the stream starts three times and goes on where it was."""
    path, checkpoint = fresh_path(spark, "snapshots"), fresh_path(spark, "snapshots-checkpoint")

    def run(inbox, schema):
        stream = ingest.table_stream(spark, inbox, schema, files_per_trigger=1)
        ingest.snapshots(stream.select("event_id", "event_type", "value"), path, checkpoint).awaitTermination()

    _arriving(spark, folder, run)
    return ingest.snapshot(spark, path).drop(ingest.BATCH_COLUMN)


@query(
    "stream_running_stats",
    """SELECT event_type, count(*) AS n, round(sum(value), 6) AS total_seconds, round(avg(value), 6) AS avg_seconds
       FROM events GROUP BY event_type""",
)
def stream_running_stats(spark, folder):
    """Totals after three starts of the stream, each file a micro-batch; the state goes from one to the next."""
    path, checkpoint = fresh_path(spark, "running"), fresh_path(spark, "running-checkpoint")

    def run(inbox, schema):
        totals = ingest.running_stats(ingest.table_stream(spark, inbox, schema, files_per_trigger=1), "event_type", "value")
        ingest.keep_latest(totals, path, checkpoint).awaitTermination()

    _arriving(spark, folder, run)
    return rounded(ingest.latest(spark, path), "total_seconds", "avg_seconds")


@query(
    "stream_running_time",
    """SELECT event_type AS model, event_id AS batch_id, value AS elapsed_time, round(sum(value) OVER w, 6) AS total_time, row_number() OVER w AS done
       FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)""",
)
def stream_running_time(spark, folder):
    """Running totals of rows that arrive in three parts, as if they had come at once."""
    path, checkpoint = fresh_path(spark, "running-rows"), fresh_path(spark, "running-rows-checkpoint")

    def run(inbox, schema):
        stream = ingest.table_stream(spark, inbox, schema)
        named = stream.select(F.col("event_type").alias("model"), F.col("event_id").alias("batch_id"), F.col("value").alias("elapsed_time"))
        ingest.running_totals(named, path, checkpoint).awaitTermination()

    _arriving(spark, folder, run)
    rows = ingest.totals_so_far(spark, path).drop(ingest.BATCH_COLUMN)
    return rounded(rows, "total_time").select("model", "batch_id", "elapsed_time", "total_time", "done")


TERMS = 400
PART = "CAST(floor(doc_id * 3 / (SELECT max(doc_id) + 1 FROM documents)) AS INTEGER)"
SUMMARY = f"""toks AS (SELECT corpus, part, unnest(t) AS token FROM (SELECT corpus, {PART} AS part, {sql_space('text')} AS t FROM {DOCS})),
    c AS (SELECT corpus, part, token, count(*) AS n FROM toks GROUP BY corpus, part, token),
    cut AS (SELECT corpus, part, coalesce(max(n) FILTER (WHERE upto > {TERMS}), 0) AS cut FROM
        (SELECT corpus, part, n, sum(count(*)) OVER (PARTITION BY corpus, part ORDER BY n DESC ROWS UNBOUNDED PRECEDING) AS upto FROM c GROUP BY corpus, part, n) GROUP BY corpus, part),
    kept AS (SELECT corpus, part, token, n - cut AS n, cut AS short FROM c JOIN cut USING (corpus, part) WHERE n > cut),
    taken AS (SELECT corpus, sum(short) AS short FROM (SELECT corpus, part, max(short) AS short FROM kept GROUP BY corpus, part) GROUP BY corpus),
    s AS (SELECT corpus, token, sum(n) AS n FROM kept GROUP BY corpus, token),
    cut2 AS (SELECT corpus, coalesce(max(n) FILTER (WHERE upto > {TERMS}), 0) AS cut FROM
        (SELECT corpus, n, sum(count(*)) OVER (PARTITION BY corpus ORDER BY n DESC ROWS UNBOUNDED PRECEDING) AS upto FROM s GROUP BY corpus, n) GROUP BY corpus)"""


def _vocabulary(spark, folder):
    """Documents arrive in three parts by id; the stream starts anew for each."""
    path, checkpoint, inbox = (fresh_path(spark, n) for n in ("vocabulary", "vocabulary-checkpoint", "texts"))
    docs = documents(spark, folder).select("doc_id", "corpus", "text")
    size = docs.agg(F.max("doc_id") + 1).scalar()
    for part in range(3):
        docs.where(F.floor(F.col("doc_id") * 3 / size) == part).write.mode("append").parquet(inbox)
        stream = ingest.table_stream(spark, inbox, docs.schema)
        ingest.vocabulary(stream, path, checkpoint, lambda: T.space_tokens("text"), terms=TERMS).awaitTermination()
    return ingest.vocabulary_so_far(spark, path, terms=TERMS)


@query(
    "stream_frequent_terms",
    f"""WITH {SUMMARY} SELECT corpus, token, CAST(n - cut AS BIGINT) AS n, CAST(short + cut AS BIGINT) AS short FROM s JOIN taken USING (corpus) JOIN cut2 USING (corpus) WHERE n > cut""",
)
def stream_frequent_terms(spark, folder):
    """Counts of frequent terms merged from the summaries of three micro-batches, and what they may fall short by."""
    return _vocabulary(spark, folder)[1]


@query(
    "stream_types",
    f"""SELECT corpus, count(*) AS n_tokens, true AS within_error FROM (SELECT corpus, unnest({sql_space('text')}) AS token FROM {DOCS}) GROUP BY corpus""",
)
def stream_types(spark, folder):
    """Tokens so far, and whether the estimate of the types is as near to their number as it promises to be."""
    merged = _vocabulary(spark, folder)[0]
    exact = stats.vocabulary_stats(stats.token_counts(documents(spark, folder))).select("corpus", F.col("n_types").alias("exact"))
    near = F.abs(F.col("n_types") - F.col("exact")) <= F.col("exact") * sketches.type_error()
    return merged.join(exact, "corpus").select("corpus", F.col("n_tokens").cast("bigint").alias("n_tokens"), near.alias("within_error"))

"""Readers, writers and streams on files with the known awkward cases."""

import pytest
from pyspark.sql import functions as F

from catalog import QUERIES
from corpometer.operators import scoring, tables
from corpometer.session import cleared, fresh_path, shared_folder, spread, stored
from corpometer.sources import readers, writers
from corpometer.streaming import ingest


def test_csv_with_quotes_and_breaks(spark, tmp_path):
    path = tmp_path / "real.csv"
    path.write_text('article,id\n"one ""two"",\nthree",1\n,2\nplain,3\n', encoding="utf-8")
    got = [r["article"] for r in readers.read_articles(spark, str(path), "article").collect()]
    assert sorted(got) == ['one "two",\nthree', "plain"]
    assert readers.read_articles(spark, str(path), "article", n=1).count() == 1
    with pytest.raises(ValueError, match="has no column 'body'"):
        readers.read_articles(spark, str(path), "body")
    with pytest.raises(ValueError, match="give CSV or line-delimited JSON"):
        readers.read_articles(spark, str(tmp_path / "real.txt"), "article")


def test_jsonl_with_a_missing_field(spark, tmp_path):
    path = tmp_path / "made.jsonl"
    path.write_text('{"generated_article": "a"}\n{"other": 1}\n', encoding="utf-8")
    assert [r[0] for r in readers.read_articles(spark, str(path), "generated_article").collect()] == ["a"]


def test_sample_of_equal_texts_is_exact(spark, tmp_path):
    path = tmp_path / "copies.csv"
    path.write_text("article\n" + "same\n" * 50 + "other\n" * 5, encoding="utf-8")
    assert readers.read_articles(spark, str(path), "article", n=20).count() == 20


def test_tolerant_csv(spark, tmp_path):
    path = tmp_path / "train.csv"
    path.write_bytes('cleaner_article,n\ncaf\xe9,1\n"a, b",2\ntoo,many,fields\nshort\n'.encode("latin-1"))
    got = readers.read_csv_tolerant(spark, str(path), ["cleaner_article", "n"])
    assert sorted(map(tuple, got.collect())) == [("a, b", "2"), ("café", "1"), ("short", None)]
    assert sorted(r[0] for r in got.select("cleaner_article").collect()) == ["a, b", "café", "short"]


def test_tolerant_csv_with_breaks_in_quotes(spark, tmp_path):
    path = tmp_path / "train.csv"
    path.write_text('n,text\n1,"line one\nline two, more"\n2,a,b\n3\n', encoding="latin-1")
    got = readers.read_csv_tolerant(spark, str(path), ["n", "text"]).collect()
    assert sorted(map(tuple, got)) == [("1", "line one\nline two, more"), ("3", None)]


def test_sample_of_a_file_does_not_follow_its_splits(spark, tmp_path):
    lines = [f"text {i % 60}" for i in range(200)]
    one, many = tmp_path / "one.csv", tmp_path / "many.csv"
    one.write_text("article\n" + "\n".join(lines) + "\n")
    many.mkdir()
    for k in range(4):
        (many / f"{k}.csv").write_text("article\n" + "\n".join(lines[k::4]) + "\n")
    samples = [sorted(r[0] for r in readers.read_articles(spark, str(p), "article", n=70, file_format="csv").collect()) for p in (one, many)]
    assert samples[0] == samples[1] and len(samples[0]) == 70


def test_article_files_keep_repeats_and_ends(spark, tmp_path):
    rows = [(1, "A", "text one  \n"), (1, "A", "text two"), (2, "B", " ")]
    df = spark.createDataFrame(rows, "idx int, topic string, article string").withColumn("ts", F.lit("2025-11-09 08:51:46").cast("timestamp"))
    path = str(tmp_path / "out")
    writers.write_article_files(df, path)
    (tmp_path / "out" / "notes.txt").write_text("not an article")
    got = readers.read_article_files(spark, path).collect()
    assert sorted((r["idx"], r["topic"], r["article"]) for r in got) == sorted(rows)


def test_article_and_run_log_files(spark, tmp_path):
    (tmp_path / "article_0003_20251109_085146.txt").write_text("Topic: Science - Space\n\nOne.\n\nTopic: not this\nTwo.")
    (tmp_path / "article_12345_20251109_085146.txt").write_text("Topic: Empty\n\n")
    got = {r["idx"]: r for r in readers.read_article_files(spark, str(tmp_path)).collect()}
    assert got[3]["topic"] == "Science - Space" and got[3]["article"] == "One.\n\nTopic: not this\nTwo."
    assert str(got[3]["ts"]) == "2025-11-09 08:51:46" and got[12345]["article"] == ""
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "article_01_20251109_085146.txt").write_text(
        "### PROMPT USED ###\nWrite.\n\n### MODEL OUTPUT ###\nA\n### inner ###\nB\n\n### GENERATION TIME: 1.50 seconds ###\n"
    )
    row = readers.read_run_logs(spark, str(logs)).first()
    assert (row["idx"], row["prompt"], row["output"], row["seconds"]) == (1, "Write.", "A\n### inner ###\nB", 1.5)


def test_batches_replace_only_themselves(spark):
    path = fresh_path(spark, "batches")
    rows = spark.range(6).select("id", F.concat(F.lit("t"), "id").alias("generated_text"), F.floor(F.col("id") / 2).alias("batch_id"))
    writers.write_batches(rows, path)
    writers.write_batches(rows.where("batch_id = 1").withColumn("generated_text", F.lit("new")), path)
    got = writers.read_batches(spark, path, "id bigint, generated_text string")
    assert [r["generated_text"] for r in got.orderBy("id").collect()] == ["t0", "t1", "new", "new", "t4", "t5"]
    assert writers.read_batches(spark, path, "id bigint, generated_text string", upto=1).count() == 4


def test_metric_store(spark):
    path = fresh_path(spark, "metrics")
    rows = [("real", "ttr", 0.5), ("made", "ttr", 0.4), ("real", "ppl", 9.0)]
    metrics = spark.createDataFrame(rows, "corpus string, metric string, value double")
    writers.write_metrics(metrics, path)
    writers.write_metrics(metrics.where("metric = 'ppl'").withColumn("value", F.lit(8.0)), path)
    got = {(r["corpus"], r["metric"]): r["value"] for r in writers.read_metrics(spark, path).collect()}
    assert got == {("real", "ttr"): 0.5, ("made", "ttr"): 0.4, ("real", "ppl"): 8.0}
    assert writers.read_metrics(spark, path, "ttr").count() == 2


def test_tables(spark):
    df = spark.createDataFrame([("1", "a"), ("id", "text"), (None, None)], "id string, text string")
    assert tables.without_header_rows(df).count() == 2
    assert tables.non_empty(df, "text").count() == 2
    made = spark.createDataFrame([("Error generating article: x",), ("ok",), (None,)], "generated_article string")
    assert [r[0] for r in tables.without_failed(made).collect()] == ["ok", None]
    with pytest.raises(ValueError, match="has no column"):
        tables.require_columns(df, "none")
    both = tables.labelled_union({0: df.select("id"), 1: df.select("id", "text")}, "label")
    assert both.columns == ["id", "label", "text"] and both.count() == 6


def test_stream_in_two_steps_equals_batch(spark, tmp_path):
    inbox, sink, checkpoint = tmp_path / "inbox", str(tmp_path / "sink"), str(tmp_path / "checkpoint")
    inbox.mkdir()
    for step in (1, 2):
        for i in range(3):
            (inbox / f"article_{step}00{i}_20251109_085146.txt").write_text(f"Topic: T{i}\n\nBody {step}")
        ingest.append_to_table(ingest.article_stream(spark, str(inbox), 2), sink, checkpoint).awaitTermination()
        assert spark.read.parquet(sink).count() == 3 * step
    batch = readers.read_article_files(spark, str(inbox))
    assert sorted(batch.collect()) == sorted(spark.read.parquet(sink).select(*batch.columns).collect())


def test_snapshots_and_running_stats(spark, tmp_path):
    inbox = tmp_path / "in"
    schema = "model string, elapsed_time double"
    snaps, totals = str(tmp_path / "snaps"), str(tmp_path / "totals")
    for step in range(2):
        spark.createDataFrame([("m", 1.0 + step), ("k", 2.0)], schema).coalesce(1).write.mode("append").parquet(str(inbox))
        stream = ingest.table_stream(spark, str(inbox), spark.read.schema(schema).parquet(str(inbox)).schema)
        ingest.snapshots(stream, snaps, str(tmp_path / "c1")).awaitTermination()
        ingest.keep_latest(ingest.running_stats(stream), totals, str(tmp_path / "c2")).awaitTermination()
    assert ingest.snapshot(spark, snaps, 0).count() == 2 and ingest.snapshot(spark, snaps).count() == 4
    got = {r["model"]: tuple(r[1:]) for r in ingest.latest(spark, totals).collect()}
    assert got == {"m": (2, 3.0, 1.5), "k": (2, 4.0, 2.0)}


def test_failed_batch_keeps_the_run_going(spark):
    rows = [("r", i, t) for i, t in enumerate(["ok", None, "", "bad", "fine", "ok"])]
    df = spark.createDataFrame(rows, "corpus string, doc_id bigint, text string").coalesce(1)

    def make():
        def score(texts):
            if "bad" in texts:
                raise RuntimeError("no")
            return [float(len(t)) for t in texts], [1] * len(texts)

        return score

    got = {r["doc_id"]: (r["nll"], r["n_tokens"], r["error"]) for r in scoring.score_batches(df, make, 3).collect()}
    assert got[0] == (2.0, 1, None) and got[1] == (0.0, 0, None) == got[2]
    assert got[3] == got[4] == got[5] == (0.0, 0, "RuntimeError: no")


def test_stored_tables_go_with_their_scope(spark, tmp_path):
    with cleared(spark):
        inner = stored(spark.range(3), "inner")
        inner.write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    with pytest.raises(Exception, match="exist"):
        inner.count()


def test_session_helpers(spark):
    assert fresh_path(spark, "x") != fresh_path(spark, "x") and fresh_path(spark, "x").startswith(shared_folder(spark))
    df = spark.range(5)
    assert stored(df).orderBy("id").collect() == df.orderBy("id").collect()
    assert spread(spark.range(0, 10, 1, 1), "id").rdd.getNumPartitions() == 4
    assert spread(spark.range(0, 10, 1, 9), "id").rdd.getNumPartitions() == 9


def test_article_files_have_names_of_their_own(spark, tmp_path):
    rows = [(i, f"T{i % 3}", f"text {i}") for i in range(40)] + [(7, "T1", "again"), (7, "T1", "again"), (12345, "T", "é\n\n"), (None, "T", "no name")]
    df = spark.createDataFrame(rows, "idx int, topic string, article string").repartition(5).withColumn("ts", F.lit("2025-11-09 08:51:46").cast("timestamp"))
    path = tmp_path / "out"
    writers.write_article_files(df, str(path))
    names = sorted(p.name for p in path.iterdir())
    assert names == sorted([f"article_{i:04d}_20251109_085146.txt" for i in (*range(40), 12345)] + [f"article_0007_20251109_085146_{k}.txt" for k in (2, 3)])
    assert (path / "article_0012_20251109_085146.txt").read_text() == "Topic: T0\n\ntext 12\n"
    got = readers.read_article_files(spark, str(path)).collect()
    assert sorted((r.idx, r.topic, r.article) for r in got) == sorted(r for r in rows if r[0] is not None)
    # Written again, the files before go; when a task fails, they stay and no part of the new ones does.
    writers.write_article_files(df.where("idx < 3"), str(path))
    assert len(list(path.iterdir())) == 3
    bad = df.withColumn("article", F.when(F.col("idx") == 20, F.raise_error(F.lit("stop")).cast("string")).otherwise(F.col("article")))
    with pytest.raises(Exception, match="stop"):
        writers.write_article_files(bad, str(path))
    assert sorted(p.name for p in path.iterdir()) == [f"article_{i:04d}_20251109_085146.txt" for i in range(3)]


def test_running_totals_go_on_behind_a_restart(spark, tmp_path):
    schema = "model string, batch_id int, elapsed_time double"
    steps = [[("m", 1, 1.0), ("k", 2, 5.0), ("m", 3, 2.0)], [("m", 5, 4.0), ("m", 4, 8.0)], [("k", 6, 1.0), ("n", 7, 3.0), (None, 8, 2.0)]]
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    for step in steps:
        spark.createDataFrame(step, schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = ingest.table_stream(spark, inbox, spark.read.parquet(inbox).schema)
        ingest.running_totals(stream, out, str(tmp_path / "checkpoint")).awaitTermination()
    got = sorted(tuple(r) for r in ingest.totals_so_far(spark, out).select("batch_id", "total_time", "done", ingest.BATCH_COLUMN).collect())
    assert got == [(1, 1.0, 1, 0), (2, 5.0, 1, 0), (3, 3.0, 2, 0), (4, 11.0, 3, 1), (5, 15.0, 4, 1), (6, 6.0, 2, 2), (7, 3.0, 1, 2), (8, 2.0, 1, 2)]


def test_scorer_takes_ids_of_any_type(spark):
    df = spark.createDataFrame([("r", "a7", "ok"), ("r", "b", None)], "corpus string, doc_id string, text string")
    got = scoring.score_batches(df, lambda: lambda texts: ([1.0] * len(texts), [1] * len(texts))).collect()
    assert sorted((r.doc_id, r.nll) for r in got) == [("a7", 1.0), ("b", 0.0)]


@pytest.mark.parametrize("files", [None, 1, 3])
def test_table_ingest_of_a_file_and_of_folders(spark, tmp_path, files):
    """A table is one file, or a folder of files as Spark writes it."""
    rows = [(i, f"text {i}", "en", f"src{i}", i) for i in range(20)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    whole = tmp_path / "tables" / "documents.parquet"
    docs.repartition(files or 1).write.parquet(str(whole if files else tmp_path / "apart"))
    if files is None:
        whole.parent.mkdir()
        next((tmp_path / "apart").glob("part-*")).rename(whole)
    docs.write.parquet(str(tmp_path / "tables" / "others.parquet"))
    got = [tuple(r) for r in QUERIES["table_ingest"](spark, str(whole.parent)).collect()]
    assert sorted(got, key=str) == sorted(rows, key=str)

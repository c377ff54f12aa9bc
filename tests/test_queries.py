"""Registered queries against their SQL on the smallest tables, and rules for the library's source."""

import math
import re
from pathlib import Path

import pytest

import __spark_entry__ as entry_points

DATA = Path("/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parents[1]
TABLES = "documents embeddings labels benchmark conversations events".split()
QUICK = (
    "corpus_stats side_by_side_stats document_frequency seeded_sample capped_per_label stratified_split plain_split "
    "stratified_folds batch_numbers balanced_by_repeats roc_auc class_report length_histogram length_density "
    "wasserstein_per_direction window_pair_counts topic_coherence corpus_perplexity document_losses running_time "
    "batch_numbers_text_id batch_numbers_large_id seeded_sample_text_id seeded_sample_shared_ids embedding_density_grid scored_rows "
    "bag_of_words token_ids time_left tfidf_weights pad_mask_labels topic_prompts chat_text tolerant_csv_scan article_files json_report"
).split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    return value


@pytest.fixture(scope="module")
def database():
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return db


@pytest.mark.skipif(not DATA.exists(), reason="tables are not there")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, database, name):
    df = entry_points.queries()[name](spark, str(DATA))
    cursor = database.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in cursor.fetchall()), key=repr)
    assert got == want


@pytest.mark.skipif(not DATA.exists(), reason="tables are not there")
def test_entry(spark):
    assert entry_points.entry(spark).count() == 2


def test_names_match():
    queries, oracle = entry_points.queries(), entry_points.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 100


def test_library_source_stays_distributed():
    banned = r"\.collect\(|toPandas\(|crossJoin\(|localCheckpoint\(|\.rdd\.(?!getNumPartitions)|foreachPartition|toLocalIterator"
    one_task = r"numPartitions=1\b|partitions: int = 1\b|(?<!F)\.coalesce\(1\)|repartition\(1\)"
    # What comes to the driver is one row, or a table whose rows are bounded before it is read.
    brought = {"toArrow(": {"operators/joins.py": 1}, ".first()": {"operators/ranks.py": 1, "plans/topics.py": 1, "plans/embed.py": 1, "streaming/ingest.py": 1}}
    library = ROOT / "corpometer"
    for path in library.rglob("*.py"):
        name, text = path.relative_to(library).as_posix(), path.read_text()
        assert not re.search(banned, text) and not re.search(one_task, text), path
        for call, allowed in brought.items():
            if not name.startswith("llm/"):
                assert text.count(call) == allowed.get(name, 0), (path, call)


@pytest.mark.skipif(not DATA.exists(), reason="tables are not there")
@pytest.mark.parametrize(
    "name",
    "corpus_stats token_stats seeded_sample seeded_sample_shared_ids stratified_split stratified_folds batch_numbers batch_numbers_text_id "
    "running_time time_left wasserstein_per_direction document_losses corpus_perplexity bag_of_words tfidf_weights token_ids".split(),
)
def test_plans_have_no_single_task_exchange_of_rows(spark, name):
    plan = entry_points.queries()[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    rows, _, subqueries = plan.partition("Subquery")
    assert "CartesianProduct" not in plan and "SinglePartition" not in rows

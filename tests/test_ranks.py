"""Ranks, running sums, samples and splits against plain Python on groups with heavy keys."""

import hashlib
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpometer.operators import joins, ranks
from corpometer.operators import sampling as sp


def md5(seed, key):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark):
    """One label holds most rows; one row has no label at all."""
    data = [(i, "hot" if i % 10 else f"l{i % 3}") for i in range(600)] + [(600, None)]
    return spark.createDataFrame(data, "doc_id bigint, label string").cache()


def test_hash_rank_equals_sorted_order(rows):
    got = {r["doc_id"]: (r["rank"], r["n"]) for r in ranks.hash_rank(rows, 42, by=["label"], total="n").collect()}
    groups = {}
    for r in rows.collect():
        groups.setdefault(r["label"], []).append(r["doc_id"])
    for ids in groups.values():
        order = sorted(ids, key=lambda i: (md5(42, i), i))
        assert [got[i][0] for i in order] == list(range(1, len(ids) + 1))
        assert {got[i][1] for i in ids} == {len(ids)}
    assert len(got) == 601


@pytest.mark.parametrize("n", [0, 1, 7, 600, 601, 5000, -1])
def test_sample_is_exact_and_repeatable(rows, n):
    got = [r["doc_id"] for r in sp.sample_exact(rows, n).collect()]
    order = sorted(range(601), key=lambda i: (md5(42, i), i))
    assert sorted(got) == sorted(order if n == -1 else order[:n])


def test_cap_per_label(rows):
    got = sp.sample_per_label(rows, "label", 15).collect()
    have = Counter(r["label"] for r in rows.collect())
    assert Counter(r["label"] for r in got) == {k: min(v, 15) for k, v in have.items()}


def test_split_sizes(rows):
    named = rows.where("label IS NOT NULL")
    got = Counter((r["label"], r["split"]) for r in sp.split(named, 0.3, "label").collect())
    assert sum(v for (_, s), v in got.items() if s == "test") == 180
    have = Counter(r["label"] for r in named.collect())
    for label, n in have.items():
        assert abs(got[(label, "test")] - 0.3 * n) < 1
    plain = Counter(r["split"] for r in sp.split(rows, 0.1).collect())
    assert plain == {"test": 61, "train": 540}


def test_folds_are_even(rows):
    got = Counter((r["label"], r["fold"]) for r in sp.folds(rows, 5, "label").collect())
    for label in {k for k, _ in got}:
        sizes = [got.get((label, f), 0) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_batches_and_shares(rows):
    got = {r["doc_id"]: r["batch_id"] for r in sp.batches(rows, 50).collect()}
    assert got == {i: i // 50 for i in range(601)}
    owners = Counter(r["person"] for r in sp.equal_shares(rows, ("a", "b", "c", "d")).collect())
    assert owners == {"a": 151, "b": 150, "c": 150, "d": 150}
    few = sp.equal_shares(rows.where("doc_id < 2"), ("a", "b", "c")).collect()
    assert sorted(r["person"] for r in few) == ["a", "b"]


def test_balance_by_repeats(spark):
    df = spark.createDataFrame([(i, "real" if i < 11 else "synthetic") for i in range(15)], "doc_id bigint, corpus string")
    sizes = Counter(r["corpus"] for r in sp.balance_by_repeats(df).collect())
    assert sizes == {"real": 11, "synthetic": 8}
    cut = sp.balance_by_repeats(df, repeats=3).where("corpus = 'synthetic'").collect()
    assert sorted((r["copy"], r["doc_id"]) for r in cut) == [(c, d) for c in (1, 2) for d in range(11, 15)] + [
        (3, d) for d in range(11, 14)
    ]


def test_stand_in_corpus(spark):
    df = spark.createDataFrame([(i, f"CNN {i} CNN") for i in range(5)], "doc_id bigint, text string")
    got = sp.stand_in_corpus(df, "CNN", "GMN").collect()
    assert sorted(r["text"] for r in got) == ["GMN 0 GMN", "GMN 1 GMN"]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(
            st.sampled_from(["a", "a", "a", "b"]),
            st.one_of(st.integers(-5, 5).map(float), st.floats(-1e12, 1e12), st.sampled_from([1e-9, 2e-9])),
            st.integers(0, 9),
        ),
        min_size=1,
        max_size=60,
    )
)
def test_running_sums_equal_sorted_sums(spark, data):
    rows = [(i, g, v, w) for i, (g, v, w) in enumerate(data)]
    df = spark.createDataFrame(rows, "id bigint, g string, v double, w bigint")
    got = ranks.running_sums(df, "v", {"s": F.col("w")}, by=["g"], ties=["id"], following="nxt", ranges=4)
    out = {r["id"]: (r["s"], r["nxt"]) for r in got.collect()}
    assert len(out) == len(rows)
    for group in {r[1] for r in rows}:
        total, order = 0, sorted((r for r in rows if r[1] == group), key=lambda r: (r[2], r[0]))
        for place, r in enumerate(order):
            total += r[3]
            following = order[place + 1][2] if place + 1 < len(order) else None
            assert out[r[0]] == (total, following)


def test_attach_above_the_limit_gives_the_same(spark):
    big = spark.range(100).select(F.col("id"), (F.col("id") % 7).alias("k"))
    small = spark.range(7).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    few, many = (sorted(joins.attach(big, small, ["k"], max_rows=m).collect()) for m in (100, 3))
    assert few == many and len(few) == 100
    assert joins.bounded(small, 6) is None and joins.bounded(small, 7).count() == 7


def test_lookup_keeps_all_rows(spark):
    big = spark.createDataFrame([(i, f"t{i % 3 if i % 2 else i}") for i in range(200)], "id int, token string")
    table = spark.createDataFrame([(f"t{i}", i, 1000 - i) for i in range(150)], "token string, token_id int, cf int")
    want = sorted(big.join(table.drop("cf"), "token", "left").collect(), key=str)
    for hot in (5, 10_000):
        assert sorted(joins.lookup(big, table, ["token"], "cf", "left", hot).collect(), key=str) == want
    inner = joins.lookup(big, table, ["token"], "cf", "inner", 5).count()
    assert inner == big.join(table, "token").count()
    with pytest.raises(ValueError):
        joins.lookup(big, table, ["token"], "cf", "outer")

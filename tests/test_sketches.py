"""Mergeable summaries against exact numbers."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpometer.functions import text as T
from corpometer.operators import distance, sketches
from corpometer.streaming import ingest


def test_quantiles_and_distances_are_within_their_error(spark):
    rng = np.random.default_rng(4)
    rows = [("real", i % 3, float(x)) for i, x in enumerate(rng.normal(size=6000))]
    rows += [("made", i % 3, float(x)) for i, x in enumerate(rng.gamma(2.0, size=4000))] + [("few", 0, 1.0), ("few", 0, 2.0)]
    rows += [("made", 0, None), ("made", 0, float("nan")), ("made", 0, float("inf"))]
    df = spark.createDataFrame(rows, "corpus string, direction int, value double").repartition(6)
    by = ["corpus", "direction"]
    halves = [sketches.value_sketches(df.where(F.pmod(F.hash("value"), F.lit(2)) == h), "value", by) for h in (0, 1)]
    merged = sketches.merged_sketches(halves[0].unionByName(halves[1]), by)
    sizes = {(r.corpus, r.direction): r.n for r in merged.collect()}
    assert sizes["real", 0] == 2000 and sizes["few", 0] == 2 and sum(n for (c, _), n in sizes.items() if c == "made") == 4000
    shares = (0.05, 0.5, 0.95)
    for r in sketches.sketched_quantiles(merged, shares, by).collect():
        values = np.array([x for c, d, x in rows if (c, d) == (r.corpus, r.direction) and x is not None and np.isfinite(x)])
        off = 2 * sketches.rank_error() + 1 / len(values)
        assert np.mean(values < r.value) - off <= r.share <= np.mean(values <= r.value) + off
    clean = df.where("value IS NOT NULL AND NOT isnan(value) AND value < 1e9")
    exact = {(r.corpus, r.direction): r.distance for r in distance.wasserstein_1d(clean, "real", ["made", "few"], by=["direction"]).collect()}
    found = sketches.sketched_distances(merged, "real", ["made", "few"]).collect()
    assert len(found) == 4
    for r in found:
        assert abs(r.distance - exact[r.corpus, r.direction]) <= r.error
    big = [r for r in found if r.corpus == "made"]
    assert all(r.error < 0.25 and r.distance > 1 for r in big)


def brute_reduced(counts, terms):
    cut = sorted(counts.values(), reverse=True)[terms] if len(counts) > terms else 0
    return {t: n - cut for t, n in counts.items() if n > cut}, cut


@pytest.mark.parametrize("terms", [3, 20, 1000])
def test_frequent_terms_fall_short_by_no_more_than_they_say(spark, terms):
    rng = random.Random(terms)
    words = [f"w{i}" for i in range(60)]
    texts = [(b, " ".join(rng.choices(words, [100 / (i + 1) for i in range(60)], k=40))) for b in range(4) for _ in range(15)]
    stored_types, stored_terms, want = None, None, Counter()
    total_short, merged_counts = 0, Counter()
    for b in range(4):
        df = spark.createDataFrame([("c", t) for x, t in texts if x == b], "corpus string, text string")
        types, frequent = sketches.vocabulary_sketches(df, T.space_tokens("text"), terms=terms)
        types, frequent = types.withColumn("batch", F.lit(b)), frequent.withColumn("batch", F.lit(b))
        own = Counter(w for x, t in texts if x == b for w in t.split())
        want += own
        left, cut = brute_reduced(own, terms)
        assert {r.token: (r.n, r.short) for r in frequent.collect()} == {t: (n, cut) for t, n in left.items()}
        total_short += cut
        merged_counts.update(left)
        stored_types = types if stored_types is None else stored_types.unionByName(types)
        stored_terms = frequent if stored_terms is None else stored_terms.unionByName(frequent)
    whole, frequent = sketches.merged_vocabulary(stored_types, stored_terms, terms=terms)
    row = whole.first()
    assert row.n_tokens == sum(want.values()) and abs(row.n_types - len(want)) <= max(1, len(want) * sketches.type_error())
    left, cut = brute_reduced(merged_counts, terms)
    got = {r.token: (r.n, r.short) for r in frequent.collect()}
    assert got == {t: (n, total_short + cut) for t, n in left.items()}
    assert all(n <= want[t] <= n + short for t, (n, short) in got.items())
    # What is not listed occurs no more often than a listed term may fall short by.
    assert all(want[t] <= total_short + cut for t in want if t not in got)
    if terms == 1000:
        assert {t: n for t, (n, _) in got.items()} == want


def test_vocabulary_of_a_stream(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [[("a", "x y z"), ("b", "x")], [("a", "x x q"), ("b", None)], [("c", "z z z")]]
    for part in parts:
        spark.createDataFrame(part, "corpus string, text string").coalesce(1).write.mode("append").parquet(inbox)
        stream = ingest.table_stream(spark, inbox, spark.read.parquet(inbox).schema)
        ingest.vocabulary(stream, out, str(tmp_path / "checkpoint"), lambda: T.space_tokens("text")).awaitTermination()
    whole, frequent = ingest.vocabulary_so_far(spark, out)
    assert sorted((r.corpus, r.n_types, r.n_tokens) for r in whole.collect()) == [("a", 4, 6), ("b", 1, 1), ("c", 1, 3)]
    assert sorted((r.corpus, r.token, r.n) for r in frequent.collect()) == [("a", "q", 1), ("a", "x", 3), ("a", "y", 1), ("a", "z", 1), ("b", "x", 1), ("c", "z", 3)]

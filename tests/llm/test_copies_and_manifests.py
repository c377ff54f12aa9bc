"""Exact copies, periodic runs and Merkle manifests against brute force on small tables."""

import hashlib
import random
import re
import zlib
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry_points
from corpometer.llm import bloom, catalog, merkle, repeats

DATA = Path("/root/testdata/sf0.001")
LONG = "word " * 60_000


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- exact copies ---


def brute_copies(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(sha(re.sub(r"[\x20\x09-\x0D]+", " ", t or "")), []).append(d)
    out = []
    for key, ids in groups.items():
        first = min((i for i in ids if i is not None), default=None)
        kept = ids.index(first)
        out += [(d, first, len(ids), i == kept, key) for i, d in enumerate(ids)]
    return sorted(out, key=str)


def copy_rows():
    rng = random.Random(4)
    rows = [(i, f"text {i // 3 if i < 90 else i}") for i in range(300)]
    rows += [(1000 + i, " the  same\ttext \n") for i in range(200)] + [(500, " the same text ")]
    rows += [(None, "text 0"), (None, "none has an id"), (None, "none has an id"), (900, None), (901, ""), (902, " "), (903, "\r\n")]
    rows += [(910, LONG), (911, LONG + " "), (912, LONG.strip()), (920, "a b"), (921, "a b"), (922, "a\x0bb"), (7, "text 2"), (7, "text 2")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("bits", [16, 1])
def test_copies_equal_brute_force(spark, bits):
    rows = copy_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS digest", "2 AS bitmap", "3 AS row")
    got = bloom.copies(docs, bits_per_row=bits)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_copies(rows)
    # A filter that is too full lets more rows through to the groups and changes nothing.
    assert bloom.copies(docs.limit(0)).count() == 0 and bloom.one_of_each(docs.limit(0)).count() == 0


def test_one_of_each_keeps_columns_and_first_rows(spark):
    rows = copy_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("text"), F.lit("-"))) for n in "digest maybe weight first found bloom_bits bloom_low _digest".split()})
    kept = bloom.one_of_each(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _, _, k, _ in brute_copies(rows) if k)
    assert all(r.maybe == "maybe" + ("-" if r.text is None else r.text) for r in got)


def test_filter_holds_every_repeated_digest(spark):
    rows = spark.range(3000).select(F.sha2((F.col("id") % 2500).cast("string"), 256).alias("digest"))
    found = bloom.repeat_filter(rows, "digest", 2)
    assert found.count() == 2
    marked = bloom._marked(rows, found, "digest", 2, "maybe").groupBy("digest").agg(F.count("*").alias("n"), F.max("maybe").alias("maybe")).collect()
    assert all(r.maybe for r in marked if r.n > 1)
    assert 0 < sum(r.maybe for r in marked if r.n == 1) < 100


# --- periodic runs ---


def brute_runs(words, min_length=24, min_exponent=3):
    n, found = len(words), {}
    for p in range(1, n // min_exponent + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(min_length, min_exponent * p):
                found.setdefault((i, j + p - i), p)  # periods ascend: the first is the smallest
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


words_of_few = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=80)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(words_of_few, st.integers(1, 6)), max_size=6), st.sampled_from([(24, 3), (4, 2), (1, 2), (9, 3), (6, 5)]))
def test_runs_equal_brute_force(parts, least):
    words = [w for part, times in parts for w in part * times]
    assert repeats.runs_of(repeats.word_codes(words), *least) == brute_runs(words, *least)


def test_runs_of_known_words():
    rng = random.Random(2)
    for n in range(0, 60):
        for words in ([b"x"] * n, [b"x", b"y"] * n, [b"%d" % rng.randrange(2) for _ in range(n)] * 4):
            assert repeats.runs_of(repeats.word_codes(words)) == brute_runs(words)
    fibonacci = [b"a", b"b"], [b"a"]
    for _ in range(9):
        fibonacci = (fibonacci[0] + fibonacci[1], fibonacci[0])
    for least in ((2, 2), (24, 3)):
        assert repeats.runs_of(repeats.word_codes(fibonacci[0]), *least) == brute_runs(fibonacci[0], *least)


def test_parts_of_the_suffixes_find_the_same(monkeypatch):
    rng = random.Random(5)
    words = [b"%d" % rng.randrange(3) for _ in range(700)] + [b"1", b"2", b"0"] * 60 + [b"7"] * 90
    whole = repeats.runs_of(repeats.word_codes(words), 6, 2)
    monkeypatch.setattr(repeats, "STRIDE", 50)
    assert repeats.runs_of(repeats.word_codes(words), 6, 2) == whole == brute_runs(words, 6, 2)


def test_suffix_arrays():
    rng = random.Random(3)
    for n in (1, 2, 7, 200):
        codes = np.array([rng.randrange(3) for _ in range(n)])
        ranks = repeats.prefix_ranks(codes)
        order = np.argsort(ranks[-1])
        suffixes = [codes[i:].tolist() for i in range(n)]
        assert order.tolist() == sorted(range(n), key=lambda i: suffixes[i])
        agreed = [-1] + [next((k for k, (x, y) in enumerate(zip(suffixes[a], suffixes[b])) if x != y), min(len(suffixes[a]), len(suffixes[b]))) for a, b in zip(order, order[1:])]
        assert repeats.common_prefixes(order, ranks).tolist() == agreed


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    away = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in away)))


def test_run_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, " \n".join(rng.choice(["red", "blue", "Éa"]) for _ in range(rng.randrange(90))) * rng.randrange(1, 5)) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "\t\n"), (None, "a b " * 30), (503, "one  word\x1f " * 40), (3, rows[3][1]), (3, rows[3][1])]
    rows += [(i, "tick tock " * 700 + "stop") for i in range(600, 620)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS runs", "'x' AS strongest", "2 AS __text")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.op12_periodic_runs(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((brute_row(*r) for r in rows), key=str)
    whole = repeats.with_runs(docs)
    assert whole.columns == ["doc_id", "text", "__text", "n_words", "runs", "strongest", "collapsed"] and whole.count() == len(rows)
    assert repeats.with_runs(docs.limit(0)).count() == 0


def test_very_long_text(spark):
    rows = [(1, LONG), (2, "a b c d e f g h i j k l m n " * 9000)]
    got = {r.doc_id: r for r in repeats.with_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 60_000, 1)] and got[1].collapsed == "word"
    assert [tuple(r) for r in got[2].runs] == [(0, 126_000, 14)] and got[2].collapsed == "a b c d e f g h i j k l m n"


# --- Merkle manifests ---


def h(*parts):
    return sha("".join(parts))


def brute_leaf(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def brute_climb(nodes):
    """The root, and of every node the (node, siblings) of each level on its way."""
    ways, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, k in enumerate(at):
            ways[i].append((level[k], [(s < k, level[s]) for s in (k ^ 1,) if s < len(level)]))
            at[i] = k // 2
        level = [h(*level[k : k + 2]) for k in range(0, len(level), 2)]
    return level[0], ways


def brute_manifest(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        ordered = sorted(langs[name], key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(*r)))
        trees[name] = (ordered, *brute_climb([brute_leaf(*r) for r in ordered]))
    root, over = brute_climb([trees[n][1] for n in names])
    out = []
    for name, more in zip(names, over, strict=True):
        ordered, subroot, ways = trees[name]
        for r, way in zip(ordered, ways, strict=True):
            steps = [s for _, s in way + more]
            found = list(r)
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                found[3] += 1
            node = brute_leaf(*found)
            for step in steps:
                node = h(*[s for left, s in step if left], node, *[s for left, s in step if not left])
            out.append((r[0], brute_leaf(*r), subroot, root, h(*[s for step in steps for _, s in step]), node, node == root))
    return sorted(out, key=str)


def manifest_rows():
    rng = random.Random(9)
    rows = [(i, rng.choice(["web", "book", None]), "en" if i % 3 else rng.choice(["de", "fr", None, "", "é", "Z"]), rng.choice([None, i, 12]), rng.choice([None, "", "text é\n", f"text {i}"])) for i in range(400)]
    rows += [(5000, "web", "lone", 3, LONG), (None, "web", "en", 4, "no id"), (None, "web", "en", 4, "no id"), (3, "web", "en", 1, "again"), (3, "web", "en", 1, "again")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("levels", [8, 2, 1])
def test_manifest_equals_brute_force(spark, tmp_path, monkeypatch, levels):
    rows = manifest_rows()
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string").selectExpr("*", "1 AS g", "2 AS hash", "3 AS root", "4 AS at")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(merkle.manifest, "__defaults__", ("lang", "doc_id", levels))
    got = sorted(map(tuple, catalog.op13_merkle_manifest(spark, str(tmp_path)).collect()), key=str)
    assert got == brute_manifest(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7])
def test_manifest_of_few_rows(spark, tmp_path, n):
    rows = [(i, "web", None, 7, "same") for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, catalog.op13_merkle_manifest(spark, str(tmp_path)).collect()), key=str)
    assert got == (brute_manifest(rows) if n else [])


def test_versions_share_all_but_the_ancestors():
    for n in (1, 2, 5, 8, 13):
        tree = merkle.Tree.of([f"leaf {i}" for i in range(n)])
        for i in range(n):
            version = tree.changed(i, "other")
            whole = merkle.Tree.of([*tree.levels[0][:i], "other", *tree.levels[0][i + 1 :]])
            assert [[version.node(k, j) for j in range(len(nodes))] for k, nodes in enumerate(tree.levels)] == whole.levels
            assert version.root == merkle.continued("other", tree.steps(i)) and len(version.copies) == len(tree.levels)
            assert tree.root == merkle.continued(tree.levels[0][i], tree.steps(i))


@pytest.mark.skipif(not DATA.exists(), reason="tables are not there")
@pytest.mark.parametrize("name", ["op11_exact_duplicates", "op13_merkle_manifest"])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    df = entry_points.queries()[name](spark, str(DATA))
    cursor = db.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(names).collect()), key=str) == sorted(cursor.fetchall(), key=str)


@pytest.mark.skipif(not DATA.exists(), reason="tables are not there")
def test_runs_of_the_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows = {d: t for d, t in rows if len((t or "").split()) < 1500}
    got = {r.doc_id: tuple(r) for r in entry_points.queries()["op12_periodic_runs"](spark, str(DATA)).collect()}
    assert len(rows) > 100 and all(got[d] == brute_row(d, t) for d, t in rows.items())


def test_rows_without_change_are_verified_too(spark):
    """Every root is worked out from the row: one that a block's leaves do not fold to verifies none of them."""
    leaves, upper = [h("a"), h("b"), h("c")], ["L" + h("left"), merkle.ALONE, "R" + h("right")]
    tree = merkle.Tree.of(leaves, 2)
    right = merkle.continued(tree.root, upper)
    version = tree.changed(1, h("new")).raised(upper)
    assert len(version.copies) == len(tree.levels) + len(upper) and version.node(1, 0) == h(h("a"), h("new"))
    assert version.root == merkle.continued(h("new"), tree.steps(1) + upper) != right
    nodes = [(i, i, leaf, h("new") if i == 1 else None) for i, leaf in enumerate(leaves)]
    kind = "nodes array<struct<at:bigint,id:bigint,hash:string,found:string>>, blocks bigint, subroot string, root string, steps array<string>"
    for root, verified in ((right, [True, False, True]), (h("wrong"), [False, False, False])):
        blocks = spark.createDataFrame([(nodes, 2, h("sub"), root, upper)], kind)
        got = sorted(merkle._verified(blocks, "doc_id", T.LongType(), 2).collect())
        assert [r.folded_root for r in got] == [right, version.root, right] and [r.verified for r in got] == verified

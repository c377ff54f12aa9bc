"""Decontamination, SimHash, license scan and URL verdicts against brute force on small tables."""

import itertools
import math
import random
import re
import string
from collections import Counter

import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from corpometer.llm import common, components, decontaminate, licenses, simhash, urls
from corpometer.session import stored

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
LONG = "word " * 60_000


def test_heaviest_keeps_whole_weights(spark):
    rows = spark.createDataFrame([("a", 9), ("b", 7), ("c", 7), ("d", 1), ("e", 1), ("f", 1)], "token string, n long")
    for most, want in ((0, ""), (1, "a"), (2, "a"), (3, "abc"), (5, "abc"), (6, "abcdef")):
        assert "".join(sorted(common.heaviest(rows, "n", most).column("token").to_pylist())) == want
    assert common.heaviest(rows.limit(0), "n", 3).num_rows == 0


def test_pieces_hold_every_row():
    texts = pa.array(["a" * 10, None, "", "b" * 100, "c", "d" * 3] * 5)
    for chars in (1, 12, 60, 10_000):
        ranges = list(common.pieces(texts, chars))
        assert [i for a, b in ranges for i in range(a, b)] == list(range(len(texts)))
        assert all(b - a == 1 or sum(len(t or "") for t in texts.slice(a, b - a).to_pylist()) <= chars for a, b in ranges)


# --- decontamination ---


def words5(text):
    ws = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}


def brute_leaks(docs, items, share=0.8):
    by_id = {}
    for i, t in items:
        if i is not None:
            by_id.setdefault(i, set()).update(words5(t))
    texts = {}
    for d, t in docs:
        texts.setdefault(d, set()).update(words5(t))
    return {
        (d, i, len(own), len(own & s))
        for i, own in by_id.items()
        for d, s in texts.items()
        if own and len(own & s) >= share * len(own) - 1e-9
    }


def leak_tables():
    rng = random.Random(3)
    names = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(names, k=rng.choice([3, 5, 6, 12, 40, 90])))) for i in range(25)]
    items += [(30, None), (31, ""), (None, items[4][1]), (5, items[6][1])]
    docs = []
    for d in range(60):
        body = rng.choices(names, k=rng.choice([0, 4, 20, 300]))
        own = items[rng.randrange(25)][1].upper().split()
        cut = own[rng.choice([0, 1, len(own) // 4]) :]
        docs.append((d, ", ".join(body[:10] + cut + body[10:])))
    docs += [(None, items[3][1]), (60, None), (61, ""), (2, items[9][1]), (2, items[9][1]), (62, LONG + items[7][1] + LONG)]
    return docs, items


@pytest.mark.parametrize("index_rows", [200_000, 1])
def test_contaminated_equals_brute_force(spark, index_rows):
    docs, items = leak_tables()
    got = decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
        index_rows=index_rows,
    ).collect()
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    assert {(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in got} == brute_leaks(docs, items)
    assert all(abs(r.containment - r.n_found / r.n_shingles) < 1e-12 for r in got)


def test_contaminated_with_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x", 2)], "doc_id long, text string, hash string, item_id int")
    items = spark.createDataFrame([(7, "a b c d e f", "y")], "item_id long, text string, places string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()] == [(1, 7)]
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0
    assert decontaminate.without_contaminated(docs, items).count() == 0
    kept = decontaminate.without_contaminated(docs, items.limit(0))
    assert kept.columns == docs.columns and kept.count() == 1


# --- SimHash ---


def brute_fingerprint(text):
    ws = [w.translate(LOWER) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    runs = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)] if ws else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_pairs(values):
    return {(a, b) for a, b in itertools.combinations(sorted(values), 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= 3}


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_fingerprint_equals_brute_force():
    for text in (None, "", "  \n", "one", "One two", "a b c", "É\xa0x y z é É", "a  b\tc\n" * 50, "the cat sat on the mat " * 400):
        assert simhash.fingerprint_of(text) % 2**64 == brute_fingerprint(text)


@pytest.mark.parametrize("crowded", [64, 3, 0])
def test_near_pairs_equal_brute_force(spark, crowded):
    rng = random.Random(crowded)
    values = {rng.getrandbits(64) for _ in range(50)}
    for centre in (0, 2**64 - 1, rng.getrandbits(64)):
        values |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(60)}
        values |= {centre ^ sum(1 << b for b in rng.sample(range(12), rng.randrange(5))) for _ in range(40)}
    values = {signed(v) for v in values}
    got = simhash.near_pairs(spark.createDataFrame([(v,) for v in values], "fp long"), crowded=crowded).collect()
    assert len(got) == len(set(got)) and {(r.a, r.b) for r in got} == brute_pairs(values)


def test_signatures_are_not_broadcast(spark):
    centre = 1 << 40
    values = [(centre ^ (1 << b),) for b in range(20)] + [(n << 32 | 5,) for n in range(40)]
    plan = simhash.near_pairs(stored(spark.createDataFrame(values, "fp long")), crowded=4)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and ", Inner" in line]
    assert len(joins) == 3 and all("SortMergeJoin" in j for j in joins)


def test_connected(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (None, 3)]
    links += [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(35)]
    rng.shuffle(links)
    root = {x: x for pair in links for x in pair if x is not None}
    for _ in range(400):
        for a, b in links:
            if a is not None and a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = {r.id: r.root for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if any(x in p and p[0] != p[1] for p in links if None not in p)}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def near_texts():
    rng = random.Random(9)
    base = [[rng.choice("abcdefghijklmnop") * rng.randrange(1, 4) for _ in range(400)] for _ in range(6)]
    rows = []
    for i in range(80):
        ws = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            ws[rng.randrange(len(ws))] = "zz"
        rows.append((1000 - i, " ".join(ws)))
    return [*rows, (5, None), (6, ""), (None, rows[0][1]), (None, "nothing like it at all"), rows[1], rows[1]]


def test_components_equal_brute_force(spark):
    rows = near_texts()
    prints = [signed(brute_fingerprint(t)) for _, t in rows]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if bin((prints[i] ^ prints[j]) & (2**64 - 1)).count("1") <= 3:
            group = [group[i] if g == group[j] else g for g in group]
    low = {}
    for g, (d, _) in zip(group, rows, strict=True):
        low.setdefault(g, []).append(d)
    want = sorted((str(d), p, str(min((x for x in low[g] if x is not None), default=None))) for (d, _), p, g in zip(rows, prints, group, strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.components(df).collect())
    assert got == want
    kept = simhash.one_of_each(df.selectExpr("doc_id", "text", "doc_id AS fingerprint", "1 AS k_fp", "2 AS k_id", "3 AS _fingerprint"))
    assert kept.columns == ["doc_id", "text", "fingerprint", "k_fp", "k_id", "_fingerprint"]
    ids = sorted(str(min((x for x in ids if x is not None), default=None)) for ids in low.values())
    assert sorted(str(r.doc_id) for r in kept.collect()) == ids
    assert simhash.components(df.limit(0)).count() == 0 and simhash.one_of_each(df.limit(0)).count() == 0


def test_one_of_each_of_null_ids_and_long_texts(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (None, LONG), (3, LONG), (2, LONG + " end"), (2, "entirely other words here"), (9, None), (8, " ")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), (r.text or "")[:8]) for r in kept) == [("2", "entirely"), ("2", "word wor"), ("8", " "), ("None", "a b c d")]


# --- licenses ---


def brute_base(text):
    ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    found = []
    for phrase, label, _ in licenses.PHRASES:
        q = phrase.split()
        found += [(label, i, i + len(q) - 1) for i in range(len(ws) - len(q) + 1) if ws[i : i + len(q)] == q]
    return len(ws), sorted(found)


def brute_detections(text, rules):
    ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    line, found = " " + " ".join(ws) + " ", []
    for i, r in enumerate(rules):
        if all(k in ws for k in r.keywords):
            for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", line):
                first = line[: m.start()].count(" ") - 1
                found.append((first, first + m[0].count(" "), r.level, i, r.label))
    def better(a, b):
        return a[0] <= b[0] and b[1] <= a[1] and a[2] <= b[2] and (a[0], -a[1], a[2], a[3]) < (b[0], -b[1], b[2], b[3])
    return sorted(d for d in found if not any(better(o, d) for o in found))


LICENSE_TEXTS = [
    None, "", "plain words only", "CC-BY", "cc by cc by, CC BY 4.0!", "All rights reserved. all RIGHTS  reserved",
    "GNU General Public License version 3 or any later version", "under the GNU General Public License, v2.1 or 3",
    "Licensed under the Apache License, Version 2.0.", "Creative Commons Attribution-ShareAlike 4.0", "SPDX-License-Identifier: GPL-3.0-only",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of MIT license", "İ ccİ by cc by é",
    "Copyright (c) 2020 Foo. All rights reserved. See the license. BSD 3-Clause License, Mozilla Public License 2.0",
    "cc by " * 3_000, "x " * 30_000 + "general public license",
]


def test_license_scan_equals_brute_force(spark):
    rules = licenses.signatures()
    assert len(rules) > 300 and len(set(rules)) == len(rules) and {r.level for r in rules} == {1, 2, 3, 4}
    rows = [(i, t, "extra", 1) for i, t in enumerate(LICENSE_TEXTS)] + [(None, LICENSE_TEXTS[4], None, None), (3, "CC-BY", "extra", 1)]
    got = licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string, rule string, `level` int")).collect()
    assert len(got) == len(rows)
    texts = {(r[0], r[2]): r[1] for r in rows}
    for r in got:
        text = texts[r.doc_id, r["rule"]]
        n, base = brute_base(text)
        assert (r.n_words, sorted((b.label, b.first, b.last) for b in r.base)) == (n, base)
        assert sorted((d.first, d.last, d.level, d.rule, d.label) for d in r.detections) == brute_detections(text, rules)
        phrases = [licenses.PHRASE_CONFIDENCE] * len(base)
        assert r.score == max([*phrases, *(licenses.CONFIDENCE[d.level] for d in r.detections)], default=0.0)
    assert licenses.scanned(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- URLs ---


def test_host_and_path(spark):
    given = {
        "http://WWW.Example.com/A/b?x#y": ("www.example.com", "/A/b"), "https://a.b": ("a.b", ""), "x://h?q/z": ("h", ""),
        "x://h#q/z": ("h", ""), "no-scheme.com/a": ("", ""), "": ("", ""), "a://b://c/d": ("b:", "//c/d"), "://h/\np": ("h", "/\np"), "s://É.fr/": ("É.fr", "/"),
    }
    rows = spark.createDataFrame([(u,) for u in given] + [(None,)], "url string")
    host, path = urls.host_and_path(rows.url)
    got = {r.url: (r.host, r.path) for r in rows.select("url", host.alias("host"), path.alias("path")).collect()}
    assert got == {**given, None: ("", "")}


def test_rules_take_the_longest():
    table = urls.Rules([urls.Rule("block", "net"), urls.Rule("allow", "example.net", "/en/"), urls.Rule("block", "example.net", "/en/x")])
    assert table.best("a.example.net", "/en/y").verdict == "allow" and table.best("example.net", "/en/xy").verdict == "block"
    assert table.best("a.example.net", "/de/").text == "net/" and table.best("notnet", "/") is None
    assert table.best("net", "") is None and table.best("", "") is None


def test_segmentation_finds_the_best_split():
    counts = {"news": 50, "paper": 40, "newspaper": 2, "a": 90, "the": 100, "rapist": 1, "therapist": 30}
    segmenter = urls.Segmenter(counts)
    def cost(ws):
        return sum(segmenter.cost.get(w, segmenter.total + 2.302585092994046 * len(w)) for w in ws)
    rare = {w: c for w, c in counts.items() if c < 35}
    few = urls.Segmenter({w: c for w, c in counts.items() if c >= 35}, sum(counts.values()))
    for name in ("newspaper", "therapist", "anews", "xqz", "a", "thepaperx"):
        cuts = [[name[a:b] for a, b in zip((0, *c), (*c, len(name)), strict=True)] for k in range(len(name)) for c in itertools.combinations(range(1, len(name)), k)]
        assert abs(cost(segmenter.split(name)) - min(map(cost, cuts))) < 1e-9
        assert few.split(name, rare) == segmenter.split(name)
    assert segmenter.split("") == [] and "".join(segmenter.split("the" * 5_000)) == "the" * 5_000


def plain_verdicts(rows, rules):
    """Word counts, segmentation and naive Bayes over whole tables, in plain Python."""
    words = Counter()
    for _, _, html in rows:
        text = re.sub(r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ", html or "").lower()
        words.update(w for w in re.split(r"[^a-zé]+", text) if w)
    segmenter, table = urls.Segmenter(words), urls.Rules(rules)
    pages = []
    for i, url, _ in rows:
        found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (found[1].translate(LOWER), found[2]) if found else ("", "")
        tokens = [m if r is None else m + w for m, r in urls.marks_of(host, path) for w in ([""] if r is None else segmenter.split(r))]
        pages.append((i, table.best(host, path), tokens))
    sides = [Counter(t for _, r, ts in pages if r and r.verdict == v for t in ts) for v in ("block", "allow")]
    n = [sum(1 for _, r, _ in pages if r and r.verdict == v) for v in ("block", "allow")]
    distinct = len(sides[0] | sides[1])
    out = []
    for i, rule, tokens in pages:
        odds = 0.0
        if all(n):
            odds = math.log(n[0] / n[1])
            for t in tokens:
                b, a = ((s[t] + 1) / (sum(s.values()) + distinct + 1) for s in sides)
                odds += math.log(b) - math.log(a)
        out.append((i, rule and rule.text, rule.verdict if rule else "block" if odds > 1e-9 else "allow", tokens, round(odds, 6)))
    return sorted(out, key=str)


def url_rows():
    rng = random.Random(21)
    words = ["news", "school", "casino", "money", "win", "class", "river", "stone", "a", "café", "extraordinarylongwordofmorethantwentyfourletters"]
    rows = []
    for i in range(150):
        name = "".join(rng.choices(words, k=rng.randrange(1, 4)))
        host = rng.choice(["bad.com", "good.com", "en.org", "xqz"])
        html = f"<STYLE>hidden casino</STYLE><p>{' '.join(rng.choices(words, range(11, 0, -1), k=6))} once{'abcdefghij'[i % 10]}</p><!-- gone -->"
        rows.append((i, f"http://{name}{rng.choice(['', '7'])}.{host}/{rng.choice(words)}/{rng.choice(['x', '12', 'once' + 'abcdefghij'[i % 10]])}?q", html))
    rows += [(900, "http://" + "newsschool" * 400 + ".org/" + "q" * 3000, None), (901, None, "<p>" + "river " * 9000 + "z" * 5000), (None, "none", ""), (901, None, None), (5, rows[5][1], rows[5][2])]
    return rows


@pytest.mark.parametrize(("hot", "parts"), [(50_000, 2), (4, 16), (0, 3)])
def test_url_verdicts_equal_plain_python(spark, hot, parts):
    rules = [urls.Rule("block", "bad.com"), urls.Rule("allow", "good.com"), urls.Rule("allow", "en.org", "/river")]
    rows = url_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts).selectExpr("*", "1 AS host", "2 AS words", "3 AS n", "4 AS row")
    got = urls.judged(pages, urls.fit(pages, rules, hot_words=hot, hot_tokens=hot)).collect()
    assert sorted(((r.page_id, r.rule, r.verdict, r.words, round(r.odds, 6)) for r in got), key=str) == plain_verdicts(rows, rules)


def test_url_verdicts(spark):
    rules = [urls.Rule("block", "bad.com"), urls.Rule("allow", "good.com")]
    rows = [(i, f"http://casino{i}.bad.com/win/money", "<p>casino money win news school</p>") for i in range(30)]
    rows += [(100 + i, f"http://school{i}.good.com/news/class", "<script>x</script>school news class") for i in range(30)]
    rows += [(200, "http://casinomoney.org/win", None), (201, "http://schoolnews.org/class", ""), (None, None, None), (202, "nothing", "x"), (202, "nothing", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = urls.judged(pages, urls.fit(pages, rules)).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    assert by_id[3].rule == "bad.com/" and by_id[3].verdict == "block" and by_id[103].verdict == "allow"
    assert by_id[200].rule is None and by_id[200].verdict == "block" and by_id[201].verdict == "allow"
    assert "h:casino" in by_id[200].words and "h:money" in by_id[200].words
    assert by_id[None].host == "" and by_id[None].rule is None and by_id[202].path == ""
    empty = pages.limit(0)
    assert urls.judged(empty, urls.fit(empty, rules)).count() == 0
    assert {r.verdict for r in urls.judged(pages.where("page_id = 200"), urls.fit(empty, rules)).collect()} == {"allow"}

"""URL verdicts: host and path rules first, then word segmentation and naive Bayes."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpometer.llm.common import heaviest, let_go
from corpometer.operators.joins import lookup
from corpometer.session import stored

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
HOT_WORDS = 50_000  # words and tokens that travel with the tasks; the rows of all others are joined
HOT_TOKENS = 100_000
EVEN = 1e-9  # log-odds nearer to zero than sums in another order may be apart
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains, and paths that start with ``path``."""

    verdict: str  # allow or block
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


class Rules:
    """Rules by host, the longest text first; of equal texts, the one given first."""

    def __init__(self, rules: Sequence[Rule]):
        self.by_host: dict[str, list[Rule]] = {}
        for r in sorted(rules, key=lambda r: -len(r.text)):
            self.by_host.setdefault(r.host, []).append(r)

    def best(self, host: str, path: str) -> Rule | None:
        found, own = None, host
        while True:
            for r in self.by_host.get(own, ()):
                if path.startswith(r.path):
                    found = r if found is None or len(r.text) > len(found.text) else found
                    break
            _, dot, own = own.partition(".")
            if not dot:
                return found


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty for null or without ``://``."""
    whole = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(whole, PARTS, 1), UPPER, UPPER.lower()), F.regexp_extract(whole, PARTS, 2)


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Stored (word, count) of all words in all pages' visible texts."""
    text = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    words = pages.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("word"))
    return stored(words.where(F.length("word") > 0).groupBy("word").count(), "word-counts")


class Segmenter:
    """Splits a name into the words that a unigram model finds most likely (Viterbi).

    A stretch that is no word costs as much as the rarest word there could be, and ten times that for each letter,
    so known words win where they fit. ``total`` is the number of all words, those of ``counts`` by default.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None):
        self.total = math.log(max(sum(counts.values()) if total is None else total, 1) + 1)
        self.cost = {w: self.total - math.log(c) for w, c in counts.items() if c > 0}
        self.lengths = sorted(set(map(len, self.cost)), reverse=True)

    def split(self, name: str, more: dict[str, int] | None = None) -> list[str]:
        """The words of ``name``; ``more`` has counts of words in it that are not among the others."""
        extra = {w: self.total - math.log(c) for w, c in (more or {}).items() if c > 0}
        lengths = sorted({*self.lengths, *map(len, extra)}, reverse=True) if extra else self.lengths
        n, letter = len(name), math.log(10)
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        strange, since = [math.inf] * (n + 1), [0] * (n + 1)  # cheapest end of a stretch that is no word, and its begin
        for end in range(1, n + 1):
            begun, longer = best[end - 1] + self.total + letter, strange[end - 1] + letter
            strange[end], since[end] = (longer, since[end - 1]) if longer <= begun else (begun, end - 1)
            best[end], back[end] = strange[end], since[end]
            for size in lengths:
                if size <= end:
                    piece = name[end - size : end]
                    price = self.cost.get(piece)
                    price = extra.get(piece) if price is None else price
                    if price is not None and best[end - size] + price < best[end]:
                        best[end], back[end] = best[end - size] + price, end - size
        words, end = [], n
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        return words[::-1]


def marks_of(host: str, path: str) -> list[tuple[str, str | None]]:
    """(mark, run) in order: ``h:`` and ``p:`` with the letter runs of host names and path, whole tokens without one.

    The host's last name is the token ``t:`` and the name; each run of digits is ``h:0`` or ``p:0``.
    """
    names = host.split(".")
    out: list[tuple[str, str | None]] = [("t:" + names[-1], None)] if len(names) > 1 else []
    for mark, texts in (("h:", names[:-1] if len(names) > 1 else names), ("p:", [path.lower()])):
        for text in texts:
            out += [(mark + "0", None) if run.isdigit() else (mark, run) for run in re.findall(r"[^\W\d_]+|\d+", text)]
    return out


@dataclass
class UrlModel:
    """Rules, words for segmentation, and naive Bayes counts of blocked and allowed pages.

    ``words`` (word, count) and ``counts`` (token, n0, n1, n) are stored tables of all words and tokens; ``hot_words``
    and ``hot_counts`` are the heaviest of them, which tasks hold, and all with at least the weight beside them.
    """

    rules: Sequence[Rule]
    words: DataFrame
    total_words: int
    hot_words: dict[str, int]
    least_word: int
    counts: DataFrame | None = None
    hot_counts: dict[str, tuple[int, int]] | None = None
    least_token: int = 0
    pages: tuple[int, int] = (0, 0)
    tokens: tuple[int, int] = (0, 0)
    distinct: int = 0


def _one_row(df: DataFrame) -> dict:
    return df.toArrow().to_pylist()[0]


def segments(runs: DataFrame, model: UrlModel) -> DataFrame:
    """Stored (run, n, words) for the distinct letter runs (run, n): how each is split.

    Tasks hold the heaviest words. Of the others a run needs those that lie in it: its substrings, of the lengths
    that such words have, are joined to the words, so every word of every page takes part.
    """
    runs = stored(runs, "runs")
    rare = model.words.where(F.col("count") < model.least_word)
    found = runs.select("run", "n", F.lit(None).cast("array<struct<word:string,count:bigint>>").alias("more"))
    lengths = [r["size"] for r in rare.select(F.length("word").alias("size")).distinct().toArrow().to_pylist()]
    if lengths:
        spans = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]), lambda n: n <= F.length("run"))
        starts = F.flatten(F.transform(spans, lambda n: F.transform(F.sequence(F.lit(1), F.length("run") - n + 1), lambda i: F.col("run").substr(i, n))))
        pieces = runs.select("run", F.explode(F.array_distinct(starts)).alias("word"))
        more = pieces.join(rare, "word").groupBy("run").agg(F.collect_list(F.struct("word", "count")).alias("more"))
        found = runs.join(more, "run", "left").select("run", "n", "more")
    hot, total = model.hot_words, model.total_words

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        segmenter = Segmenter(hot, total)
        for batch in batches:
            words = []
            for run, more in zip(batch.column("run").to_pylist(), batch.column("more").to_pylist(), strict=True):
                words.append(segmenter.split(run, {m["word"]: m["count"] for m in more or ()}))
            yield pa.RecordBatch.from_arrays([batch.column("run"), batch.column("n"), pa.array(words, pa.list_(pa.string()))], names=["run", "n", "words"])

    return stored(found.mapInArrow(split, "run string, n long, words array<string>"), "segments")


def tokened(pages: DataFrame, model: UrlModel, url: str = "url", page_id: str = "page_id", decided: bool = False) -> DataFrame:
    """Stored (row, page_id, host, path, rule, verdict, words): the tokens of each page, and the rule that fits it.

    With ``decided`` only pages that a rule decides. Runs are split once however many pages have them.
    """
    host, path = host_and_path(F.col(url))
    rules = model.rules

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Rules(rules)
        for batch in batches:
            texts, verdicts, marks = [], [], []
            for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                rule = table.best(h, p)
                texts.append(rule and rule.text)
                verdicts.append(rule and rule.verdict)
                marks.append([{"mark": m, "run": r} for m, r in marks_of(h, p)] if rule or not decided else [])
            kind = pa.list_(pa.struct([("mark", pa.string()), ("run", pa.string())]))
            new = [pa.array(texts, pa.string()), pa.array(verdicts, pa.string()), pa.array(marks, kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=["page_id", "host", "path", "rule", "verdict", "marks"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    schema = "page_id long, host string, path string, rule string, verdict string, marks array<struct<mark:string,run:string>>"
    found = rows.mapInArrow(cut, schema)
    found = stored((found.where("rule IS NOT NULL") if decided else found).withColumn("row", F.monotonically_increasing_id()), "url-marks")
    runs = found.select("row", F.posexplode("marks").alias("at", "m")).select("row", "at", "m.mark", "m.run").where("run IS NOT NULL")
    split = segments(runs.groupBy("run").agg(F.count(F.lit(1)).alias("n")), model)
    pieces = lookup(runs, split, ["run"], weight="n", how="inner")
    spelled = F.transform("words", lambda w: F.concat("mark", w))
    joined = pieces.groupBy("row").agg(F.collect_list(F.struct("at", spelled.alias("words"))).alias("found"))
    whole = F.filter(F.transform("marks", lambda m, i: F.when(m["run"].isNull(), F.struct(i.alias("at"), F.array(m["mark"]).alias("words")))), lambda x: x.isNotNull())
    parts = F.sort_array(F.concat(whole, F.coalesce("found", F.array().cast("array<struct<at:int,words:array<string>>>"))))
    tokens = F.flatten(F.transform(parts, lambda p: p["words"])).alias("words")
    return stored(found.join(joined, "row", "left").select("row", "page_id", "host", "path", "rule", "verdict", tokens), "url-tokens")


def fit(
    pages: DataFrame, rules: Sequence[Rule], url: str = "url", html: str = "html", hot_words: int = HOT_WORDS, hot_tokens: int = HOT_TOKENS
) -> UrlModel:
    """Count words of all pages, and tokens of all pages that a rule decides; those verdicts are the labels.

    All words and tokens are kept, in stored tables; the heaviest ``hot_words`` and ``hot_tokens`` travel with the
    tasks besides, which changes no result. Ids play no part.
    """
    words = word_counts(pages, html)
    top = heaviest(words, "count", hot_words).to_pylist()
    total = _one_row(words.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")))["n"]
    model = UrlModel(rules, words, total, {r["word"]: r["count"] for r in top}, min((r["count"] for r in top), default=2**62))
    known = tokened(pages.withColumn("page_id", F.lit(0)) if "page_id" not in pages.columns else pages, model, url, decided=True)
    blocked = (F.col("verdict") == "block").cast("int")
    counts = known.select(blocked.alias("b"), F.explode("words").alias("token")).groupBy("token").agg(
        F.sum("b").alias("n0"), F.sum(1 - F.col("b")).alias("n1"), F.count(F.lit(1)).alias("n")
    )
    model.counts = stored(counts, "token-counts")
    sums = _one_row(model.counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n0", "n1")], F.count(F.lit(1)).alias("distinct")))
    model.tokens, model.distinct = (sums["n0"], sums["n1"]), sums["distinct"]
    seen = _one_row(known.agg(F.coalesce(F.sum(blocked), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")))
    model.pages = (seen["b"], seen["n"] - seen["b"])
    top = heaviest(model.counts, "n", hot_tokens).to_pylist()
    model.hot_counts = {r["token"]: (r["n0"], r["n1"]) for r in top}
    model.least_token = min((r["n"] for r in top), default=2**62)
    return model


def judged(pages: DataFrame, model: UrlModel, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, words, odds) of every page.

    ``rule`` is the longest one that fits, else null; ``verdict`` is the rule's, else block where the
    log-odds ``odds`` of the segmented ``words`` are above zero, else allow. Odds are those of naive Bayes with
    one added to every count, zero if a class was never seen. A null url, or one without ``://``, has an empty host
    and path and is judged by the share of blocked pages alone. Rows are judged one by one: null and repeated ids
    keep their rows; other columns are not read, and an empty table gives an empty result.
    """
    rows = tokened(pages, model, url, page_id)
    both = all(model.pages)
    blocked, allowed = (math.log(n + model.distinct + 1) for n in model.tokens)
    prior = math.log(model.pages[0] / model.pages[1]) if both else 0.0
    hot = {t: math.log(b + 1) - math.log(a + 1) for t, (b, a) in model.hot_counts.items()} if both else {}
    each = allowed - blocked if both else 0.0

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            odds, rare = [], []
            for words in batch.column("words").to_pylist():
                odds.append(prior + len(words) * each + math.fsum(hot.get(w, 0.0) for w in words))
                rare.append([w for w in words if w not in hot] if both else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(odds, pa.float64()), pa.array(rare, pa.list_(pa.string()))], names=[*batch.schema.names, "odds", "rare"])

    names = "row long, page_id long, host string, path string, rule string, verdict string, words array<string>"
    weighed = rows.mapInArrow(weigh, f"{names}, odds double, rare array<string>")
    table = model.counts.where(F.col("n") < model.least_token)
    if both and not table.isEmpty():
        weighed = stored(weighed, "weighed")
        more = weighed.select("row", F.explode("rare").alias("token")).join(table, "token")
        sums = more.groupBy("row").agg(F.sum(F.log(F.col("n0") + 1.0) - F.log(F.col("n1") + 1.0)).alias("more"))
        weighed = weighed.join(sums, "row", "left").withColumn("odds", F.col("odds") + F.coalesce("more", F.lit(0.0)))
    own = F.when(F.col("odds") > EVEN, "block").otherwise("allow")
    return weighed.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "words", "odds")

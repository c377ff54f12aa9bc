"""Sentence ends and word tokens by abbreviations that are learnt from the corpus itself, without labels.

A full stop behind an abbreviation, an initial or a number need not end a sentence. Which words are abbreviations shows
in how they are used: they nearly always come with the stop, are short, and often hold stops inside. Dunning's log
likelihood ratio weighs how much better "the stop belongs to this word" explains its counts than chance does. The same
ratio finds the words that start sentences and the pairs whose stop joins two words. All of it is counting: every
statistic is a table with a row for each word or pair, and no list is held by the driver unless its size is checked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpometer.functions.text import SPACE, word_pieces
from corpometer.operators.joins import attach_row, bounded, lookup
from corpometer.session import stored

ABBREVIATION = 0.3  # score from which a word is an abbreviation
STARTER = 30.0  # log likelihood ratio from which a word starts sentences
COLLOCATION = 7.88  # and from which a stop joins two words
LIST_ROWS = 20_000

# What may stand around a word; the stop is not among it.
_OPEN = r"^[\"'“”‘’«»„(\[{<*_-]+"
_CLOSE = r"[\"'“”‘’«»)\]}>*_]+$"
_MARKS = r"[,;:]+$"
NUMBER = r"^-?[.,]?[0-9][0-9.,]*$"
NUMBER_TYPE = "##number##"


@dataclass
class Learnt:
    """What was learnt, each a table with the words and the numbers behind them.

    ``abbreviations`` (type, with_stop, without_stop, score), ``starters`` (type, n, ratio), ``collocations``
    (first, second, n, ratio), ``cases`` (type, upper_inside, lower_seen, upper_at_start).
    """

    abbreviations: DataFrame
    starters: DataFrame
    collocations: DataFrame
    cases: DataFrame


def raw_pieces(text: Column) -> Column:
    """Array of what stands between white space."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def _bare(raw: Column) -> Column:
    """A piece without the marks around it."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, _OPEN, ""), _CLOSE, ""), _MARKS, "")


def _core(bare: Column) -> Column:
    return F.regexp_replace(bare, r"([!?]+|\.{2,})$", "")


def _ends(raw: Column, bare: Column) -> Column:
    return bare.rlike(r"([!?]|\.\.)$") & ~raw.rlike(_MARKS)


def _stop(raw: Column, core: Column, ends: Column) -> Column:
    return core.rlike(r"[^.]\.$") & ~ends & ~raw.rlike(_MARKS)


def with_forms(rows: DataFrame, raw: str, name: str) -> DataFrame:
    """``rows`` of one piece each and, behind ``name``, its core, type, stop, ends, upper and lower; null for no piece.

    ``core`` is the word without the marks around it, ``type`` its lower-case form without the last stop, with one
    type for all numbers. ``stop`` tells whether it ends in one full stop, ``ends`` whether in ``!``, ``?`` or two
    stops and more, ``upper`` and ``lower`` the case of its first letter.
    """
    own = lambda n: f"{name}_{n}"
    rows = rows.withColumn(own("bare"), _bare(F.col(raw)))
    rows = rows.withColumns({own("core"): _core(F.col(own("bare"))), own("ends"): _ends(F.col(raw), F.col(own("bare")))}).drop(own("bare"))
    core = F.col(own("core"))
    return rows.withColumns({
        own("type"): _type(core), own("stop"): _stop(F.col(raw), core, F.col(own("ends"))),
        own("upper"): core.rlike(r"^\p{Lu}"), own("lower"): core.rlike(r"^\p{Ll}"),
    })


def _type(core: Column) -> Column:
    bare = F.lower(F.regexp_replace(core, r"\.$", ""))
    return F.when(bare.rlike(NUMBER), F.lit(NUMBER_TYPE)).otherwise(bare)


def _neighbours(raw: Column) -> Column:
    """Array of ``(p, q)``: every piece and the one behind it, null behind the last."""
    behind = F.slice(raw, F.lit(2), F.greatest(F.size(raw), F.lit(1)))
    return F.zip_with(raw, behind, lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def neighbour_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``(p, q, n)``: how often a piece stands before another, null behind the last of a text.

    Pieces are counted where the texts are read, so that each distinct pair is looked at once.
    """
    cut = df.select(raw_pieces(F.col(text_col)).alias("__r"))
    return cut.select(F.inline(_neighbours(F.col("__r")))).groupBy("p", "q").agg(F.count(F.lit(1)).alias("n"))


def dunning(count_a: Column, count_b: Column, count_ab: Column, n: Column) -> Column:
    """-2 log of the likelihood ratio that b is as likely behind a as elsewhere, for counts over ``n`` places."""
    p, p1 = count_b / n, count_ab / count_a
    p2 = (count_b - count_ab) / (n - count_a)

    def log_l(hits: Column, places: Column, share: Column) -> Column:
        # Zero hits of share zero, and all hits of share one, are certain.
        yes = F.when(hits > 0, hits * F.log(share)).otherwise(0.0)
        no = F.when(places > hits, (places - hits) * F.log(1 - share)).otherwise(0.0)
        return yes + no

    same = log_l(count_ab, count_a, p) + log_l(count_b - count_ab, n - count_a, p)
    apart = log_l(count_ab, count_a, p1) + log_l(count_b - count_ab, n - count_a, p2)
    return -2 * (same - apart)


def stop_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Stored ``(type, with_stop, without_stop)`` of the corpus, added up where the texts are read."""
    return _stop_counts(df.select(F.explode(raw_pieces(F.col(text_col))).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")))


def _stop_counts(words: DataFrame) -> DataFrame:
    """:func:`stop_counts` of ``(p, n)``, where a piece may come in several rows."""
    rows = with_forms(words, "p", "p").where("p_type <> ''")
    stops = F.when(F.col("p_stop"), F.col("n")).otherwise(0)
    counted = rows.groupBy(F.col("p_type").alias("type")).agg(F.sum(stops).alias("with_stop"), F.sum(F.col("n") - stops).alias("without_stop"))
    return stored(counted, "stop-counts")


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """``counts`` of words that come with a stop, and their ``score``.

    The score is the log likelihood ratio of "99 stops in 100" against the share of all words, times e to the
    power of minus the letters, times one more than the stops inside, over the letters to the power of the times
    the word came without a stop.
    """
    whole = counts.agg(F.sum("with_stop").alias("__stops"), F.sum(F.col("with_stop") + F.col("without_stop")).alias("__n"))
    rows = attach_row(counts.where("with_stop > 0").where(~F.col("type").rlike(NUMBER) & F.col("type").rlike(r"\p{L}") & (F.col("type") != NUMBER_TYPE)), whole)
    share = F.col("__stops") / F.col("__n")
    chance = F.col("with_stop") * F.log(share) + F.when(F.col("without_stop") > 0, F.col("without_stop") * F.log(1 - share)).otherwise(0.0)
    always = F.col("with_stop") * F.log(F.lit(0.99)) + F.col("without_stop") * F.log(F.lit(0.01))
    inside = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    letters = F.length("type") - inside
    score = -2 * (chance - always) * F.exp(-letters) * (inside + 1) * F.pow(letters.cast("double"), -F.col("without_stop"))
    return rows.withColumn("score", score).drop("__stops", "__n")


def is_initial(core: Column) -> Column:
    """One letter and a stop."""
    return core.rlike(r"^\p{L}\.$")


def learn(df: DataFrame, text_col: str = "text") -> Learnt:
    """What the texts of ``df`` show about their own abbreviations, sentence starts and joined words.

    The texts are read once, for the pairs of neighbours; what is told of a piece is worked out for distinct ones. An
    empty table, or one without a stop, gives empty tables.
    """
    seen = stored(neighbour_counts(df, text_col), "piece-pairs")
    counts = _stop_counts(seen.groupBy("p").agg(F.sum("n").alias("n")))
    abbreviations = stored(abbreviation_scores(counts).where(F.col("score") >= ABBREVIATION), "abbreviations")
    # Pairs that differ in their marks alone are still apart; all that follows adds up.
    pairs = stored(
        with_forms(with_forms(seen, "p", "p"), "q", "q").select(
            F.col("p_type").alias("first"), F.col("q_type").alias("second"), F.col("p_stop").alias("stop"), F.col("p_ends").alias("ends"),
            is_initial(F.col("p_core")).alias("initial"), F.col("q_upper").alias("upper"), F.col("q_lower").alias("lower"), "n",
        ),
        "neighbours",
    )
    known = abbreviations.select(F.col("type").alias("first"), F.lit(True).alias("abbreviation"), F.col("with_stop").alias("weight"))
    marked = lookup(pairs, stored(known, "known"), ["first"], weight="weight").withColumn("abbreviation", F.coalesce("abbreviation", F.lit(False)))
    # A sure end: a mark, or a stop behind what is no abbreviation, initial or number.
    sure = F.col("ends") | (F.col("stop") & ~F.col("abbreviation") & ~F.col("initial") & (F.col("first") != NUMBER_TYPE))
    marked = stored(marked.withColumn("sure", sure), "marked")
    totals = marked.groupBy().agg(F.sum("n").alias("__n"), F.coalesce(F.sum(F.when(F.col("sure"), F.col("n"))), F.lit(0)).alias("__ends"))

    word = marked.where("second IS NOT NULL AND second <> ''").withColumnRenamed("second", "type")
    after = F.coalesce(F.sum(F.when(F.col("sure") & F.col("upper"), F.col("n"))), F.lit(0))
    counted = word.where(F.col("type").rlike(r"\p{L}")).groupBy("type").agg(F.sum("n").alias("all"), after.alias("n"))
    rows = attach_row(counted.where("n > 0"), totals)
    ratio = dunning(F.col("__ends"), F.col("all"), F.col("n"), F.col("__n"))
    more = F.col("n") / F.col("__ends") > F.col("all") / F.col("__n")
    starters = rows.withColumn("ratio", F.when(F.col("__n") > F.col("__ends"), ratio)).where(more & (F.col("ratio") >= STARTER)).select("type", "n", "ratio")

    free = F.col("upper") | F.col("lower")
    cases = word.where(free).groupBy("type").agg(
        F.sum(F.when(F.col("upper") & ~F.col("sure") & ~F.col("stop"), F.col("n")).otherwise(0)).alias("upper_inside"),
        F.sum(F.when(F.col("lower"), F.col("n")).otherwise(0)).alias("lower_seen"),
        F.sum(F.when(F.col("upper") & F.col("sure"), F.col("n")).otherwise(0)).alias("upper_at_start"),
    )
    return Learnt(abbreviations, stored(starters, "starters"), stored(_collocations(marked, counts, totals), "collocations"), stored(cases, "cases"))


def _collocations(marked: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Pairs that a stop joins more often than chance, the first an abbreviation, an initial or a number."""
    weak = F.col("stop") & (F.col("abbreviation") | F.col("initial") | (F.col("first") == NUMBER_TYPE))
    pairs = marked.where(weak & F.col("second").isNotNull() & (F.col("second") != "")).groupBy("first", "second").agg(F.sum("n").alias("n"))
    sizes = counts.select(F.col("type"), (F.col("with_stop") + F.col("without_stop")).alias("all"), "with_stop")
    sizes = stored(sizes, "sizes")
    rows = lookup(pairs.where("n > 1"), sizes.select(F.col("type").alias("first"), F.col("all").alias("of_first"), F.col("all").alias("w")), ["first"], "w", how="inner")
    rows = lookup(rows, sizes.select(F.col("type").alias("second"), F.col("all").alias("of_second"), F.col("all").alias("w")), ["second"], "w", how="inner")
    rows = attach_row(rows, totals)
    ratio = dunning(F.col("of_first"), F.col("of_second"), F.col("n"), F.col("__n"))
    more = F.col("n") / F.col("of_first") > F.col("of_second") / F.col("__n")
    return rows.withColumn("ratio", ratio).where(more & (F.col("ratio") >= COLLOCATION)).select("first", "second", "n", "ratio")


def _is(rows: DataFrame, table: DataFrame, on: list[str], flag: str, weight: str) -> DataFrame:
    """``rows`` and whether ``table`` holds their key."""
    keys = stored(table.select(*on, F.lit(True).alias(flag), F.col(weight).alias("__weight")), flag)
    return lookup(rows, keys, on, weight="__weight").withColumn(flag, F.coalesce(flag, F.lit(False)))


def kept_stops(df: DataFrame, learnt: Learnt, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(id, kept)``: places (from 0) of the pieces whose stop belongs to the word and ends no sentence.

    Only pieces that may be such are looked up: abbreviations, initials and numbers with a stop. An abbreviation
    ends a sentence if the word behind it is upper case and either is else only known in lower case inside of
    sentences or starts sentences often. An initial or a number does unless the word behind is lower case, or,
    behind an initial, a name: a word never seen in lower case. A learnt pair is never parted. Texts without such
    a place are left out.
    """
    cut = df.select(id_col, raw_pieces(F.col(text_col)).alias("__r"))
    placed = F.transform(_neighbours(F.col("__r")), lambda p, i: F.struct(i.alias("place"), p["p"].alias("p"), p["q"].alias("q")))
    # Only pieces with a stop and another piece behind them leave their text, each with that one alone.
    stops = cut.select(id_col, F.inline(F.filter(placed, lambda p: F.contains(p["p"], F.lit(".")) & p["q"].isNotNull())))
    rows = with_forms(with_forms(stops, "p", "p"), "q", "q").where("p_stop").select(
        id_col, "place", F.col("p_type").alias("first"), is_initial(F.col("p_core")).alias("initial"),
        F.col("q_type").alias("second"), F.col("q_upper").alias("upper"), F.col("q_lower").alias("lower"),
    )
    known = learnt.abbreviations.withColumnRenamed("type", "first")
    rows = _is(rows, known, ["first"], "abbreviation", "with_stop")
    number = F.col("first") == NUMBER_TYPE
    rows = stored(rows.where(F.col("abbreviation") | F.col("initial") | number), "weak-stops")
    rows = _is(rows, learnt.collocations, ["first", "second"], "joined", "n")
    rows = _is(rows, learnt.starters.withColumnRenamed("type", "second"), ["second"], "starter", "n")
    cases = learnt.cases.withColumnRenamed("type", "second").withColumn("weight", F.col("upper_inside") + F.col("lower_seen"))
    rows = lookup(rows, stored(cases, "second-cases"), ["second"], weight="weight").na.fill(0, ["upper_inside", "lower_seen", "upper_at_start"])
    starts = F.col("upper") & (F.col("lower_seen") > 0) & (F.col("upper_inside") == 0)
    name = F.col("initial") & F.col("upper") & (F.col("lower_seen") == 0)
    word = F.col("abbreviation") & ~F.col("initial")
    ends = F.when(F.col("joined"), False).when(word, starts | (F.col("upper") & F.col("starter"))).otherwise(~F.col("lower") & ~name)
    return rows.where(~ends).groupBy(id_col).agg(F.sort_array(F.collect_list("place")).alias("kept"))


#: Stands for a stop that stays with its word while the other stops are taken off; no character of a text.
_HELD = "\ufdd0"


def held_text(text: Column, kept: Column) -> Column:
    """``text`` whose kept stops are replaced by a mark, its pieces parted by single spaces."""
    raw = raw_pieces(text)
    marked = F.transform(raw, lambda r, i: F.when(F.array_contains(kept, i), F.regexp_replace(r, r"\.([^.\p{L}\p{N}]*)$", _HELD + "$1")).otherwise(r))
    return F.when(F.size(kept) > 0, F.array_join(marked, " ")).otherwise(text)


def with_kept(df: DataFrame, learnt: Learnt, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``df`` with ``kept``, an empty array where a text keeps no stop; ids must not be shared by two rows."""
    kept = stored(kept_stops(df, learnt, text_col, id_col), "kept")
    local = bounded(kept, LIST_ROWS)
    joined = df.join(kept if local is None else F.broadcast(local), id_col, "left")
    return joined.withColumn("kept", F.coalesce("kept", F.array().cast("array<int>")))


def word_tokens(df: DataFrame, learnt: Learnt, words: Column | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``df`` with ``tokens``: the word tokeniser's, but that abbreviations keep their stop.

    ``words`` are the tokens of the column ``held`` by another tokeniser; by default :func:`text.word_pieces`.
    """
    rows = with_kept(df, learnt, text_col, id_col).withColumn("held", held_text(F.col(text_col), F.col("kept")))
    found = word_pieces("held") if words is None else words
    tokens = F.transform(found, lambda t: F.replace(t, F.lit(_HELD), F.lit(".")))
    return rows.withColumn("tokens", tokens).drop("held", "kept")


def sentences(df: DataFrame, learnt: Learnt, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(id, number, sentence)``: the sentences of each text, numbered from 0, with single spaces between words.

    A sentence ends behind ``!``, ``?``, two stops and more, and behind every stop that is not kept.
    """
    rows = with_kept(df, learnt, text_col, id_col).select(id_col, "kept", raw_pieces(F.col(text_col)).alias("__r"))

    def end(raw: Column, place: Column) -> Column:
        bare = _bare(raw)
        ends = _ends(raw, bare)
        stop = _stop(raw, _core(bare), ends)
        # Most pieces hold no such mark, and are not looked at any closer.
        return F.when(raw.rlike("[.!?]"), ends | (stop & ~F.array_contains("kept", place))).otherwise(False)

    # No piece holds a line break, so one behind the last piece of a sentence is where it is cut, all in one go.
    marked = F.array_join(F.transform("__r", lambda r, i: F.when(end(r, i), F.concat(r, F.lit("\n"))).otherwise(r)), " ")
    spelled = F.split(F.regexp_replace(marked, r"\n\z", ""), "\n ")
    return rows.where(F.size("__r") > 0).select(id_col, F.posexplode(spelled).alias("number", "sentence"))


def statistics(learnt: Learnt) -> DataFrame:
    """``(kind, word, second, n, value)`` of all that was learnt."""
    none = F.lit(None).cast("string")
    return (
        learnt.abbreviations.select(F.lit("abbreviation").alias("kind"), F.col("type").alias("word"), none.alias("second"), F.col("with_stop").alias("n"), F.col("score").alias("value"))
        .unionByName(learnt.starters.select(F.lit("starter").alias("kind"), F.col("type").alias("word"), none.alias("second"), "n", F.col("ratio").alias("value")))
        .unionByName(learnt.collocations.select(F.lit("collocation").alias("kind"), F.col("first").alias("word"), "second", "n", F.col("ratio").alias("value")))
    )

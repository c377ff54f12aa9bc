"""What is learnt from the corpus and kept as tables: topics, sentence ends, hashed classifiers; binned densities."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import VECS, documents, embeddings, query, quoted, rounded, sql_simple, sql_tfidf_tokens, texts
from corpometer.functions import text as T
from corpometer.functions.subwords import subword_tokens
from corpometer.operators import bags, density, distance, sketches, stats
from corpometer.plans import factors, hashed, layout, sentences, topic_tables
from corpometer.session import stored

#: A public vocabulary; the path is a parameter of the queries and of the library.
SUBWORDS = "/opt/tokenizers/byte_bpe_50k.json"

# --- topics ---

TOPICS, ROUNDS = 6, 2


def topic_sql(passes: int, k: int = TOPICS, rounds: int = ROUNDS, source: str = "documents") -> str:
    """Tables of the model after some passes: ``m`` (token, topic, w) is the last."""
    parts = [
        f"toks AS (SELECT doc_id, unnest({sql_simple('text')}) AS token FROM {source})",
        "c AS (SELECT doc_id, token, count(*) AS n FROM toks GROUP BY doc_id, token)",
        "size AS (SELECT count(DISTINCT doc_id) AS docs FROM c)",
        "f AS (SELECT token FROM c, size GROUP BY token, docs HAVING count(*) >= 5 AND count(*) <= greatest(1, floor(docs * 0.5::DOUBLE + 1e-9)))",
        "x AS (SELECT doc_id, token, n FROM c JOIN f USING (token))",
        "many AS (SELECT count(*) AS terms FROM f)",
        f"m0 AS (SELECT token, topic, -ln((CAST(('0x' || substr(md5('42:' || token || ':' || topic), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE) AS w "
        f"FROM f, (SELECT unnest(range({k})) AS topic))",
    ]
    for p in range(passes):
        parts.append(f"t{p} AS (SELECT topic, sum(w) + any_value(terms) / {k}.0::DOUBLE AS total FROM m{p}, many GROUP BY topic)")
        parts.append(f"g{p} AS (SELECT token, topic, (w + 1 / {k}.0::DOUBLE) / total AS weight FROM m{p} JOIN t{p} USING (topic))")
        share = "1.0::DOUBLE"
        source_rows = f"x JOIN g{p} USING (token)"
        for r in range(rounds):
            parts.append(
                f"r{p}_{r} AS (SELECT doc_id, token, topic, n * weight * {share} / sum(weight * {share}) OVER (PARTITION BY doc_id, token) AS given "
                f"FROM {source_rows})"
            )
            parts.append(f"s{p}_{r} AS (SELECT doc_id, topic, sum(given) + 1 / {k}.0::DOUBLE AS share FROM r{p}_{r} GROUP BY doc_id, topic)")
            share, source_rows = "share", f"x JOIN g{p} USING (token) JOIN s{p}_{r} USING (doc_id, topic)"
        parts.append(f"m{p + 1} AS (SELECT token, topic, sum(given) AS w FROM r{p}_{rounds - 1} GROUP BY token, topic)")
    parts.append(f"m AS (SELECT * FROM m{passes})")
    return ",\n    ".join(parts)


def _fitted(docs, passes, **options):
    counts, n = topic_tables.fitted_counts(docs, T.simple_tokens("text"))
    terms = topic_tables.kept_terms(counts, n)
    return topic_tables.fit(counts, terms, k=TOPICS, passes=passes, rounds=ROUNDS, **options)


@query("topic_step", f"WITH {topic_sql(1)} SELECT token, CAST(topic AS BIGINT) AS topic, round(w, 6) AS w FROM m")
def topic_step(spark, folder):
    """Expected counts of every term under every topic after one pass from the seeded start."""
    model, _ = _fitted(texts(spark, folder), 1)
    rows = model.terms.select("token", F.posexplode("w").alias("topic", "w"))
    return rounded(rows.withColumn("topic", F.col("topic").cast("bigint")), "w")


WORDS = f"""{topic_sql(2)}, tot AS (SELECT topic, sum(w) + any_value(terms) / {TOPICS}.0::DOUBLE AS total FROM m, many GROUP BY topic),
    weights AS (SELECT topic, token AS word, round((w + 1 / {TOPICS}.0::DOUBLE) / total, 12) AS weight FROM m JOIN tot USING (topic)),
    best AS (SELECT topic, word, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, word) AS rank, weight FROM weights)"""


@query("sharded_topic_words", f"WITH {WORDS} SELECT CAST(topic AS BIGINT) AS topic, rank, word FROM best WHERE rank <= 20")
def sharded_topic_words(spark, folder):
    """Heaviest words of each topic after two passes; the rows of rare terms are joined to the documents."""
    model, _ = _fitted(texts(spark, folder), 2, hot_terms=500)
    return topic_tables.topic_words(model, 20).select("topic", "rank", "word")


@query(
    "document_topics",
    f"""WITH {topic_sql(2)}, l AS (SELECT doc_id, topic, share - 1 / {TOPICS}.0::DOUBLE AS n FROM s1_{ROUNDS - 1}), last AS (SELECT doc_id, sum(n) AS total FROM l GROUP BY doc_id)
    SELECT doc_id, CAST(total AS BIGINT) AS n_words FROM (SELECT doc_id, round(total) AS total FROM last)""",
)
def document_topics(spark, folder):
    """Words of each document that the model knows, as its topics share them out."""
    model, inference = _fitted(texts(spark, folder), 2)
    counts = inference.run(model, ROUNDS, per_document=True)
    total = F.aggregate("topics", F.lit(0.0), lambda a, b: a + b)
    return counts.select("doc_id", F.round(total).cast("bigint").alias("n_words"))


# --- sentences ---

# The patterns of the library in the order in which they are taken off.
OPEN, CLOSE, MARKS = quoted(sentences._OPEN), quoted(sentences._CLOSE), quoted(sentences._MARKS)
LETTER, NUMBER = quoted(r"\p{L}"), quoted(sentences.NUMBER)


def piece_sql(source: str) -> str:
    """``w``: every piece of every text, in order, with what the library tells of it, and the one behind it."""
    return f"""cut AS (SELECT doc_id, unnest(rs) AS r, generate_subscripts(rs, 1) AS i FROM
            (SELECT doc_id, list_filter(regexp_split_to_array(text, {quoted(T.SPACE + '+')}), lambda t: t <> '') AS rs FROM {source})),
    bared AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(r, {OPEN}, ''), {CLOSE}, ''), {MARKS}, '') AS bare FROM cut),
    cored AS (SELECT doc_id, i, r, regexp_replace(bare, '([!?]+|\\.{{2,}})$', '') AS core,
            regexp_matches(bare, '([!?]|\\.\\.)$') AND NOT regexp_matches(r, {MARKS}) AS ends FROM bared),
    p AS (SELECT doc_id, i, core, ends, lower(regexp_replace(core, '\\.$', '')) AS low,
            regexp_matches(core, '[^.]\\.$') AND NOT ends AND NOT regexp_matches(r, {MARKS}) AS stop,
            regexp_matches(core, '^\\p{{Lu}}') AS upper, regexp_matches(core, '^\\p{{Ll}}') AS lower, regexp_matches(core, '^\\p{{L}}\\.$') AS initial FROM cored),
    w AS (SELECT *, CASE WHEN regexp_matches(low, {NUMBER}) THEN '{sentences.NUMBER_TYPE}' ELSE low END AS type FROM p)"""


def _ratio(a: str, b: str, ab: str, n: str) -> str:
    def log_l(hits, places, share):
        return (
            f"(CASE WHEN {hits} > 0 THEN ({hits}) * ln({share}) ELSE 0 END + CASE WHEN {places} > {hits} THEN (({places}) - ({hits})) * ln(1 - {share}) ELSE 0 END)"
        )

    p, p1, p2 = f"({b} / {n})", f"({ab} / {a})", f"(({b} - {ab}) / ({n} - {a}))"
    same = f"{log_l(ab, a, p)} + {log_l(f'({b} - {ab})', f'({n} - {a})', p)}"
    apart = f"{log_l(ab, a, p1)} + {log_l(f'({b} - {ab})', f'({n} - {a})', p2)}"
    return f"-2 * ({same} - ({apart}))"


SENTENCES = f"""{piece_sql('documents')},
    sc AS (SELECT type, count(*) FILTER (WHERE stop) AS with_stop, count(*) FILTER (WHERE NOT stop) AS without_stop FROM w WHERE type <> '' GROUP BY type),
    whole AS (SELECT sum(with_stop) / sum(with_stop + without_stop) AS share FROM sc),
    scored AS (SELECT type, with_stop, without_stop, -2 * (with_stop * ln(share) + CASE WHEN without_stop > 0 THEN without_stop * ln(1 - share) ELSE 0 END
            - with_stop * ln(0.99::DOUBLE) - without_stop * ln(0.01::DOUBLE)) * exp(-(length(type) - inside)) * (inside + 1)
            * pow(CAST(length(type) - inside AS DOUBLE), -without_stop) AS score
        FROM (SELECT *, length(type) - length(replace(type, '.', '')) AS inside FROM sc
            WHERE with_stop > 0 AND NOT regexp_matches(type, {NUMBER}) AND regexp_matches(type, {LETTER}) AND type <> '{sentences.NUMBER_TYPE}'), whole),
    ab AS (SELECT * FROM scored WHERE score >= {sentences.ABBREVIATION}),
    nb AS (SELECT doc_id, i, type AS first, stop, ends, initial, lead(type) OVER d AS second, lead(upper) OVER d AS upper, lead(lower) OVER d AS lower
        FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
    mk AS (SELECT *, first IN (SELECT type FROM ab) AS abbreviation FROM nb),
    sr AS (SELECT *, ends OR (stop AND NOT abbreviation AND NOT initial AND first <> '{sentences.NUMBER_TYPE}') AS sure FROM mk),
    tt AS (SELECT count(*) AS total, count(*) FILTER (WHERE sure) AS ended FROM sr),
    wd AS (SELECT * FROM sr WHERE second IS NOT NULL AND second <> ''),
    st AS (SELECT type, n, ratio FROM (SELECT type, n, CASE WHEN total > ended THEN {_ratio('ended', '"all"', 'n', 'total')} END AS ratio, n / ended > "all" / total AS more
        FROM (SELECT second AS type, count(*) AS "all", count(*) FILTER (WHERE sure AND upper) AS n FROM wd WHERE regexp_matches(second, {LETTER}) GROUP BY second), tt WHERE n > 0)
        WHERE more AND ratio >= {sentences.STARTER}),
    sz AS (SELECT type, with_stop + without_stop AS "all" FROM sc),
    cl AS (SELECT first, second, n, ratio FROM (SELECT first, second, n, {_ratio('a."all"', 'b."all"', 'n', 'total')} AS ratio, n / a."all" > b."all" / total AS more
        FROM (SELECT first, second, count(*) AS n FROM wd WHERE stop AND (abbreviation OR initial OR first = '{sentences.NUMBER_TYPE}') GROUP BY first, second HAVING count(*) > 1)
        JOIN sz a ON a.type = first JOIN sz b ON b.type = second, tt) WHERE more AND ratio >= {sentences.COLLOCATION}),
    cs AS (SELECT second AS type, count(*) FILTER (WHERE upper AND NOT sure AND NOT stop) AS upper_inside, count(*) FILTER (WHERE lower) AS lower_seen
        FROM wd WHERE upper OR lower GROUP BY second),
    kp AS (SELECT doc_id, i, CASE WHEN first || ' ' || second IN (SELECT first || ' ' || second FROM cl) THEN true
            WHEN abbreviation AND NOT initial THEN NOT (upper AND ((coalesce(lower_seen, 0) > 0 AND coalesce(upper_inside, 0) = 0) OR second IN (SELECT type FROM st)))
            ELSE lower OR (initial AND upper AND coalesce(lower_seen, 0) = 0) END AS kept
        FROM mk LEFT JOIN cs ON cs.type = second WHERE stop AND second IS NOT NULL AND (abbreviation OR initial OR first = '{sentences.NUMBER_TYPE}'))"""


@query(
    "sentence_statistics",
    f"""WITH {SENTENCES} SELECT 'abbreviation' AS kind, type AS word, NULL AS second, with_stop AS n, round(score, 6) AS value FROM ab
    UNION ALL SELECT 'starter', type, NULL, n, round(ratio, 6) FROM st UNION ALL SELECT 'collocation', first, second, n, round(ratio, 6) FROM cl""",
)
def sentence_statistics(spark, folder):
    """Abbreviations, words that start sentences and pairs that a stop joins, as the documents show them."""
    return rounded(sentences.statistics(sentences.learn(texts(spark, folder))), "value")


@query("stop_counts", f"WITH {SENTENCES} SELECT type, with_stop, without_stop FROM sc")
def stop_counts(spark, folder):
    return sentences.stop_counts(texts(spark, folder))


@query(
    "kept_stops",
    f"WITH {SENTENCES} SELECT doc_id, string_agg(CAST(i - 1 AS VARCHAR), ' ' ORDER BY i) AS kept FROM kp WHERE kept GROUP BY doc_id",
)
def kept_stops(spark, folder):
    """Places of the pieces whose stop ends no sentence."""
    docs = texts(spark, folder)
    found = sentences.kept_stops(docs, sentences.learn(docs))
    return found.select("doc_id", F.array_join(F.transform("kept", lambda i: i.cast("string")), " ").alias("kept"))


@query(
    "sentence_counts",
    f"""WITH {SENTENCES}, e AS (SELECT w.doc_id, w.i, ends OR (stop AND NOT coalesce(kept, false)) AS e, max(w.i) OVER (PARTITION BY w.doc_id) AS last
        FROM w LEFT JOIN kp ON kp.doc_id = w.doc_id AND kp.i = w.i)
    SELECT doc_id, count(*) FILTER (WHERE e OR i = last) AS n_sentences FROM e GROUP BY doc_id""",
)
def sentence_counts(spark, folder):
    """Sentences of each document by what all documents show about stops."""
    docs = texts(spark, folder)
    found = sentences.sentences(docs, sentences.learn(docs))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"))


# --- hashed classifier ---


@query(
    "hashed_term_counts",
    f"""WITH c AS (SELECT doc_id, md5('0:' || token) AS h, count(*) AS n FROM (SELECT doc_id, unnest({sql_tfidf_tokens('text')}) AS token FROM documents) GROUP BY doc_id, token)
    SELECT doc_id, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % {1 << hashed.BITS} AS place, CAST(sum(CASE WHEN substr(h, 9, 1) < '8' THEN n ELSE -n END) AS BIGINT) AS n
    FROM c GROUP BY doc_id, place HAVING sum(CASE WHEN substr(h, 9, 1) < '8' THEN n ELSE -n END) <> 0""",
)
def hashed_term_counts(spark, folder):
    counts = hashed.hashed_counts(texts(spark, folder), T.tfidf_tokens("text"))
    return counts.select("doc_id", F.col("place").cast("bigint").alias("place"), F.col("n").cast("bigint").alias("n"))


@query("hashed_classifier")
def hashed_classifier(spark, folder):
    """Scores of the test rows under weights learnt by gradient descent; tests compare them between layouts."""
    return hashed.classify_hashed(documents(spark, folder)).scored


# --- subwords ---


@query("subword_stats")
def subword_stats(spark, folder, path=SUBWORDS):
    """Statistics of each corpus on the subwords of a public vocabulary; tests compare them with the library's own."""
    return stats.corpus_stats(documents(spark, folder), tokenizer=subword_tokens(path))


# --- binned density ---

FINE = 8 * 39 + 1
BINNED = f"""WITH pts AS (SELECT corpus, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM {VECS}),
    shape AS (SELECT corpus, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, var_samp(x) AS sxx, var_samp(y) AS syy,
        covar_samp(x, y) AS sxy, pow(count(*), -1.0::DOUBLE / 3) AS f FROM pts GROUP BY corpus),
    axes AS (SELECT *, sxx * syy - sxy * sxy AS det, x0 - 3 * sqrt(sxx * f) AS lx, y0 - 3 * sqrt(syy * f) AS ly,
        (x1 - x0 + 6 * sqrt(sxx * f)) / {FINE - 1} AS dx, (y1 - y0 + 6 * sqrt(syy * f)) / {FINE - 1} AS dy FROM shape),
    placed AS (SELECT corpus, (x - lx) / dx AS u, (y - ly) / dy AS v, floor((x - lx) / dx) AS i, floor((y - ly) / dy) AS j FROM pts JOIN axes USING (corpus)),
    dealt AS (SELECT corpus, i, j, (1 - u + i) * (1 - v + j) AS mass FROM placed UNION ALL SELECT corpus, i + 1, j, (u - i) * (1 - v + j) FROM placed
        UNION ALL SELECT corpus, i, j + 1, (1 - u + i) * (v - j) FROM placed UNION ALL SELECT corpus, i + 1, j + 1, (u - i) * (v - j) FROM placed),
    nodes AS (SELECT corpus, i, j, sum(mass) AS mass FROM dealt GROUP BY corpus, i, j),
    grid AS (SELECT corpus, point_x, point_y, lx, ly, dx, dy, syy / det / f AS a, sxx / det / f AS b, sxy / det / f AS c, n * 2 * pi() * sqrt(det) * f AS scale
        FROM axes, (SELECT unnest(range(40)) AS point_x), (SELECT unnest(range(40)) AS point_y)),
    dense AS (SELECT corpus, point_x, point_y, lx + 8 * point_x * dx AS gx, ly + 8 * point_y * dy AS gy,
        sum(mass * exp(-0.5 * (a * pow((8 * point_x - i) * dx, 2) + b * pow((8 * point_y - j) * dy, 2) - 2 * c * (8 * point_x - i) * dx * (8 * point_y - j) * dy))) / any_value(scale) AS density
        FROM grid JOIN nodes USING (corpus) GROUP BY corpus, point_x, point_y, gx, gy)
    SELECT corpus, point_x, point_y, round(gx, 6) AS x, round(gy, 6) AS y, round(density, 6) AS density FROM dense"""


@query("binned_density_grid", BINNED)
def binned_density_grid(spark, folder):
    """The density of the first two numbers of each embedding, from points dealt out to a finer grid."""
    points = embeddings(spark, folder).select("corpus", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    return rounded(density.binned_density_grid(points, points=40).drop("level"), "x", "y", "density")


# --- sketches ---


@query(
    "sketched_wasserstein",
    """SELECT direction, 'synthetic' AS corpus, n, true AS within_error FROM (SELECT CAST(unnest(range(128)) AS INTEGER) AS direction),
        (SELECT count(*) FILTER (WHERE label >= 5) AS n FROM embeddings WHERE embedding IS NOT NULL)""",
)
def sketched_wasserstein(spark, folder):
    """Whether the distance from merged sketches is as near to the exact one as it promises, along every direction."""
    rows = embeddings(spark, folder)
    halves = [rows.where(F.pmod("vec_id", F.lit(2)) == half) for half in (0, 1)]
    vectors = distance.directions(64, 128, 42)
    parts = [stored(sketches.value_sketches(distance.project(h, vectors), "value", ["corpus", "direction"]), "sketches") for h in halves]
    merged = stored(sketches.merged_sketches(parts[0].unionByName(parts[1]), ["corpus", "direction"]), "merged-sketches")
    found = sketches.sketched_distances(merged, "real", ["synthetic"])
    exact = distance.sliced_distances(rows, 64, n_projections=128).select("direction", "corpus", F.col("distance").alias("exact"))
    sizes = merged.where("corpus <> 'real'").select("direction", "corpus", "n")
    joined = found.join(exact, ["direction", "corpus"]).join(sizes, ["direction", "corpus"])
    return joined.select("direction", "corpus", "n", (F.abs(F.col("distance") - F.col("exact")) <= F.col("error")).alias("within_error"))


# --- word vectors and views ---


@query(
    "word_information",
    f"""WITH toks AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS p FROM (SELECT doc_id, {sql_simple('text')} AS t FROM documents)),
    f AS (SELECT token FROM toks GROUP BY token HAVING count(*) >= 5),
    k AS (SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS p FROM toks JOIN f USING (token)),
    pairs AS (SELECT a.token AS i, b.token AS j, count(*) AS n FROM k a JOIN k b ON a.doc_id = b.doc_id AND b.p - a.p BETWEEN 1 AND {factors.WINDOW} GROUP BY a.token, b.token),
    n AS (SELECT i, j, sum(n) AS n FROM (SELECT i, j, n FROM pairs UNION ALL SELECT j, i, n FROM pairs) GROUP BY i, j),
    s AS (SELECT i, sum(n) AS total FROM n GROUP BY i),
    x AS (SELECT n.i, n.j, ln(n.n * CAST((SELECT sum(total) FROM s) AS DOUBLE) / (CAST(a.total AS DOUBLE) * b.total)) AS x FROM n JOIN s a ON a.i = n.i JOIN s b ON b.i = n.j)
    SELECT i AS token, count(*) AS n_near, round(sum(x), 4) AS information FROM x WHERE x > 0 GROUP BY i""",
)
def word_information(spark, folder):
    """Of every word how many others it is near to more often than by chance, and the information in that."""
    docs = stored(texts(spark, folder).select("doc_id", T.simple_tokens("text").alias("tokens")), "tokens")
    counts = docs.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("cf")).where("cf >= 5")
    ids = bags.dictionary(counts)
    found = factors.positive_information(factors.co_occurrences(bags.encode(docs, F.col("tokens"), ids)))
    totals = found.groupBy(F.col("i").alias("token_id")).agg(F.count(F.lit(1)).alias("n_near"), F.round(F.sum("x"), 4).alias("information"))
    return totals.join(ids, "token_id").select("token", "n_near", "information")


@query("factored_text_vectors")
def factored_text_vectors(spark, folder):
    """Mean factored word vectors of all documents; tests compare the factors with those of numpy."""
    docs = texts(spark, folder).select("doc_id", "text")
    words = factors.word_vectors(docs, T.simple_tokens("text"), width=32)
    return factors.text_vectors(docs, T.simple_tokens("text"), words, 32)


@query("neighbour_view")
def neighbour_view(spark, folder):
    """Places in the plane for all embeddings; tests compare the neighbours kept with those of principal components."""
    return layout.neighbour_view(embeddings(spark, folder), "embedding", "vec_id", ("corpus",))

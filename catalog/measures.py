"""Distances, densities, windows, coherence, losses, timings and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import DOCS, VECS, documents, embeddings, generation_log, query, rounded, sql_simple, sql_space, table, texts
from catalog.vocabulary import STATS, stats_sql
from corpometer.functions import text as T
from corpometer.operators import coherence as co
from corpometer.operators import density, distance, reports, stats, timing
from corpometer.operators import kneser_ney
from corpometer.operators import language_model as lm
from corpometer.operators.joins import attach
from corpometer.operators.sampling import batches
from corpometer.operators.windows import pair_windows, window_totals, word_intervals, word_windows
from corpometer.plans import evaluate as ev
from corpometer.session import stored

WIDTH, N_DIRECTIONS = 64, 128


def _directions_sql() -> str:
    rows = ", ".join(
        f"({i}, [{', '.join(repr(float(x)) for x in row)}]::DOUBLE[])"
        for i, row in enumerate(distance.directions(WIDTH, N_DIRECTIONS, 42))
    )
    return f"(VALUES {rows}) AS dirs(direction, u)"


PROJECTED = f"""proj AS (SELECT vec_id, corpus, CAST(direction AS INTEGER) AS direction, list_inner_product(CAST(embedding AS DOUBLE[]), u) AS value
    FROM {VECS}, {_directions_sql()})"""
W1 = f"""{PROJECTED}, c AS (SELECT direction, value, count(*) FILTER (WHERE corpus = 'real') AS a, count(*) FILTER (WHERE corpus = 'synthetic') AS b
        FROM proj GROUP BY direction, value),
    r AS (SELECT direction, value, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY direction) AS na,
        sum(b) OVER (PARTITION BY direction) AS nb, lead(value) OVER w AS nxt FROM c WINDOW w AS (PARTITION BY direction ORDER BY value)),
    d AS (SELECT direction, 'synthetic' AS corpus, sum(abs(ca / na - cb / nb) * coalesce(nxt - value, 0)) AS distance FROM r GROUP BY direction)"""


@query("projected_embeddings", f"WITH {PROJECTED} SELECT vec_id, direction, round(value, 6) AS value FROM proj")
def projected_embeddings(spark, folder):
    dots = distance.project(embeddings(spark, folder), distance.directions(WIDTH, N_DIRECTIONS, 42), keep=["vec_id"])
    return rounded(dots, "value")


@query("wasserstein_per_direction", f"WITH {W1} SELECT direction, corpus, round(distance, 6) AS distance FROM d")
def wasserstein_per_direction(spark, folder):
    dists = distance.sliced_distances(embeddings(spark, folder), WIDTH, n_projections=N_DIRECTIONS)
    return rounded(dists, "distance")


@query(
    "sliced_wasserstein",
    f"WITH {W1} SELECT corpus, round(avg(distance), 6) AS mean_distance, CAST(count(*) AS BIGINT) AS n FROM d GROUP BY corpus",
)
def sliced_wasserstein(spark, folder):
    dists = distance.sliced_distances(embeddings(spark, folder), WIDTH, n_projections=N_DIRECTIONS)
    mean = distance.sliced_wasserstein(dists)
    return mean.select(
        "corpus", F.round("mean_distance", 6).alias("mean_distance"), F.size("distances").cast("bigint").alias("n")
    )


@query(
    "length_wasserstein",
    f"""WITH c AS (SELECT n_chars AS value, count(*) FILTER (WHERE corpus = 'real') AS a, count(*) FILTER (WHERE corpus = 'synthetic') AS b FROM {DOCS} GROUP BY n_chars),
    r AS (SELECT value, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb, lead(value) OVER w AS nxt FROM c WINDOW w AS (ORDER BY value))
    SELECT 'synthetic' AS corpus, round(sum(abs(ca / na - cb / nb) * coalesce(nxt - value, 0)), 6) AS distance FROM r""",
)
def length_wasserstein(spark, folder):
    return rounded(
        distance.wasserstein_1d(documents(spark, folder), "real", ["synthetic"], "n_chars"), "distance"
    )


@query(
    "distance_histogram",
    f"""WITH {W1}, s AS (SELECT min(distance) AS lo, max(distance) AS hi, avg(distance) AS m FROM d),
    p AS (SELECT CAST(least(floor((distance - lo) / ((hi - lo) / 30)), 29) AS BIGINT) AS bin FROM d, s)
    SELECT 'synthetic' AS corpus, bin, round(min(lo + bin * ((hi - lo) / 30)), 6) AS low, round(min(lo + (bin + 1) * ((hi - lo) / 30)), 6) AS high,
        count(*) AS n, round(min(m), 6) AS mean FROM p, s GROUP BY bin""",
)
def distance_histogram(spark, folder):
    dists = distance.sliced_distances(embeddings(spark, folder), WIDTH, n_projections=N_DIRECTIONS)
    return rounded(density.histogram(density.value_counts(dists, "distance")), "low", "high", "mean")


LENGTHS = f"lens AS (SELECT corpus, CAST(len({sql_space('text')}) AS DOUBLE) AS value FROM {DOCS})"


@query(
    "length_histogram",
    f"""WITH {LENGTHS}, s AS (SELECT corpus, min(value) AS lo, max(value) AS hi, avg(value) AS m FROM lens GROUP BY corpus),
    p AS (SELECT corpus, CAST(least(floor((value - lo) / ((hi - lo) / 30)), 29) AS BIGINT) AS bin, lo, hi, m FROM lens JOIN s USING (corpus))
    SELECT corpus, bin, round(min(lo + bin * ((hi - lo) / 30)), 6) AS low, round(min(lo + (bin + 1) * ((hi - lo) / 30)), 6) AS high,
        count(*) AS n, round(min(m), 6) AS mean FROM p GROUP BY corpus, bin""",
)
def length_histogram(spark, folder):
    counts = density.value_counts(documents(spark, folder), T.word_count("text"))
    return rounded(density.histogram(counts), "low", "high", "mean")


@query(
    "length_density",
    f"""WITH {LENGTHS}, s AS (SELECT corpus, count(*) AS n, min(value) AS lo, max(value) AS hi, stddev_samp(value) * pow(count(*), -0.2) AS h FROM lens GROUP BY corpus),
    e AS (SELECT corpus, n, h, greatest(lo - 3 * h, 0) AS a, least(hi + 3 * h, 4000) AS b FROM s),
    g AS (SELECT corpus, n, h, point, a + point * ((b - a) / 199) AS x FROM e, (SELECT unnest(range(200)) AS point))
    SELECT corpus, point, round(x, 6) AS x, round(sum(exp(-0.5 * ((x - value) / h) * ((x - value) / h))) / (min(n) * min(h) * sqrt(2 * pi())), 6) AS density
    FROM g JOIN lens USING (corpus) GROUP BY corpus, point, x""",
)
def length_density(spark, folder):
    curve, _ = ev.length_table(documents(spark, folder))
    return rounded(curve, "x", "density")


@query(
    "length_quantiles",
    f"""WITH {LENGTHS} SELECT corpus, share, round(CASE share WHEN 0.05 THEN quantile_cont(value, 0.05) WHEN 0.25 THEN quantile_cont(value, 0.25)
        WHEN 0.5 THEN quantile_cont(value, 0.5) WHEN 0.75 THEN quantile_cont(value, 0.75) ELSE quantile_cont(value, 0.95) END, 6) AS value
    FROM lens, (SELECT CAST(unnest([0.05, 0.25, 0.5, 0.75, 0.95]) AS DOUBLE) AS share) GROUP BY corpus, share""",
)
def length_quantiles(spark, folder):
    _, quantiles = ev.length_table(documents(spark, folder))
    return rounded(quantiles, "value")


DENSITY_GRID = f"""WITH pts AS (SELECT corpus, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM {VECS}),
    shape AS (SELECT corpus, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, var_samp(x) AS sxx, var_samp(y) AS syy,
        covar_samp(x, y) AS sxy, pow(count(*), -1.0::DOUBLE / 3) AS f FROM pts GROUP BY corpus),
    axes AS (SELECT *, sxx * syy - sxy * sxy AS det, 3 * sqrt(sxx * f) AS hx, 3 * sqrt(syy * f) AS hy FROM shape),
    grid AS (SELECT corpus, point_x, point_y, x0 - hx + point_x * (x1 - x0 + 2 * hx) / 39 AS gx, y0 - hy + point_y * (y1 - y0 + 2 * hy) / 39 AS gy,
        syy / det / f AS a, sxx / det / f AS b, sxy / det / f AS c, n * 2 * pi() * sqrt(det) * f AS scale
        FROM axes, (SELECT unnest(range(40)) AS point_x), (SELECT unnest(range(40)) AS point_y)),
    dense AS (SELECT corpus, point_x, point_y, gx, gy,
        sum(exp(-0.5 * (a * (gx - x) * (gx - x) + b * (gy - y) * (gy - y) - 2 * c * (gx - x) * (gy - y)))) / scale AS density
        FROM grid JOIN pts USING (corpus) GROUP BY corpus, point_x, point_y, gx, gy, scale),
    shares AS (SELECT *, (sum(density) OVER (PARTITION BY corpus ORDER BY density, point_x, point_y ROWS UNBOUNDED PRECEDING) - density)
        / sum(density) OVER (PARTITION BY corpus) AS share FROM dense)
    SELECT corpus, point_x, point_y, round(gx, 6) AS x, round(gy, 6) AS y, round(density, 6) AS density,
        CAST(CASE WHEN share >= 0.05 THEN floor((share - 0.05) / (0.95::DOUBLE / 19)) + 1 ELSE 0 END AS BIGINT) AS level FROM shares"""


@query("embedding_density_grid", DENSITY_GRID)
def embedding_density_grid(spark, folder):
    points = embeddings(spark, folder).select(
        "corpus", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y")
    )
    return rounded(density.density_grid(points, points=40), "x", "y", "density")


# --- windows and coherence ---

TOKENS = f"toks AS (SELECT corpus, doc_id, lang, {sql_simple('text')} AS tokens FROM {DOCS})"
TOPICS = """docfreq AS (SELECT corpus, lang AS topic, word, count(*) AS weight FROM
        (SELECT corpus, lang, doc_id, unnest(list_distinct(tokens)) AS word FROM toks) GROUP BY corpus, lang, word),
    topics AS (SELECT corpus, topic, word, rank FROM (SELECT corpus, topic, word,
        row_number() OVER (PARTITION BY corpus, topic ORDER BY weight DESC, word) AS rank FROM docfreq) WHERE rank <= 20),
    words AS (SELECT DISTINCT corpus, word FROM topics)"""
ISLANDS = """occ AS (SELECT corpus, doc_id, len(tokens) AS n, unnest(tokens) AS word, generate_subscripts(tokens, 1) - 1 AS p FROM toks),
    rng AS (SELECT corpus, doc_id, word, greatest(p - 109, 0) AS a, least(p, greatest(n - 110, 0)) AS b FROM occ JOIN words USING (corpus, word)),
    marked AS (SELECT *, CASE WHEN a > lag(b) OVER w + 1 THEN 1 ELSE 0 END AS fresh FROM rng WINDOW w AS (PARTITION BY corpus, doc_id, word ORDER BY a, b)),
    numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY corpus, doc_id, word ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM marked),
    ivl AS (SELECT corpus, doc_id, word, min(a) AS a, max(b) AS b FROM numbered GROUP BY corpus, doc_id, word, island),
    single AS (SELECT corpus, word, sum(b - a + 1) AS n FROM ivl GROUP BY corpus, word),
    wanted AS (SELECT DISTINCT x.corpus, x.word AS word_a, y.word AS word_b FROM topics x JOIN topics y ON x.corpus = y.corpus AND x.topic = y.topic AND x.word < y.word),
    pairs AS (SELECT i.corpus, word_a, word_b, sum(least(i.b, j.b) - greatest(i.a, j.a) + 1) AS n
        FROM ivl i JOIN wanted ON wanted.corpus = i.corpus AND word_a = i.word
        JOIN ivl j ON j.corpus = i.corpus AND j.doc_id = i.doc_id AND j.word = word_b AND j.a <= i.b AND i.a <= j.b
        GROUP BY i.corpus, word_a, word_b),
    totals AS (SELECT corpus, sum(greatest(CAST(len(tokens) AS BIGINT) - 109, 1)) AS w FROM toks GROUP BY corpus)"""


def _cut(spark, folder):
    """Documents with their tokens, which the topics, the windows and their totals all read, cut once."""
    docs = documents(spark, folder).select("corpus", "doc_id", "lang", T.simple_tokens("text").alias("tokens"))
    return stored(docs, "tokens"), F.col("tokens")


def _topics(docs, tokens):
    once = docs.select("corpus", F.col("lang").alias("topic"), F.explode(F.array_distinct(tokens)).alias("word"))
    weights = once.groupBy("corpus", "topic", "word").agg(F.count(F.lit(1)).alias("weight"))
    return co.top_words(weights, 20)


@query("topic_top_words", f"WITH {TOKENS}, {TOPICS} SELECT corpus, topic, rank, word FROM topics")
def topic_top_words(spark, folder):
    return _topics(documents(spark, folder), T.simple_tokens("text"))


@query("window_word_counts", f"WITH {TOKENS}, {TOPICS}, {ISLANDS} SELECT corpus, word, CAST(n AS BIGINT) AS n, CAST(w AS BIGINT) AS n_windows FROM single JOIN totals USING (corpus)")
def window_word_counts(spark, folder):
    docs, tokens = _cut(spark, folder)
    words = _topics(docs, tokens).select("corpus", "word").distinct()
    counts = word_windows(word_intervals(docs, tokens, words))
    return attach(counts, window_totals(docs, tokens), ["corpus"], how="inner")


@query("window_pair_counts", f"WITH {TOKENS}, {TOPICS}, {ISLANDS} SELECT corpus, word_a, word_b, CAST(n AS BIGINT) AS n FROM pairs")
def window_pair_counts(spark, folder):
    docs, tokens = _cut(spark, folder)
    topics = _topics(docs, tokens)
    intervals = word_intervals(docs, tokens, topics.select("corpus", "word").distinct())
    return pair_windows(intervals, co.topic_pairs(topics))


COHERENCE = f"""WITH {TOKENS}, {TOPICS}, {ISLANDS},
    prob AS (SELECT corpus, word AS word_a, word AS word_b, n FROM single UNION ALL SELECT corpus, word_a, word_b, n FROM pairs
        UNION ALL SELECT corpus, word_b, word_a, n FROM pairs),
    grid AS (SELECT x.corpus, x.topic, x.word AS word_a, y.word AS word_b FROM topics x JOIN topics y ON x.corpus = y.corpus AND x.topic = y.topic),
    sized AS (SELECT g.*, coalesce(p.n / w, 0) AS pab, sa.n / w AS pa, sb.n / w AS pb FROM grid g JOIN totals USING (corpus)
        LEFT JOIN prob p ON p.corpus = g.corpus AND p.word_a = g.word_a AND p.word_b = g.word_b
        LEFT JOIN single sa ON sa.corpus = g.corpus AND sa.word = g.word_a LEFT JOIN single sb ON sb.corpus = g.corpus AND sb.word = g.word_b),
    v AS (SELECT corpus, topic, word_a, word_b, CASE WHEN pab = 1 THEN 1 ELSE ln((pab + 1e-12) / (pa * pb)) / -ln(pab + 1e-12) END AS npmi FROM sized),
    s AS (SELECT *, sum(npmi) OVER (PARTITION BY corpus, topic, word_b) AS total FROM v),
    cosine AS (SELECT corpus, topic, word_a, sum(npmi * total) / (sqrt(sum(npmi * npmi)) * sqrt(sum(total * total))) AS c FROM s GROUP BY corpus, topic, word_a),
    cv AS (SELECT corpus, topic, avg(c) AS c_v FROM cosine GROUP BY corpus, topic)"""


@query("topic_coherence", COHERENCE + " SELECT corpus, topic, round(c_v, 6) AS c_v FROM cv")
def topic_coherence(spark, folder):
    docs, tokens = _cut(spark, folder)
    return rounded(co.coherence(docs, tokens, _topics(docs, tokens)), "c_v")


@query("mean_coherence", COHERENCE + " SELECT corpus, round(avg(c_v), 6) AS coherence FROM cv GROUP BY corpus")
def mean_coherence(spark, folder):
    docs, tokens = _cut(spark, folder)
    return rounded(co.mean_coherence(co.coherence(docs, tokens, _topics(docs, tokens))), "coherence")


# --- language model ---

def loss_sql(source: str, tokens: str, name: str = "d", train: str = "real") -> str:
    return f"""{name} AS (SELECT corpus, doc_id, {tokens} AS t FROM {source}),
    big AS (SELECT corpus, doc_id, unnest(list_slice(t, 1, len(t) - 1)) AS w1, unnest(list_slice(t, 2, len(t))) AS w2 FROM {name} WHERE len(t) > 1),
    pc AS (SELECT w1, w2, count(*) AS n FROM big WHERE corpus = '{train}' GROUP BY w1, w2),
    uc AS (SELECT w1, sum(n) AS n FROM pc GROUP BY w1),
    vocab AS (SELECT count(DISTINCT token) + 1 AS v FROM (SELECT unnest(t) AS token FROM {name} WHERE corpus = '{train}')),
    scored AS (SELECT corpus, doc_id, -ln((coalesce(pc.n, 0) + 0.1::DOUBLE) / (coalesce(uc.n, 0) + 0.1::DOUBLE * v)) AS loss
        FROM big LEFT JOIN pc USING (w1, w2) LEFT JOIN uc USING (w1), vocab)"""


THREE = f"(SELECT corpus, doc_id, text FROM {DOCS} UNION ALL SELECT 'benchmark', item_id, text FROM benchmark)"


def _three(spark, folder):
    docs = documents(spark, folder).select("corpus", "doc_id", "text")
    third = table(spark, folder, "benchmark").select(F.lit("benchmark").alias("corpus"), F.col("item_id").alias("doc_id"), "text")
    return docs.unionByName(third)


@query(
    "corpus_perplexity",
    f"""WITH {loss_sql(THREE, sql_space('text'))} SELECT corpus, round(exp(sum(loss) / count(*)), 6) AS perplexity FROM scored GROUP BY corpus""",
)
def corpus_perplexity(spark, folder):
    losses = lm.corpus_losses(_three(spark, folder), T.space_tokens("text"), "real")
    return rounded(lm.perplexity(losses), "perplexity")


DOC_LOSS = f"""WITH {loss_sql(DOCS, sql_space('text'))},
    doc AS (SELECT d.corpus, d.doc_id, coalesce(sum(loss), 0) AS nll, count(loss) AS n_tokens FROM d LEFT JOIN scored s ON s.doc_id = d.doc_id GROUP BY d.corpus, d.doc_id)"""


@query("document_losses", DOC_LOSS + " SELECT corpus, doc_id, round(nll, 6) AS nll, n_tokens FROM doc")
def document_losses(spark, folder):
    losses = lm.document_losses(documents(spark, folder), T.space_tokens("text"), "real")
    return rounded(losses.select("corpus", "doc_id", "nll", "n_tokens"), "nll")


def kneser_ney_sql(source: str, tokens: str, order: int, train: str = "real") -> str:
    """Tables of an interpolated model; ``scored`` has a row for each predicted token."""
    marks = "[" + ", ".join(["''"] * (order - 2)) + "]"
    parts = [
        f"t AS (SELECT corpus, doc_id, {tokens} AS w FROM {source})",
        f"padded AS (SELECT corpus, doc_id, list_concat({marks}, w) AS w FROM t WHERE len(w) >= 2)",
        f"places AS (SELECT corpus, doc_id, w, unnest(range(1, len(w) - {order - 2})) AS i FROM padded)",
        f"occ AS (SELECT corpus, doc_id, w[i:i + {order - 1}] AS gram FROM places)",
        f"l{order} AS (SELECT gram, count(*) FILTER (WHERE corpus = '{train}') AS c FROM occ GROUP BY gram)",
    ]
    for m in range(order - 1, 0, -1):
        parts.append(f"l{m} AS (SELECT gram[2:{m + 1}] AS gram, count(*) FILTER (WHERE c > 0) AS c FROM l{m + 1} GROUP BY 1)")
    for m in range(1, order + 1):
        parts.append(
            f"d{m} AS (SELECT CASE WHEN a > 0 THEN a / (a + 2 * b) ELSE 0.5::DOUBLE END AS d "
            f"FROM (SELECT count(*) FILTER (WHERE c = 1) AS a, count(*) FILTER (WHERE c = 2) AS b FROM l{m}))"
        )
        context = f"l.gram[1:{m - 1}]" if m > 1 else "0"
        parts.append(f"x{m} AS (SELECT {context} AS context, sum(c) AS total, count(*) FILTER (WHERE c > 0) AS types FROM l{m} l GROUP BY 1)")
        below, lower = ("b.p", f"JOIN p{m - 1} b ON b.gram = l.gram[2:{m}]") if m > 1 else ("1 / (types + 1)", "")
        parts.append(
            f"p{m} AS (SELECT l.gram, CASE WHEN total > 0 THEN (greatest(c - d, 0) + d * types * {below}) / total ELSE {below} END AS p "
            f"FROM l{m} l JOIN x{m} x ON x.context = {context} {lower} CROSS JOIN d{m})"
        )
    parts.append(f"scored AS (SELECT corpus, doc_id, -ln(p) AS loss FROM occ JOIN p{order} USING (gram))")
    return ",\n    ".join(parts)


@query(
    "kneser_ney_perplexity",
    f"WITH {kneser_ney_sql(THREE, sql_space('text'), 3)} SELECT corpus, round(exp(sum(loss) / count(*)), 6) AS perplexity FROM scored GROUP BY corpus",
)
def kneser_ney_perplexity(spark, folder):
    """Perplexity under a model of three words of the real corpus."""
    losses = kneser_ney.corpus_losses(_three(spark, folder), T.space_tokens("text"), "real", order=3)
    return rounded(lm.perplexity(losses), "perplexity")


@query(
    "kneser_ney_document_losses",
    f"""WITH {kneser_ney_sql(DOCS, sql_space('text'), 4)} SELECT d.corpus, d.doc_id, round(coalesce(sum(loss), 0), 6) AS nll, count(loss) AS n_tokens
    FROM {DOCS} d LEFT JOIN scored s ON s.doc_id = d.doc_id GROUP BY d.corpus, d.doc_id""",
)
def kneser_ney_document_losses(spark, folder):
    """Loss of every document under a model of four words of the real corpus."""
    losses = kneser_ney.document_losses(documents(spark, folder), T.space_tokens("text"), "real", order=4)
    return rounded(losses.select("corpus", "doc_id", "nll", "n_tokens"), "nll")


@query(
    "mean_batch_loss",
    DOC_LOSS
    + """, b AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 15 AS batch_id, nll, n_tokens FROM doc),
    p AS (SELECT batch_id, sum(nll) AS nll, sum(n_tokens) AS n FROM b GROUP BY batch_id)
    SELECT 'macro' AS average, round(avg(nll / nullif(n, 0)), 6) AS loss FROM p UNION ALL SELECT 'micro', round(sum(nll) / sum(n), 6) FROM p""",
)
def mean_batch_loss(spark, folder):
    losses = lm.document_losses(documents(spark, folder), T.space_tokens("text"), "real")
    numbered = batches(stored(losses, "document-losses"), 15)
    kinds = [
        lm.mean_batch_loss(numbered, average=kind).select(F.lit(kind).alias("average"), F.round("loss", 6).alias("loss"))
        for kind in ("macro", "micro")
    ]
    return kinds[0].unionByName(kinds[1])


# --- timing ---

@query(
    "generation_times",
    """SELECT event_type AS model, count(*) AS n, round(sum(value), 6) AS total_seconds, round(avg(value), 6) AS avg_seconds,
       round(avg(value) * 100000 / 3600 / 24, 6) AS days_per_100k, round(8.0::DOUBLE / avg(value), 6) AS speed_factor FROM events GROUP BY event_type""",
)
def generation_times(spark, folder):
    return rounded(
        timing.generation_times(generation_log(spark, folder)),
        "total_seconds", "avg_seconds", "days_per_100k", "speed_factor",
    )


RUN = """SELECT event_type AS model, event_id AS batch_id, value AS elapsed_time, sum(value) OVER w AS total_time, count(*) OVER w AS done,
    count(*) OVER (PARTITION BY event_type) AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)"""


@query("running_time", f"SELECT model, batch_id, elapsed_time, round(total_time, 6) AS total_time, done FROM ({RUN})")
def running_time(spark, folder):
    run = timing.running_time(generation_log(spark, folder))
    return rounded(run.select("model", "batch_id", "elapsed_time", "total_time", "done"), "total_time")


@query(
    "time_left",
    f"""SELECT model, batch_id, done, n - done AS remaining, CAST(round(total_time * (n - done), 6) AS DECIMAL(28, 6)) AS left_times_done FROM ({RUN})""",
)
def time_left(spark, folder):
    """The time left times the rows done, which has an end in decimals where the time left may have none."""
    left = timing.time_left(generation_log(spark, folder))
    exact = F.round(F.col("seconds_left") * F.col("done"), 6).cast("decimal(28,6)").alias("left_times_done")
    return left.select("model", "batch_id", "done", "remaining", exact)


# --- reports ---

SCORED_SQL = f"""scored AS (SELECT quality AS label, score, CAST(score >= 0.7 AS INTEGER) AS prediction FROM
    (SELECT d.doc_id, len(list_distinct(t)) / len(t) AS score FROM (SELECT doc_id, {sql_space('text')} AS t FROM documents) d WHERE len(t) > 0)
    JOIN labels USING (doc_id))"""


def scored_documents(spark, folder):
    """Labelled documents with a rule score: distinct tokens over tokens."""
    tokens = T.space_tokens("text")
    score = F.size(F.array_distinct(tokens)) / F.size(tokens)
    docs = texts(spark, folder).where(F.size(tokens) > 0).select("doc_id", score.alias("score"))
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return docs.join(labels, "doc_id").withColumn("prediction", (F.col("score") >= 0.7).cast("int"))


REPORT = f"""WITH {SCORED_SQL}, cls AS (SELECT unnest([0, 1]) AS class),
    m AS (SELECT class, count(*) FILTER (WHERE label = class AND prediction = class) AS hit, count(*) FILTER (WHERE prediction = class) AS said,
        count(*) FILTER (WHERE label = class) AS support FROM scored, cls GROUP BY class),
    s AS (SELECT class, CASE WHEN said = 0 THEN 0 ELSE hit / said END AS precision, CASE WHEN support = 0 THEN 0 ELSE hit / support END AS recall,
        CASE WHEN said + support = 0 THEN 0 ELSE 2 * hit / (said + support) END AS f1, support FROM m),
    acc AS (SELECT sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) / count(*) AS a, count(*) AS n FROM scored)"""


@query("confusion_counts", f"WITH {SCORED_SQL} SELECT label, prediction, count(*) AS n FROM scored GROUP BY label, prediction")
def confusion_counts(spark, folder):
    return reports.confusion(scored_documents(spark, folder))


@query(
    "class_report",
    REPORT
    + """ SELECT name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM (
    SELECT CAST(class AS VARCHAR) AS name, precision, recall, f1, support FROM s
    UNION ALL SELECT 'accuracy', a, a, a, n FROM acc
    UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM s
    UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM s)""",
)
def class_report(spark, folder):
    report = reports.class_report(reports.confusion(scored_documents(spark, folder)))
    return rounded(report, "precision", "recall", "f1")


AUC = """ranks AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM scored),
    auc AS (SELECT (sum(CASE WHEN label = 1 THEN r END) - p * (p + 1) / 2) / (p * q) AS roc_auc FROM ranks,
        (SELECT CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) AS p, CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) AS q FROM scored) GROUP BY p, q)"""


@query("roc_auc", f"WITH {SCORED_SQL}, {AUC} SELECT round(roc_auc, 6) AS roc_auc FROM auc")
def roc_auc(spark, folder):
    return rounded(reports.roc_auc(scored_documents(spark, folder)), "roc_auc")


@query(
    "summary_scores",
    f"{REPORT}, {AUC} SELECT round(a, 6) AS accuracy, round((SELECT avg(f1) FROM s), 6) AS macro_f1, round(roc_auc, 6) AS roc_auc FROM acc, auc",
)
def summary_scores(spark, folder):
    return rounded(reports.summary_scores(scored_documents(spark, folder)), "accuracy", "macro_f1", "roc_auc")


LONG = " UNION ALL ".join(f"SELECT corpus, '{m}' AS metric, {m} AS value FROM stats" for m in STATS)


@query(
    "metric_comparison",
    stats_sql(sql_space("text"), f""", long AS ({LONG}), b AS (SELECT metric, value FROM long WHERE corpus = 'real')
    SELECT metric, corpus, o.value AS value, b.value AS reference_value, round(o.value - b.value, 6) AS difference,
        row_number() OVER (PARTITION BY metric ORDER BY o.value DESC, corpus) AS place
    FROM long o JOIN b USING (metric) WHERE corpus <> 'real'""").replace(
        f"FROM {DOCS})", "FROM (SELECT doc_id, text, CASE WHEN lang = 'en' THEN 'real' ELSE lang END AS corpus FROM documents))"
    ),
)
def metric_comparison(spark, folder):
    """Every other language against English, on all statistics."""
    docs = documents(spark, folder).withColumn("corpus", F.when(F.col("lang") == "en", "real").otherwise(F.col("lang")))
    table_ = rounded(stats.corpus_stats(docs), *STATS).select("corpus", *STATS)
    return rounded(reports.comparison(stats.long_form(table_)), "difference")


@query(
    "models_ranked",
    """SELECT event_type AS corpus, 'avg_seconds' AS metric, round(avg(value), 6) AS value FROM events GROUP BY event_type""",
)
def models_ranked(spark, folder):
    times = timing.generation_times(generation_log(spark, folder))
    metrics = stats.long_form(times.select(F.col("model").alias("corpus"), "avg_seconds", "total_seconds"))
    return rounded(reports.ranked(metrics, "avg_seconds"), "value")


EVALUATION = stats_sql(
    sql_space("text"),
    ", long AS ("
    + " UNION ALL ".join(
        f"SELECT corpus, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM stats" for m in ("n_docs", *STATS)
    )
    + """), parts AS (SELECT CASE WHEN corpus = 'real' AND substr(md5('42:' || doc_id), 1, 8) >= '1999999a' THEN 'training' ELSE corpus END AS corpus,
        doc_id, tokens FROM d)""",
)


@query(
    "evaluation_report",
    EVALUATION
    + f""", {loss_sql('parts', 'tokens', 'part_tokens', 'training')}, dist AS (WITH {W1} SELECT * FROM d)
    SELECT corpus, metric, round(value, 6) AS value FROM (SELECT * FROM long
    UNION ALL SELECT corpus, 'perplexity', exp(sum(loss) / count(*)) FROM scored WHERE corpus <> 'training' GROUP BY corpus
    UNION ALL SELECT corpus, 'wasserstein', avg(distance) FROM dist GROUP BY corpus)""",
)
def evaluation_report(spark, folder):
    """The report without the fitted models, whose values no SQL can give."""
    report = ev.evaluate(
        documents(spark, folder),
        skip=("coherence", "classifier", "distance"),
    ).select("corpus", "metric", "value")
    dists = distance.sliced_distances(embeddings(spark, folder), WIDTH, n_projections=N_DIRECTIONS)
    part = distance.sliced_wasserstein(dists).select("corpus", F.lit("wasserstein").alias("metric"), F.col("mean_distance").alias("value"))
    return rounded(report.unionByName(part), "value")

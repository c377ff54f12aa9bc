"""Queries of this package over the given tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpometer.llm import (
    bloom, chat, decontaminate, licenses, logbilinear, merkle, nearest, pieces, quality, repeats, simhash, toxicity, urls,
)
from corpometer.llm.common import fold_of, read_table

#: Tokenizer files are read on the driver and travel with the tasks; the path is a parameter.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items that documents contain."""
    return decontaminate.contaminated(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


ORACLE["op1_benchmark_decontamination"] = r"""
WITH doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM documents
), item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM benchmark
), item_shingles AS (
  SELECT DISTINCT item_id, array_to_string(ws[i:i+4], ' ') AS s
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM item_words WHERE len(ws) >= 5)
), doc_shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM doc_words WHERE len(ws) >= 5)
), sizes AS (SELECT item_id, count(*) AS n_shingles FROM item_shingles GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_found, count(*) / n_shingles AS containment
FROM doc_shingles JOIN item_shingles USING (s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= ceil(0.8 * n_shingles - 1e-9)
"""


@query
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document; the fold of remainder 0 is not learnt from."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, folder, "labels"), folds=5, held_out=0)
    return toxicity.scored(docs, model).select(
        "doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages")
    )


@query
def op3_language_model(spark: SparkSession, folder: str) -> DataFrame:
    """Log-probability of every document under the model and the unigram base; the fold of remainder 2 is not learnt from."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    held_out = fold_of(F.col("doc_id"), 7) == 2
    found, total = logbilinear.scored_from(docs, docs.where(~held_out))
    return found.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"
    )


CONTROL_TEXT = "</s>[INST] ok [/INST]"


@query
def op4_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of all conversations, and of one whose texts are control strings, read back from the examples."""
    conversations = read_table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    return chat.read_back(chat.expanded(conversations.unionByName(control)))


ORACLE["op4_chat_formatting"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(role) + length(text) + 8
    + len(regexp_extract_all(role || ' ' || text, '<\\*(\||/s>|s>)')) + len(regexp_extract_all(role || ' ' || text, '\|\\*>'))
    + len(regexp_extract_all(role || ' ' || text, '\[\\*/?INST\]')) AS chars
  FROM turns
), run AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS so_far FROM sized
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  CAST(coalesce(sum(so_far) FILTER (role = 'assistant'), 0) AS BIGINT) AS expanded_chars,
  count(*) FILTER (role = 'assistant') AS n_examples
FROM run GROUP BY conv_id
"""


@query
def op5_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    vectors = read_table(spark, folder, "embeddings")
    return nearest.nearest(vectors.where("vec_id % 50 = 0"), vectors)


ORACLE["op5_nearest_vectors"] = """
WITH usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_cosine_similarity(q.v, c.v) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 5
"""


@query
def op6_sentencepiece(spark: SparkSession, folder: str, model: str = PIECE_MODEL) -> DataFrame:
    """Token ids of every document, and whether they spell it again."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return pieces.encoded(docs, pieces.load_model(model)).drop("text")


@query
def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Places of the fixed phrases in every document, and the labels of phrases and rules."""
    found = licenses.scanned(read_table(spark, folder, "documents").select("doc_id", "text"))
    starts = F.transform("base", lambda b: b["first"])
    own, added = F.transform("base", lambda b: b["label"]), F.transform("detections", lambda d: d["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(own).alias("base_labels"),
        joined(F.concat(own, added)).alias("labels"),
        "score",
    )


@query
def license_base_places(spark: SparkSession, folder: str) -> DataFrame:
    """The columns of op7_license_scan that come from the fixed phrases alone, which SQL can express."""
    return op7_license_scan(spark, folder).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


ORACLE["license_base_places"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), p AS (
  SELECT doc_id, ws, list_filter(range(1, len(ws) + 1), lambda i: ws[i] = 'cc' AND ws[i + 1] = 'by') AS cc,
    list_filter(range(1, len(ws) + 1), lambda i: ws[i] = 'general' AND ws[i + 1] = 'public' AND ws[i + 2] = 'license') AS gpl,
    list_filter(range(1, len(ws) + 1), lambda i: ws[i] = 'all' AND ws[i + 1] = 'rights' AND ws[i + 2] = 'reserved') AS res FROM w
)
SELECT doc_id, len(ws) AS n_words, len(cc) + len(gpl) + len(res) AS n_base,
  list_min(list_concat(cc, gpl, res)) - 1 AS first_word, list_max(list_concat(cc, gpl, res)) - 1 AS last_word,
  concat_ws(',', CASE WHEN len(cc) > 0 THEN 'cc-by' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(res) > 0 THEN 'reserved' END) AS base_labels
FROM p
"""


@query
def op8_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document; the fold of remainder 1 is not learnt from."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    model = quality.fit(docs, read_table(spark, folder, "labels"), folds=3, held_out=1)
    return quality.scored(docs, model).select(
        "doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted"
    )


@query
def op9_simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint of every document and the smallest id it is linked to."""
    found = simhash.components(read_table(spark, folder, "documents"))
    text = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", text.alias("fingerprint"), "component_id")


URL_RULES = (
    urls.Rule("block", "net", "/"),
    urls.Rule("allow", "example.net", "/en/"),
    urls.Rule("block", "example.com", "/de/"),
    urls.Rule("allow", "org", "/fr/"),
)


@query
def op10_url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict of every page's url; the method's own where no rule fits."""
    pages = read_table(spark, folder, "pages")
    return urls.judged(pages, urls.fit(pages, URL_RULES))


@query
def url_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The columns of op10_url_verdicts that come from the rules alone, which SQL can express."""
    return op10_url_verdicts(spark, folder).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


ORACLE["url_rules"] = r"""
WITH cut AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages
), found AS (
  SELECT *, CASE WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM cut
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS verdict FROM found
"""


@query
def op11_exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """The row that stays for every document, of those with the same text but for white space."""
    return bloom.copies(read_table(spark, folder, "documents"))


ORACLE["op11_exact_duplicates"] = r"""
WITH hashed AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM hashed WINDOW same AS (PARTITION BY text_sha256)
"""


def planted_repeats(doc_id: Column, text: Column) -> Column:
    """``text``, which repeats its words from place a on with period p where ten divides the id's crc32.

    With n words and g a tenth of the crc32, a is g % n and p is 1 + (n - a) / (3 + g % 8).
    """
    code = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    seed = F.floor(code / 10).cast("long")
    shape = F.transform(
        F.array(words),
        lambda ws: F.struct(ws.alias("ws"), (seed % F.size(ws)).cast("int").alias("a"), F.size(ws).alias("n")),
    )
    shape = F.transform(shape, lambda s: F.struct(s["ws"].alias("ws"), s["a"].alias("a"), s["n"].alias("n"), (1 + F.floor((s["n"] - s["a"]) / (3 + seed % 8))).cast("int").alias("p")))
    spelled = F.transform(
        shape,
        lambda s: F.array_join(F.transform(s["ws"], lambda w, i: F.when(i < s["a"], w).otherwise(s["ws"][s["a"] + (i - s["a"]) % s["p"]])), " "),
    )
    return F.when((code % 10 == 0) & (F.size(words) > 0), spelled[0]).otherwise(text)


@query
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of repeated word sequences in every document, with repeats put into a tenth of them."""
    docs = read_table(spark, folder, "documents").select("doc_id", planted_repeats(F.col("doc_id"), F.col("text")).alias("text"))
    found = repeats.with_runs(docs)
    line = lambda r: F.concat(*[part for n in ("start", "length", "period") for part in (r[n].cast("string"), F.lit("," if n != "period" else "\n"))])
    best = F.col("strongest")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


@query
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, proof and roots of every document, and the root that it folds to as tampered with."""
    docs = read_table(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    row = [F.col(c) for c in ("doc_id", "source", "lang")]
    found = F.when(hit, merkle.leaf_of(*row, F.col("n_chars").cast("long") + 1, F.col("text")))
    made = merkle.manifest(docs, merkle.leaf_of(*row, F.col("n_chars"), F.col("text")), found)
    proof = F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256")
    return made.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")



ORACLE["op13_merkle_manifest"] = """
WITH RECURSIVE rows AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, n_chars, CAST(doc_id AS VARCHAR) AS digits,
    coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail
  FROM documents
), coded AS (
  SELECT *, xor(4294967295, list_reduce(
      list_prepend(4294967295, list_transform(range(1, length(digits) + 1), lambda i: CAST(ascii(digits[i]) AS BIGINT))),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) AS crc
  FROM rows
), leaves AS (
  SELECT doc_id, g, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n,
    sha256(head || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL THEN sha256(head || length(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) || tail) END AS found
  FROM coded
), tree AS (
  SELECT g, 0 AS level, pos, n, leaf AS hash FROM leaves
  UNION ALL
  SELECT g, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY g, level, pos // 2, n
), subroots AS (
  SELECT g, hash, level AS height, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
), top AS (
  SELECT 0 AS level, pos, n, hash FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 2, n
), steps AS (
  SELECT l.doc_id, t.level AS step, t.pos < (l.pos >> t.level) AS before, t.hash
  FROM leaves l JOIN tree t ON t.g = l.g AND t.pos = xor(l.pos >> t.level, 1)
  UNION ALL
  SELECT l.doc_id, s.height + t.level, t.pos < (s.pos >> t.level), t.hash
  FROM leaves l JOIN subroots s ON s.g = l.g JOIN top t ON t.pos = xor(s.pos >> t.level, 1)
), heights AS (
  SELECT l.doc_id, s.height + (SELECT max(level) FROM top) AS height FROM leaves l JOIN subroots s ON s.g = l.g
), folded AS (
  SELECT doc_id, 0 AS step, coalesce(found, leaf) AS hash FROM leaves
  UNION ALL
  SELECT f.doc_id, f.step + 1, sha256(CASE WHEN s.before THEN s.hash || f.hash ELSE f.hash || coalesce(s.hash, '') END)
  FROM folded f JOIN heights h ON h.doc_id = f.doc_id AND f.step < h.height LEFT JOIN steps s ON s.doc_id = f.doc_id AND s.step = f.step
), proofs AS (
  SELECT doc_id, string_agg(hash, '' ORDER BY step) AS proof FROM steps GROUP BY doc_id
)
SELECT l.doc_id, l.leaf, s.hash AS subroot, r.hash AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
  f.hash AS folded_root, f.hash = r.hash AS verified
FROM leaves l JOIN subroots s ON s.g = l.g JOIN heights h ON h.doc_id = l.doc_id JOIN folded f ON f.doc_id = l.doc_id AND f.step = h.height
JOIN top r ON r.n = 1 LEFT JOIN proofs p ON p.doc_id = l.doc_id
"""

"""How well a classifier tells two corpora apart, on text or on embeddings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import CountVectorizer, ElementwiseProduct, IDF, Normalizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpometer.functions import text as T
from corpometer.operators.reports import class_report, confusion, summary_scores
from corpometer.operators.sampling import folds, split


ROWS_PER_PARTITION = 20_000


@dataclass
class Classified:
    """A fitted model, its scored test rows, the class report and the summary scores."""

    model: PipelineModel
    scored: DataFrame
    report: DataFrame
    scores: DataFrame


def labelled(df: DataFrame, synthetic: str | Sequence[str], corpus_col: str = "corpus") -> DataFrame:
    """Add ``label``: 1.0 for the synthetic corpora, 0.0 for the others."""
    names = [synthetic] if isinstance(synthetic, str) else list(synthetic)
    return df.withColumn("label", F.col(corpus_col).isin(*names).cast("double"))


def score_rows(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``prediction`` and ``score``, the probability of class 1."""
    return (
        model.transform(df)
        .withColumn("score", vector_to_array("probability")[1])
        .drop("rawPrediction", "probability")
    )


def _two_classes(train: DataFrame) -> None:
    if train.select("label").distinct().count() < 2:
        raise ValueError("Both corpora need rows to train a classifier.")


def _judged(model: PipelineModel, test: DataFrame, keep: Sequence[str]) -> Classified:
    scored = score_rows(model, test).select(*keep, "label", "prediction", "score")
    report = class_report(confusion(scored), {0: "real", 1: "synthetic"})
    return Classified(model, scored, report, summary_scores(scored))


def fit_tfidf(train: DataFrame, tokens_col: str = "tokens", max_features: int = 5000) -> PipelineModel:
    """TF-IDF with smoothing and unit length, fitted on training rows only.

    The library's inverse frequency has no ``+ 1``, so counts are scaled by it and 1 is added.
    """
    counts = CountVectorizer(inputCol=tokens_col, outputCol="__counts", vocabSize=max_features).fit(train)
    idf = IDF(inputCol="__counts", outputCol="__unused").fit(counts.transform(train))
    weights = Vectors.dense(idf.idf.toArray() + 1.0)
    scale = ElementwiseProduct(inputCol="__counts", outputCol="__scaled", scalingVec=weights)
    unit = Normalizer(inputCol="__scaled", outputCol="features", p=2.0)
    return PipelineModel([counts, scale, unit])


def classify_texts(
    df: DataFrame,
    synthetic: str | Sequence[str] = "synthetic",
    text_col: str = "text",
    id_col: str = "doc_id",
    corpus_col: str = "corpus",
    test_share: float = 0.3,
    max_features: int = 5000,
    max_iter: int = 100,
    reg: float = 1e-4,
    seed=42,
    stop_words=T.ENGLISH_STOP_WORDS,
) -> Classified:
    """Real against synthetic on TF-IDF of the words, with a stratified test split."""
    rows = labelled(df.where(T.has_text(text_col)), synthetic, corpus_col).select(
        id_col, corpus_col, "label", T.tfidf_tokens(text_col, stop_words).alias("tokens")
    )
    parts = split(rows, test_share, label_col="label", seed=seed, id_col=id_col)
    train = parts.where(F.col("split") == "train").persist()
    try:
        _two_classes(train)
        vectors = fit_tfidf(train, "tokens", max_features)
        learner = LogisticRegression(maxIter=max_iter, tol=1e-3, regParam=reg, standardization=False)
        fitted = learner.fit(vectors.transform(train))
    finally:
        train.unpersist()
    model = PipelineModel([*vectors.stages, fitted])
    return _judged(model, parts.where(F.col("split") == "test"), [id_col, corpus_col])


def classify_embeddings(
    df: DataFrame,
    synthetic: str | Sequence[str] = "synthetic",
    vector_col: str = "embedding",
    id_col: str = "doc_id",
    corpus_col: str = "corpus",
    test_share: float = 0.2,
    cv: int = 5,
    strengths: Sequence[float] = (0.1, 0.5, 1.0, 2.0, 5.0),
    seed=42,
    max_iter: int = 100,
    parallelism: int = 4,
) -> Classified:
    """Real against synthetic on embeddings; the penalty is chosen by cross-validated ROC AUC.

    ``strengths`` are inverse penalties ``C``; each becomes ``1 / (C * training rows)``.
    """
    rows = labelled(df, synthetic, corpus_col).select(
        id_col, corpus_col, "label", array_to_vector(F.col(vector_col).cast("array<double>")).alias("raw")
    )
    parts = split(rows, test_share, label_col="label", seed=seed, id_col=id_col)
    train = folds(parts.where(F.col("split") == "train"), cv, "label", seed, id_col).persist()
    try:
        _two_classes(train)
        n = train.count()
        scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)
        scaled = scaler.fit(train)
        learner = LogisticRegression(maxIter=max_iter, elasticNetParam=0.0, standardization=False)
        grid = ParamGridBuilder().addGrid(learner.regParam, [1.0 / (c * n) for c in strengths]).build()
        search = CrossValidator(
            estimator=learner,
            estimatorParamMaps=grid,
            evaluator=BinaryClassificationEvaluator(metricName="areaUnderROC"),
            numFolds=cv,
            foldCol="fold",
            parallelism=parallelism,
        )
        # Few rows in more partitions than there are cores would only add to the many short jobs of a fit.
        cores = df.sparkSession.sparkContext.defaultParallelism
        ready = scaled.transform(train).select("features", "label", "fold").coalesce(max(cores, n // ROWS_PER_PARTITION)).persist()
        best = search.fit(ready).bestModel
        ready.unpersist()
    finally:
        train.unpersist()
    model = PipelineModel([scaled, best])
    return _judged(model, parts.where(F.col("split") == "test"), [id_col, corpus_col])

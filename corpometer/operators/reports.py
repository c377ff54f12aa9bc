"""Classification reports, metric tables, rankings and JSON forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpometer.operators.joins import attach_row
from corpometer.operators.ranks import running_sums
from corpometer.session import stored


def confusion(df: DataFrame, label_col: str = "label", prediction_col: str = "prediction") -> DataFrame:
    """``(label, prediction, n)``."""
    return df.groupBy(
        F.col(label_col).cast("int").alias("label"), F.col(prediction_col).cast("int").alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def class_scores(counts: DataFrame) -> DataFrame:
    """``(class, precision, recall, f1, support)`` from confusion counts."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    marks = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("true"), F.lit(0).cast("bigint").alias("said"), hit.cast("bigint").alias("hit")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("true"), F.col("n").alias("said"), F.lit(0).cast("bigint").alias("hit")),
    )
    sums = counts.select(F.inline(marks)).groupBy("class").agg(
        F.sum("true").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit")
    )
    precision = _ratio(F.col("hit"), F.col("said"))
    recall = _ratio(F.col("hit"), F.col("support"))
    return sums.select(
        "class",
        precision.alias("precision"),
        recall.alias("recall"),
        _ratio(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"),
        "support",
    )


def class_report(counts: DataFrame, names: dict[int, str] | None = None) -> DataFrame:
    """``(name, precision, recall, f1, support)``: classes, accuracy, macro and weighted mean.

    The accuracy row holds the accuracy in all three places.
    """
    scores = class_scores(counts)
    title = F.col("class").cast("string")
    for value, name in (names or {}).items():
        title = F.when(F.col("class") == value, F.lit(name)).otherwise(title)
    classes = scores.select(title.alias("name"), "precision", "recall", "f1", "support")
    measures = ("precision", "recall", "f1")
    total = F.sum("support")
    macro = scores.agg(*[F.avg(m).alias(m) for m in measures], total.alias("support"))
    weighted = scores.agg(
        *[(F.sum(F.col(m) * F.col("support")) / total).alias(m) for m in measures], total.alias("support")
    )
    right = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)) / F.sum("n")
    accuracy = counts.agg(*[right.alias(m) for m in measures], F.sum("n").alias("support"))
    out = classes
    for name, part in (("accuracy", accuracy), ("macro avg", macro), ("weighted avg", weighted)):
        out = out.unionByName(part.withColumn("name", F.lit(name)))
    return out


def roc_auc(
    df: DataFrame, score_col: str = "score", label_col: str = "label", by: Sequence[str] = ()
) -> DataFrame:
    """Exact area under the ROC curve, tied scores counted half: ``(*by, roc_auc)``.

    Rows are counted per distinct score first; ranks come from running counts.
    """
    positive = F.when(F.col(label_col) == 1, 1).otherwise(0)
    counted = stored(
        df.groupBy(*by, F.col(score_col).cast("double").alias("__x")).agg(
            F.sum(positive).alias("__pos"), F.sum(1 - positive).alias("__neg")
        ),
        "score-counts",
    )
    run = running_sums(counted, "__x", {"__below": F.col("__neg")}, by=by)
    won = F.col("__pos") * (F.col("__below") - F.col("__neg") / 2)
    possible = F.sum("__pos").cast("double") * F.sum("__neg").cast("double")
    return run.groupBy(*by).agg(
        (F.sum(won) / F.when(possible > 0, possible)).alias("roc_auc")
    )


def summary_scores(df: DataFrame, score_col: str = "score", label_col: str = "label", prediction_col: str = "prediction") -> DataFrame:
    """One row of accuracy, macro F1 and ROC AUC."""
    report = class_report(confusion(df, label_col, prediction_col))
    pick = lambda name, column: F.max(F.when(F.col("name") == name, F.col(column)))
    scores = report.agg(
        pick("accuracy", "f1").alias("accuracy"), pick("macro avg", "f1").alias("macro_f1")
    )
    return attach_row(scores, roc_auc(df, score_col, label_col))


def ranked(metrics: DataFrame, metric: str, corpus_col: str = "corpus") -> DataFrame:
    """Corpora by one metric, high to low."""
    return metrics.where(F.col("metric") == metric).orderBy(F.desc("value"), corpus_col)


def comparison(
    metrics: DataFrame,
    reference: str = "real",
    corpus_col: str = "corpus",
) -> DataFrame:
    """Each corpus against the reference for each metric, with its place among the corpora.

    ``(metric, corpus, value, reference_value, difference, place)``; place 1 is the highest value.
    """
    base = metrics.where(F.col(corpus_col) == reference).select(
        "metric", F.col("value").alias("reference_value")
    )
    others = metrics.where(F.col(corpus_col) != reference)
    order = Window.partitionBy("metric").orderBy(F.desc("value"), corpus_col)
    return others.join(base, "metric", "left").select(
        "metric",
        corpus_col,
        "value",
        "reference_value",
        (F.col("value") - F.col("reference_value")).alias("difference"),
        F.row_number().over(order).cast("bigint").alias("place"),
    )


def json_report(stats: DataFrame, key: str = "corpus", name: str = "report") -> DataFrame:
    """``(key, report)``: the other columns of each row as one JSON object."""
    rest = [c for c in stats.columns if c != key]
    return stats.select(key, F.to_json(F.struct(*rest)).alias(name))


def from_json_report(reports: DataFrame, schema: str, name: str = "report") -> DataFrame:
    """Columns back from a JSON report."""
    kept = [c for c in reports.columns if c != name]
    return reports.select(*kept, F.from_json(name, schema).alias("__r")).select(*kept, "__r.*")


def flat_nested(df: DataFrame) -> DataFrame:
    """Every struct, array or map column as JSON text, so a CSV cell can hold it."""
    nested = {name for name, kind in df.dtypes if kind.startswith(("struct", "array", "map"))}
    return df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns])

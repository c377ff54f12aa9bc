"""Data preparation for generation and for training on generated text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpometer.functions import arrays as A
from corpometer.functions import text as T
from corpometer.functions.keys import row_id, uniform
from corpometer.functions.prompts import pick_topic, prompt_text, topic_list
from corpometer.operators.bags import encode
from corpometer.operators.sampling import split
from corpometer.operators.tables import token_limits


def prompt_table(
    ids: DataFrame, template: str, seed=42, id_col: str = "id", topics: Sequence[str] | None = None
) -> DataFrame:
    """``(id, uuid, topic, prompt)``: one prompt per id, about a topic picked for it."""
    names = topics if topics is not None else topic_list()
    picked = ids.select(id_col, pick_topic(seed, id_col, topics=names).alias("topic"))
    return picked.select(
        id_col,
        row_id(id_col, "topic").alias("uuid"),
        "topic",
        prompt_text(template, "topic").alias("prompt"),
    )


def generation_inputs(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    k: int = 100,
    seed=42,
    tokens: tuple[int, int] = (500, 1000),
    temperature: tuple[float, float] = (0.3, 0.8),
) -> DataFrame:
    """Prefix of ``k`` words, token limits from the original, and random settings per row."""
    limited = token_limits(df, text_col, k)
    drawn = F.floor(uniform(seed, F.lit("tokens"), id_col, low=tokens[0], high=tokens[1] + 1))
    return limited.select(
        id_col,
        "prefix",
        "max_new_tokens",
        "min_new_tokens",
        drawn.cast("bigint").alias("drawn_tokens"),
        uniform(seed, F.lit("temperature"), id_col, low=temperature[0], high=temperature[1]).alias("temperature"),
    )


def padded_ids(
    coded: DataFrame, length: int = 1024, pad_id: int = 0, id_col: str = "doc_id", mask_labels: bool = True
) -> DataFrame:
    """``(id, input_ids, attention_mask, labels)`` of one fixed length.

    Labels copy the ids; padded places get the ignored label unless ``mask_labels`` is off.
    """
    ids = A.truncate(F.col("input_ids"), length, context=None)
    shaped = coded.select(
        id_col,
        A.pad(ids, length, pad_id).alias("input_ids"),
        A.attention_mask(ids, length).alias("attention_mask"),
    )
    labels = A.masked_labels(F.col("input_ids"), F.col("attention_mask")) if mask_labels else F.col("input_ids")
    return shaped.withColumn("labels", labels)


def padded_batches(
    coded: DataFrame, batch_col: str = "batch_id", length: int = A.CONTEXT_LIMIT, pad_id: int = 0
) -> DataFrame:
    """Pad each row to the longest row of its batch, no longer than ``length``."""
    cut = coded.withColumn("input_ids", A.truncate(F.col("input_ids"), length, context=None))
    longest = F.max(F.size("input_ids")).over(Window.partitionBy(batch_col))
    sized = cut.withColumn("__longest", longest)
    return (
        sized.withColumn("attention_mask", A.attention_mask(F.col("input_ids"), F.col("__longest")))
        .withColumn("input_ids", A.pad(F.col("input_ids"), F.col("__longest"), pad_id))
        .drop("__longest")
    )


def training_set(
    texts: DataFrame,
    ids: DataFrame,
    text_col: str = "generated_text",
    id_col: str = "id",
    length: int = 1024,
    eval_share: float = 0.1,
    seed=42,
) -> DataFrame:
    """Generated texts to padded token ids with labels and a train/eval mark.

    ``ids`` is the ``(token, token_id, cf)`` dictionary; ids are moved up by 1 so that 0 pads.
    """
    kept = texts.select(id_col, T.strip(text_col).alias("text"))
    moved = ids.withColumn("token_id", F.col("token_id") + 1)
    coded = encode(kept, T.space_tokens("text"), moved, id_col)
    shaped = padded_ids(coded, length, 0, id_col)
    marked = split(shaped, eval_share, seed=seed, id_col=id_col)
    return marked.withColumn("split", F.when(F.col("split") == "test", "eval").otherwise("train"))

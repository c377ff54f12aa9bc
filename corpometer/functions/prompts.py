"""Prompt and chat text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpometer.functions.keys import pick
from corpometer.functions.words import DOUBLE_WEIGHT_TOPICS, NEWS_TOPICS


def topic_list(weighted: bool = False) -> tuple[str, ...]:
    """The news topics; with ``weighted`` some come twice and so are picked twice as often."""
    return NEWS_TOPICS + DOUBLE_WEIGHT_TOPICS if weighted else NEWS_TOPICS


def pick_topic(seed, *cols, topics: Sequence[str] | None = None) -> Column:
    """A topic for each row, the same on every run."""
    return pick(topics if topics is not None else topic_list(), seed, *cols)


def prompt_text(template: str, topic) -> Column:
    """``template`` with its ``{topic}`` places filled from a column."""
    body = topic if isinstance(topic, Column) else F.col(topic)
    return F.replace(F.lit(template), F.lit("{topic}"), body)


def user_message(prompt, typed_parts: bool = False) -> Column:
    """One-message chat as ``array<struct<role, content>>``.

    With ``typed_parts`` the content is itself a list of ``{type, text}`` parts.
    """
    body = prompt if isinstance(prompt, Column) else F.col(prompt)
    content = (
        F.array(F.struct(F.lit("text").alias("type"), body.alias("text"))) if typed_parts else body
    )
    return F.array(F.struct(F.lit("user").alias("role"), content.alias("content")))


def chat_text(
    messages,
    opening: str = "<|{role}|>\n",
    closing: str = "<|end|>\n",
    generation_prompt: str | None = "<|assistant|>\n",
) -> Column:
    """Flat chat text of ``array<struct<role, content>>`` with a marker around every message."""
    body = messages if isinstance(messages, Column) else F.col(messages)
    parts = F.transform(
        body,
        lambda m: F.concat(
            F.replace(F.lit(opening), F.lit("{role}"), m["role"]), m["content"], F.lit(closing)
        ),
    )
    flat = F.array_join(parts, "")
    return F.concat(flat, F.lit(generation_prompt)) if generation_prompt else flat

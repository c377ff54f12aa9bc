"""Explicit schemas of the tables that are read and written."""

from __future__ import annotations

REAL_ARTICLES = "article string"
GENERATED_ARTICLES = (
    "uuid string, topic string, generated_article string, elapsed_time double, model string"
)
GENERATION_INPUTS = "id bigint, person string, prefix string, max_new_tokens int"
GENERATION_OUTPUTS = "id bigint, generated_text string"
TRAINING_TEXTS = "cleaner_article string"
METRICS = "corpus string, metric string, value double, detail string"

# Names other tables use for the canonical columns.
CANONICAL_NAMES = {
    "uniqueID": "uuid",
    "article": "generated_article",
    "generated_text": "generated_article",
}

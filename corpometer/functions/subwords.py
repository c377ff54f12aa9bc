"""Subword tokens by a given vocabulary, for statistics of the tokens that a language model reads."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from tokenizers import Tokenizer

BATCH_CHARS = 1_000_000


def subword_tokens(path: str) -> Callable[[Column], Column]:
    """A tokeniser by the vocabulary file of the tokenizers library at ``path``: texts to arrays of subwords.

    The file, a few MB by its nature, is read on the driver and travels with the tasks. Texts are whole, and no
    marks are added to them; marks that are spelled out in a text are ordinary text. Null gives null.
    """
    source = Path(path).read_text(encoding="utf-8")
    loaded: list[Tokenizer] = []

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        if not loaded:
            loaded.append(Tokenizer.from_str(source))
            loaded[0].encode_special_tokens = True
        kind = pa.list_(pa.string())
        found, held, size = [], [], 0
        for i in range(len(texts)):
            held.append(texts[i].as_py())
            size += len(held[-1] or "")
            if size > BATCH_CHARS or i == len(texts) - 1:
                # Only the tokens of this many characters are objects at a time; the others are in Arrow's own form.
                coded = iter(loaded[0].encode_batch([t for t in held if t is not None], add_special_tokens=False))
                found.append(pa.array([None if t is None else next(coded).tokens for t in held], kind))
                held, size = [], 0
        return pa.concat_arrays(found) if found else pa.array([], kind)

    return cut

"""Hooks for a user's own batch functions, run on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

Scorer = Callable[[list[str]], tuple[Sequence[float], Sequence[int]]]


def batched_map(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, columns: Sequence[str]
) -> DataFrame:
    """Replace the columns: ``fn`` turns each batch of the named columns into one of ``schema``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield fn(frame)

    return df.select(*columns).mapInPandas(run, schema)


def score_batches(
    df: DataFrame,
    make_scorer: Callable[[], Scorer],
    batch_size: int = 32,
    text_col: str = "text",
    id_col: str = "doc_id",
    corpus_col: str = "corpus",
) -> DataFrame:
    """``(corpus, id, nll, n_tokens, error)`` from a scorer of lists of texts.

    ``make_scorer`` is called once per task, so it is the place to load a model. Null and empty
    texts are left out of the call and get zeros. A batch that fails gets zeros and the error's
    text, and the run goes on.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = None
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start : start + batch_size]
                out = part[[corpus_col, id_col]].assign(nll=0.0, n_tokens=0, error=None)
                valid = part[text_col].map(lambda t: isinstance(t, str) and t != "").to_numpy()
                if valid.any():
                    try:
                        scorer = scorer or make_scorer()
                        nll, tokens = scorer(part[text_col].to_numpy()[valid].tolist())
                        out.loc[valid, "nll"] = [float(x) for x in nll]
                        out.loc[valid, "n_tokens"] = [int(x) for x in tokens]
                    except Exception as problem:  # noqa: BLE001 - stored with the rows
                        out = part[[corpus_col, id_col]].assign(
                            nll=0.0, n_tokens=0, error=f"{type(problem).__name__}: {problem}"
                        )
                yield out

    kinds = {c: df.schema[c].dataType.simpleString() for c in (corpus_col, id_col)}
    schema = f"{corpus_col} {kinds[corpus_col]}, {id_col} {kinds[id_col]}, nll double, n_tokens bigint, error string"
    return df.select(corpus_col, id_col, text_col).mapInPandas(run, schema)

"""Model calls over many rows, with failures kept apart."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.session import ship_package

#: Takes a list of prompts and returns as many answers, or raises.
Model = Callable[[list[str]], list[str]]

BATCH_ROWS = 32
RETRIES = 2


def _called(model: Model, prompts: list[str]) -> list[str]:
    answers = list(model(prompts))
    if len(answers) != len(prompts):
        raise ValueError(f"{len(answers)} answers to {len(prompts)} prompts")
    return answers


def _one(model: Model, prompt: str, retries: int) -> tuple[str | None, int, str | None]:
    problem = ""
    for attempt in range(1, retries + 2):
        try:
            answer = _called(model, [prompt])[0]
            if answer is not None:
                return answer, attempt, None
            problem = "no answer"
        except Exception as error:  # whatever a model raises concerns its own row only
            problem = f"{type(error).__name__}: {error}"
    return None, retries + 1, problem


def infer(df: DataFrame, model: Model, prompt: str = "prompt", batch_rows: int = BATCH_ROWS, retries: int = RETRIES) -> DataFrame:
    """Add ``response``, ``attempts`` and ``error`` to every row.

    ``model`` is called with up to ``batch_rows`` prompts.  If that fails, each of
    them is tried alone, at most ``retries`` times more, so that one bad row costs
    its neighbours one call and nothing else.  A row without an answer has a null
    response and the last error; null prompts are not asked.  No shuffle; the
    columns of ``df`` pass through."""
    ship_package(df.sparkSession)
    kept = [c for c in df.columns if c not in ("response", "attempts", "error")]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)

    def asked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch_rows):
                part = frame.iloc[start : start + batch_rows].copy()
                prompts = part[prompt].tolist()
                known = [i for i, p in enumerate(prompts) if isinstance(p, str)]
                results: list[tuple] = [(None, 0, "no prompt")] * len(prompts)
                try:
                    for i, answer in zip(known, _called(model, [prompts[i] for i in known]) if known else []):
                        results[i] = (answer, 1, None) if answer is not None else _one(model, prompts[i], retries)
                except Exception:
                    for i in known:
                        results[i] = _one(model, prompts[i], retries)
                part["response"], part["attempts"], part["error"] = (list(column) for column in zip(*results))
                yield part

    return df.select(*kept).mapInPandas(asked, f"{schema}, response string, attempts int, error string")


def split_answers(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answered rows, and the dead letters with their error and attempts.  Write
    the calls before splitting them: each side reads its input again."""
    return asked.where("error IS NULL").drop("attempts", "error"), asked.where("error IS NOT NULL").drop("response")

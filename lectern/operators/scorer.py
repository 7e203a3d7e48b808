"""Running a caller's batch function over rows: batching, retry and error routing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Scorer = Callable[[list], list]


def score_rows(
    df: DataFrame, make: Callable[[], Scorer], value: str, output: str = "text", batch_size: int = 8,
    on_error: str = "blank", describe: Callable[[Exception], str] = str,
) -> DataFrame:
    """Add ``output`` (string) and ``error`` by calling a scorer on batches of ``value``.

    ``make`` builds the scorer once per task. A batch that raises or returns the wrong number of
    results is retried one row at a time; a row that still fails gets ``""`` (``on_error`` is
    ``blank``) or its own input (``input``), and its error message. Row order inside a partition
    is kept. Rows stream through: no partition is held in memory.
    """
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {t}" for c, t in types.items()) + f", `{output}` string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for pdf in batches:
            results: list[tuple] = []
            items = list(pdf[value])
            for lo in range(0, len(items), batch_size):
                results.extend(_score(scorer, items[lo : lo + batch_size], on_error, describe))
            yield pdf.assign(**{output: [r[0] for r in results], "error": [r[1] for r in results]})

    return df.mapInPandas(run, schema)


def _score(scorer: Scorer, group: list, on_error: str, describe) -> list[tuple]:
    try:
        out = scorer(group)
        if len(out) != len(group):
            raise ValueError(f"{len(out)} results for {len(group)} rows")
        return [(t, None) for t in out]
    except Exception:
        rows = []
        for item in group:
            try:
                rows.append((scorer([item])[0], None))
            except Exception as e:
                rows.append((item if on_error == "input" else "", describe(e)))
        return rows


def recognise(df: DataFrame, make, path: str = "path", batch_size: int = 8) -> DataFrame:
    """Recogniser hook: a row that fails alone yields an empty text."""
    return score_rows(df, make, path, "text", batch_size)


def punctuate(df: DataFrame, make, text: str = "text", batch_size: int = 32) -> DataFrame:
    """Punctuator hook: on any failure the text stays as it was."""
    return score_rows(df, make, text, "punctuated", batch_size, on_error="input")


def answer(prompts: DataFrame, make, prompt: str = "prompt") -> DataFrame:
    """Answerer hook: never raises; failures carry their message for ``classify_error``."""
    return score_rows(prompts, make, prompt, "answer", 1)

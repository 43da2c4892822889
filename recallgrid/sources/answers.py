"""Readers that answer prompts: any function of a list of texts, run by batches on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from recallgrid.operators.rank import inject

#: A list of prompts to a list of answers.
Reader = Callable[[list[str]], list[str]]


def no_reader(prompts: list[str]) -> list[str]:
    """Answers nothing, so that a run measures retrieval alone."""
    return [""] * len(prompts)


def answered(prompts: DataFrame, reader: Reader = no_reader, together: int = 64) -> DataFrame:
    """(query_id, answer) of (query_id, prompt); the reader gets at most ``together`` prompts at a time."""
    kind = prompts.schema["query_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for k in range(0, len(p), together):
                some = p.iloc[k : k + together]
                answers = reader(some["prompt"].tolist())
                if len(answers) != len(some):
                    raise ValueError("a reader must give one answer a prompt")
                yield pd.DataFrame({"query_id": some["query_id"], "answer": answers})

    return prompts.select("query_id", "prompt").mapInPandas(run, f"query_id {kind}, answer string")


def augmented_answers(queries: DataFrame, results: DataFrame, reader: Reader = no_reader, budget: int = 24_000) -> DataFrame:
    """(query_id, answer): prompts with the retrieved memories put in, then read."""
    return answered(inject(queries, results, budget), reader)

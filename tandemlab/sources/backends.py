"""Generation and scoring backends as Arrow-batched stages; only mocks are built here, others implement the same call."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Generate = Callable[[list[str], list[int]], list[str]]


def mock_generate(prompts: list[str], seeds: list[int]) -> list[str]:
    """Answers every confidence prompt with 0.9 and every other with a letter fixed by the seed."""
    return ['{"confidence": 0.9}' if "confidence" in p else '{"answer": "' + "ABCD"[s % 4] + '"}' for p, s in zip(prompts, seeds, strict=True)]


def generate(requests: DataFrame, backend: Generate = mock_generate) -> DataFrame:
    """(request_id, prompt, seed) -> (request_id, text): the backend is called once per Arrow batch of each partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"request_id": pdf["request_id"], "text": backend(pdf["prompt"].tolist(), pdf["seed"].fillna(0).astype(int).tolist())})

    return requests.select("request_id", "prompt", "seed").mapInPandas(run, "request_id string, text string")


def generate_missing(requests: DataFrame, stored: DataFrame, backend: Generate = mock_generate) -> DataFrame:
    """Only requests without a stored response are generated; stored ones are kept as they are."""
    todo = requests.join(stored.select("request_id"), "request_id", "left_anti")
    return stored.select("request_id", "text").unionByName(generate(todo, backend))


def score_once(answers: DataFrame, scorer: Callable[[list[str]], list[float]]) -> DataFrame:
    """(record_id, text) -> (record_id, score): every distinct text is scored once and fanned out again."""
    hashed = answers.filter(F.col("text").isNotNull()).withColumn("h", F.sha2("text", 256))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"h": pdf["h"], "score": scorer(pdf["text"].tolist())})

    scores = hashed.dropDuplicates(["h"]).select("h", "text").mapInPandas(run, "h string, score double")
    return hashed.join(scores, "h").select("record_id", "score")

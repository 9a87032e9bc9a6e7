"""Short stand-ins for long bodies, by a function that the caller brings (off by default)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gemello.functions.strings import worth_keeping

LEAST_LINES, TRIES = 20, 3


def candidates(folds: DataFrame, least: int = LEAST_LINES) -> DataFrame:
    """Right-side folds (file, id, side, tags, one_sided, start, end, text) worth a summary: new functions that are long, and new tests."""
    long = F.array_contains("tags", "function") & (F.col("end") - F.col("start") >= least)
    return folds.filter((F.col("side") == "rhs") & F.col("one_sided") & (long | F.array_contains("tags", "test")))


def summarized(folds: DataFrame, summarizer: Callable[[str], str], tries: int = TRIES) -> DataFrame:
    """(file, id, label): summaries that are at most two thirds of their text; a text whose summary fails so many times has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            labels = []
            for text in b["text"]:
                label = None
                for _ in range(tries):
                    try:
                        label = summarizer(text)
                        break
                    except OSError:  # a network that may recover
                        continue
                labels.append(label)
            yield b.assign(label=labels)[["file", "id", "text", "label"]]

    out = candidates(folds).select("file", "id", "text").mapInPandas(run, "file string, id long, text string, label string")
    return out.filter(F.col("label").isNotNull() & worth_keeping(F.col("label"), F.col("text"))).select("file", "id", "label")

"""Corpus-wide counts of words as they are written."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archipel.session import spread

MARK = re.compile(r"OCR Line \d+ \[[^\]\n]*\]: ?")


def token_counts(texts: DataFrame, column: str = "raw_text", pattern: str | None = None) -> DataFrame:
    """(token, n, m): how often each blank-delimited token occurs in all texts, and how often its small form is what
    ``pattern`` captures (0 without one). A batch is counted whole before anything is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = re.compile(pattern) if pattern else None
        for batch in batches:
            tokens: Counter = Counter()
            marked: Counter = Counter()
            for text in batch[column]:
                if text:
                    if "OCR Line" in text:
                        text = MARK.sub(" ", text)
                    tokens.update(text.split())
                    if finder:
                        marked.update(finder.findall(text))
            rows = [(t, n, 0) for t, n in tokens.items()] + [(w.lower(), 0, m) for w, m in marked.items()]
            yield pd.DataFrame(rows, columns=["token", "n", "m"])

    counted = spread(texts.select(column)).mapInPandas(run, "token string, n bigint, m bigint")
    return counted.groupBy("token").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))

"""Problem 6: splitting oversized items at natural boundaries.

Every word of a text is a possible start of a piece. Its legal successor is found for all words at once: the piece
ends at the farthest natural boundary (line break or sentence end) within the limit, or at the limit itself where
there is none; the next piece starts at the earliest boundary whose overlap with the end is allowed and from which a
later end can be reached. Squaring the successor table then gives every start of the greedy chain in
ceil(log2(pieces)) vectorised steps for all texts of an Arrow batch together, instead of a walk along each text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archipel.session import spread

LIMIT_WORDS, OVERLAP_WORDS = 350, 60
WORD = re.compile(r"\S+")
SENTENCE_END = re.compile(r"[.!?…。！？]+[\"'’”»)\]]*$")


def successors(natural: np.ndarray, size: int, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a text of ``size`` words with natural cuts before the word positions ``natural`` (ascending, ``size`` last):
    for each start its end, the next start (``size`` when the text is used up) and whether the end is a hard cut."""
    start = np.arange(size)
    at = np.searchsorted(natural, start + limit, "right") - 1
    soft = np.where(at >= 0, natural[np.maximum(at, 0)], -1)
    hard = soft <= start
    end = np.where(hard, np.minimum(start + limit, size), soft)
    end = np.where(start + limit >= size, size, end)
    hard &= end < size
    following = natural[np.minimum(np.searchsorted(natural, end, "right"), len(natural) - 1)]
    least = np.maximum(np.maximum(end - overlap, start + 1), np.where(hard, 0, following - limit))
    first = natural[np.minimum(np.searchsorted(natural, least, "left"), len(natural) - 1)]
    nxt = np.where(hard, np.maximum(end - overlap, start + 1), np.minimum(end, first))
    return end, np.where(end >= size, size, nxt), hard


def chain(jump: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """All positions reached from ``roots`` by repeated ``jump`` (ends jump to themselves): pointer doubling."""
    seen = np.zeros(len(jump), bool)
    seen[roots] = True
    while True:
        grown = seen.copy()
        grown[jump[seen]] = True
        if (grown == seen).all():
            return seen
        seen, jump = grown, jump[jump]


def cut_batch(texts: list[str], limit: int, overlap: int) -> list[tuple[int, int, int, int, int, bool]]:
    """(text, first word, end word, first char, end char, hard) of every piece, texts in order, pieces in order."""
    found = []
    jumps, ends, hards, roots, spans, owner = [], [], [], [], [], []
    base = 0
    for i, text in enumerate(texts):
        words = [m.span() for m in WORD.finditer(text)]
        n = len(words)
        if not n:
            continue
        natural = [k for k in range(1, n) if "\n" in text[words[k - 1][1] : words[k][0]] or SENTENCE_END.search(text, *words[k - 1])]
        end, nxt, hard = successors(np.array([*natural, n]), n, limit, overlap)
        jumps.append(np.append(nxt, n) + base)
        ends.append(np.append(end, n))
        hards.append(np.append(hard, False))
        roots.append(base)
        spans.append(words)
        owner.append((i, base, n))
        base += n + 1
    if not owner:
        return found
    seen = chain(np.concatenate(jumps), np.array(roots))
    for (i, at, n), words, end, hard in zip(owner, spans, ends, hards):
        for s in np.flatnonzero(seen[at : at + n]):
            e = int(end[s])
            found.append((i, int(s), e, words[s][0], words[e - 1][1], bool(hard[s])))
    return found


def split_items(df: DataFrame, keys: list[str], text: str = "raw_text", limit: int = LIMIT_WORDS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """One row per piece: ``keys``, chunk_index from 0, start_word, end_word, start_char, end_char, n_words,
    overlap_words with the piece before, hard_cut, piece_text.

    A text within the limit is one piece. A text without words, null or blank, has none. Rows repeated in full give
    their pieces once; other columns of ``df`` are not read.
    """
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("limit must be positive and the overlap smaller than it")
    rows = spread(df.select(*keys, F.col(text).alias("__text")).where(F.col("__text").isNotNull()), *keys).distinct()
    types = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", chunk_index int, start_word int, end_word int, start_char int, end_char int, n_words int, overlap_words int, hard_cut boolean, piece_text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["__text"].tolist()
            pieces = pd.DataFrame(cut_batch(texts, limit, overlap), columns=["i", "start_word", "end_word", "start_char", "end_char", "hard_cut"])
            at = pieces["i"].to_numpy(int)
            out = pd.DataFrame({k: pd.Series(batch[k].to_numpy(object)[at], dtype=object) for k in keys})
            out["chunk_index"] = pieces.groupby("i").cumcount()
            for c in ("start_word", "end_word", "start_char", "end_char"):
                out[c] = pieces[c]
            out["n_words"] = pieces["end_word"] - pieces["start_word"]
            before = pieces.groupby("i")["end_word"].shift()
            out["overlap_words"] = (before - pieces["start_word"]).fillna(0).astype(int)
            out["hard_cut"] = pieces["hard_cut"].astype(bool)
            out["piece_text"] = pd.Series([texts[i][a:b] for i, a, b in zip(at, pieces["start_char"], pieces["end_char"])], dtype=object)
            yield out

    return rows.mapInPandas(run, schema)


def oversized(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Items that had to be cut, and whether one of their cuts is hard."""
    cut = F.when(F.max("hard_cut"), "hard").otherwise("boundary").alias("cut")
    return pieces.groupBy(*keys).agg(F.max("chunk_index").alias("last"), cut).where("last > 0").select(*keys, "cut")

"""Chunking of documents by words, structure and tokens."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archipel.functions.text import embedding_text, normalize_text, stable_id, unmasked
from archipel.session import spread

SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z][a-z])")
# How timed captions and lines of a page layout begin, and the most words a speaker's name has.
CAPTION = re.compile(r"^(segment\s+\d+\s+)?\[\d+(?:\.\d+)?s?-\d+(?:\.\d+)?s?\]\s*:", re.I)
LAYOUT = re.compile(r"^(ocr\s+)?(line|block|region)\s+\d+(\s+\[[^\]]+\])?\s*:", re.I)
SPEAKER_WORDS = 8


def word_windows(words: Column, size: int = 350, overlap: int = 60) -> Column:
    """Sliding windows over an array of words as (start, words); the last window is the first that reaches the end."""
    step = max(size - overlap, 1)
    n = F.size(words)
    count = F.greatest(F.lit(1), F.ceil((n - overlap) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((i * step).alias("start"), F.slice(words, i * step + 1, size).alias("words")))


def windows(text: str, size: int, overlap: int) -> list[str]:
    words = text.split()
    step, out = max(size - overlap, 1), []
    for start in range(0, len(words), step):
        out.append(" ".join(words[start : start + size]))
        if start + size >= len(words):
            break
    return out


def pack(segments: list[str], size: int, overlap: int, separator: str) -> list[str]:
    """Whole segments up to ``size`` words; the next piece repeats trailing segments of at least ``overlap`` words."""
    lengths = [len(s.split()) for s in segments]
    out, start = [], 0
    while start < len(segments):
        if lengths[start] > size:
            out += windows(segments[start], size, overlap)
            start += 1
            continue
        end, total = start, 0
        while end < len(segments) and (end == start or total + lengths[end] <= size) and total < size:
            total += lengths[end]
            end += 1
        out.append(separator.join(segments[start:end]))
        if end >= len(segments):
            break
        back, shared = end, 0
        while back > start and shared < overlap:
            back -= 1
            shared += lengths[back]
        start = back if back > start else end
    return out


def is_turn(line: str) -> bool:
    """A speaker of at most ``SPEAKER_WORDS`` words with a letter or digit, a colon, and something said."""
    speaker, _, said = line.partition(":")
    return bool(said.strip()) and len(speaker.split()) <= SPEAKER_WORDS and bool(re.search(r"[A-Za-z0-9]", speaker))


def structured(text: str, size: int, overlap: int) -> list[str]:
    """Pieces of normalised text: by captions, layout lines, turns, paragraphs or sentences, else plain windows."""
    if not text:
        return []
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    for test, separator in ((CAPTION.match, "\n"), (LAYOUT.match, "\n"), (is_turn, "\n")):
        if len(lines) >= 2 and sum(bool(test(x)) for x in lines) >= 0.5 * len(lines):
            return pack(lines, size, overlap, separator)
    paragraphs = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
    if len(paragraphs) < 2:
        sentences = [s.strip() for s in SENTENCE.split(text) if s.strip()]
        paragraphs, held = [], []
        if len(sentences) >= 4:
            for s in sentences:
                if held and sum(len(x.split()) for x in held) + len(s.split()) > 120:
                    paragraphs.append(" ".join(held))
                    held = []
                held.append(s)
            paragraphs.append(" ".join(held))
    return pack(paragraphs, size, overlap, "\n\n") if len(paragraphs) > 1 else windows(text, size, overlap)


def chunk_documents(documents: DataFrame, size: int = 350, overlap: int = 60, mask: Callable[[Column], Column] = unmasked, page_size: int = 250, page_overlap: int = 40) -> DataFrame:
    """Chunk rows of archive documents: ids, index, raw, masked and embedding text. Scanned pages get smaller chunks.

    Repeated documents are chunked once; of several versions under one id the largest text counts. A blank text has no
    chunks. ``mask`` turns raw into masked text; what is embedded is masked.
    """
    if min(size, page_size) < 1 or min(overlap, page_overlap) < 0:
        raise ValueError("sizes must be positive and overlaps not negative")

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, pages in batches:
            yield pd.Series([structured(t or "", page_size, page_overlap) if p else structured(t or "", size, overlap) for t, p in zip(texts, pages)])

    cut = F.pandas_udf(run, "array<string>")
    keep = ["source_id", "dataset", "modality", "title", "summary"]
    given = F.struct(normalize_text(F.col("raw_text")).alias("text"), *keep, F.array_sort(F.map_entries("source_metadata")).alias("metadata"))
    rows = spread(documents.where("document_id is not null").select("document_id", given.alias("d")), "document_id").groupBy("document_id").agg(F.max("d").alias("d")).select("document_id", "d.*")
    page = F.coalesce(F.lower("modality").rlike("ocr"), F.lit(False))
    pieces = rows.select("document_id", *keep, F.map_from_entries("metadata").alias("source_metadata"), F.posexplode(cut("text", page)).alias("chunk_index", "raw_text"))
    cid = stable_id(F.col("document_id"), F.col("chunk_index"), F.substring("raw_text", 1, 200))
    masked = pieces.withColumn("masked_text", mask(F.col("raw_text")))
    return masked.select(cid.alias("chunk_id"), "document_id", *keep, "chunk_index", "raw_text", "masked_text", embedding_text(F.col("dataset"), F.col("modality"), F.col("title"), F.col("summary"), F.col("masked_text"), F.col("source_metadata")).alias("embedding_text"), "source_metadata")


def token_windows(offsets: Column, size: int = 320, overlap: int = 80) -> Column:
    """Windows over (token, start, end) structs as (first_token, start_char, end_char, n_tokens)."""
    if size <= overlap:
        raise ValueError("size must exceed overlap")
    step = size - overlap
    n = F.size(offsets)
    count = F.greatest(F.lit(1), F.ceil((n - overlap) / step)).cast("int")

    def one(i):
        part = F.slice(offsets, i * step + 1, size)
        return F.struct((i * step).alias("first_token"), F.element_at(part, 1)["start"].alias("start_char"), F.element_at(part, -1)["end"].alias("end_char"), F.size(part).alias("n_tokens"))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), one)).otherwise(F.array())


def rebased_windows(offsets: Column, size: int = 350, overlap: int = 60) -> Column:
    """Word windows that keep offsets, as (window, start_token, end_token, char_start, char_end, tokens, offsets): the
    offsets of a window's tokens count from its first character. The overlap is at most one less than the size."""
    size = max(1, size)
    step = size - max(0, min(overlap, size - 1))
    n = F.size(offsets)
    count = F.greatest(F.lit(1), F.ceil((n - (size - step)) / step)).cast("int")

    def one(i):
        part = F.slice(offsets, i * step + 1, size)
        first = F.element_at(part, 1)["start"]
        inner = F.transform(part, lambda o: F.struct((o["start"] - first).alias("start"), (o["end"] - first).alias("end")))
        return F.struct(i.alias("window"), (i * step).alias("start_token"), (i * step + F.size(part)).alias("end_token"), first.alias("char_start"), F.element_at(part, -1)["end"].alias("char_end"), F.transform(part, lambda o: o["token"]).alias("tokens"), inner.alias("offsets"))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), one)).otherwise(F.array())

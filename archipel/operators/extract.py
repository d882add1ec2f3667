"""Pluggable models as table functions, with deterministic built-ins.

A protocol is a plain callable on pandas batches, so any model can stand in: an embedder takes texts and returns vectors,
a span extractor returns (start, end, label, score) spans, a linker a name for a span, a judge a score and a label.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archipel.functions.text import uuid5

RULES = (("EMAIL", re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")), ("PHONE", re.compile(r"\+?\d[\d ().-]{7,}\d")), ("NAME", re.compile(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\b")))


def hashed_vectors(texts: pd.Series, dim: int = 64) -> list[np.ndarray]:
    """Unit vectors of hashed words."""
    out = []
    for t in texts:
        v = np.zeros(dim, np.float32)
        for w in re.findall(r"\w+", (t or "").lower()):
            h = zlib.crc32(w.encode())
            v[h % dim] += 1 if h >> 16 & 1 else -1
        n = np.linalg.norm(v)
        out.append(v / n if n else v)
    return out


def rule_spans(texts: pd.Series) -> list[list[dict]]:
    return [[{"start": m.start(), "end": m.end(), "label": label, "score": 1.0} for label, rule in RULES for m in rule.finditer(t or "")] for t in texts]


def overlap_judge(frame: pd.DataFrame) -> list[int]:
    """0 to 3 by the share of the expected words that the text has."""
    out = []
    for expected, text in zip(frame["expected"], frame["text"]):
        want, have = set(re.findall(r"\w+", (expected or "").lower())), set(re.findall(r"\w+", (text or "").lower()))
        share = len(want & have) / len(want) if want else 0.0
        out.append(3 if share >= 0.9 else 2 if share >= 0.6 else 1 if share >= 0.3 else 0)
    return out


def embed(rows: DataFrame, text: str, embedder: Callable = hashed_vectors) -> DataFrame:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(embedder(texts))

    return rows.withColumn("dense", F.pandas_udf(run, "array<float>")(F.col(text)))


def extract_spans(rows: DataFrame, text: str, extractor: Callable = rule_spans) -> DataFrame:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(extractor(texts))

    found = F.pandas_udf(run, "array<struct<start:int,end:int,label:string,score:double>>")
    return rows.withColumn("_s", F.explode(found(F.col(text)))).select(*rows.columns, "_s.*")


def term_weights(texts: pd.Series) -> list[list[dict]]:
    """Sparse vectors: hashed words with the square root of their frequency, of unit length, in order of terms."""
    out = []
    for t in texts:
        n: dict[int, int] = {}
        for w in re.findall(r"\w+", (t or "").lower()):
            h = zlib.crc32(w.encode()) & 0x7FFFFFFF
            n[h] = n.get(h, 0) + 1
        norm = sum(n.values()) ** 0.5
        out.append([{"term": h, "weight": c**0.5 / norm} for h, c in sorted(n.items())])
    return out


def embed_sparse(rows: DataFrame, text: str, embedder: Callable = term_weights) -> DataFrame:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(embedder(texts))

    return rows.withColumn("sparse", F.pandas_udf(run, "array<struct<term:int,weight:double>>")(F.col(text)))


def embedded_new(rows: DataFrame, have: DataFrame, text: str = "embedding_text", embedder: Callable = hashed_vectors, sparse: Callable = term_weights) -> DataFrame:
    """(chunk_id, point_id, dense, sparse_indices, sparse_values) of the chunks that ``have`` no vector yet, ready to be
    appended; repeated chunks are embedded once."""
    fresh = rows.where("chunk_id is not null").groupBy("chunk_id").agg(F.min(text).alias("_text")).join(have.select("chunk_id").distinct(), "chunk_id", "left_anti")
    made = embed_sparse(embed(fresh, "_text", embedder), "_text", sparse)
    return made.select("chunk_id", uuid5(F.concat(F.lit("archive-chunk:"), F.col("chunk_id"))).alias("point_id"), "dense", F.transform("sparse", lambda x: x["term"]).alias("sparse_indices"), F.transform("sparse", lambda x: x["weight"].cast("float")).alias("sparse_values"))


def link(spans: DataFrame, surface: str, dictionary: DataFrame) -> DataFrame:
    """Dictionary linking on the normalised surface: (surface, entity_id); what is not found stays without an entity."""
    return spans.join(dictionary.groupBy("surface").agg(F.min("entity_id").alias("entity_id")), spans[surface] == dictionary["surface"], "left").drop(dictionary["surface"])


def matched_back(mentions: DataFrame, linked: DataFrame, keys: tuple = ("chunk_id", "start_char", "end_char")) -> DataFrame:
    """``mentions`` with what a linker said of the span at the same place (external_id, link_score); a mention the linker did
    not return keeps none."""
    said = linked.groupBy(*keys).agg(F.max_by(F.struct("external_id", "link_score"), F.struct(F.coalesce("link_score", F.lit(-1.0)), "external_id")).alias("l"))
    return mentions.join(said, list(keys), "left").withColumn("external_id", F.col("l.external_id")).withColumn("link_score", F.col("l.link_score")).drop("l")


def judge(rows: DataFrame, expected: str, text: str, judge_: Callable = overlap_judge) -> DataFrame:
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for e, t in batches:
            yield pd.Series(judge_(pd.DataFrame({"expected": e, "text": t})), dtype="int64")

    return rows.withColumn("relevance_score", F.pandas_udf(run, "bigint")(F.col(expected), F.col(text)))


LABELS = ["irrelevant", "related", "highly_relevant", "perfectly_relevant"]  # fixed values, by score


def judgment(rows: DataFrame, expected: str, text: str, judge_: Callable = overlap_judge) -> DataFrame:
    """``rows`` with a judge's whole answer: score, its label, and whether the expected information is there."""
    score = F.col("relevance_score")
    known = F.when(score.between(0, 3), score)
    answer = F.struct(known.alias("relevance_score"), F.try_element_at(F.lit(LABELS), (known + 1).cast("int")).alias("relevance_label"), (known >= 2).alias("contains_expected_information"))
    return judge(rows, expected, text, judge_).withColumn("judgment", answer).drop("relevance_score")


def lead_query(texts: pd.Series) -> list[dict]:
    """Built-in query generator: asks about the first sentence of a text, which is then what is expected."""
    out = []
    for t in texts:
        first = re.split(r"(?<=[.!?])\s", (t or "").strip(), maxsplit=1)[0]
        words = first.split()
        out.append({"query": f"What is known about {' '.join(words[:8]).rstrip('.,;:!?')}?", "expected": first, "answer": first, "query_type": "factual", "difficulty": "easy" if len(words) < 20 else "medium", "rejected": len(words) < 5})
    return out


def cooccurrence_relations(pairs: DataFrame, label: str = "affiliated with", reach: int = 200) -> DataFrame:
    """Built-in relation model: a pair's score falls with its distance."""
    return pairs.withColumn("label", F.lit(label)).withColumn("score", F.round(F.greatest(F.lit(0.0), 1 - F.col("gap") / reach), 6))

"""Retrieval: dense, sparse, fused and graph-reranked."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archipel.session import slots, spread

BLOCK, PART, ROWS = 4096, 100_000, 256  # queries and vectors of a task, and rows of their product held at once


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query by score, ties to the smaller id; only k rows a query leave a partition."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 10, where: str | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank) by cosine of queries (query_id, dense) among ``vectors`` (chunk_id, dense).
    ``where`` filters vectors before scoring. Null and all-zero vectors take no part; scores have six places.

    Queries are dealt to blocks of about ``BLOCK``, vectors to parts of about ``PART``; every block meets every part in one
    task, as a cogroup, and answers with its own k best. So neither side passes through the driver.
    """
    if where:
        vectors = vectors.where(where)
    vectors = vectors.where("dense is not null").select("chunk_id", "dense")
    asked = queries.where("dense is not null").select("query_id", F.col("dense").alias("asked"))  # a name of its own: queries may be vectors
    blocks = max(1, -(-asked.count() // BLOCK))
    wide = slots(vectors.sparkSession)
    parts = max(wide, -(-vectors.count() // PART))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("part", every(parts))
    v = vectors.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int")).withColumn("block", every(blocks))

    def unit(rows: pd.DataFrame, name: str, column: str) -> tuple[np.ndarray, np.ndarray]:
        x = np.stack([np.asarray(r, np.float64) for r in rows[column]]) if len(rows) else np.zeros((0, 1))
        norm = np.linalg.norm(x, axis=1)
        return rows[name].to_numpy()[norm > 0], x[norm > 0] / norm[norm > 0, None]

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids, x = unit(left, "query_id", "asked")
        names, y = unit(right, "chunk_id", "dense")
        found = []
        if len(ids) and len(names):
            for at in range(0, len(ids), ROWS):  # a few rows of the product at a time
                s = np.round(x[at : at + ROWS] @ y.T, 6)
                # everything at least as good as the k-th best, so ties are decided later
                least = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)][:, None]
                i, j = np.nonzero(s >= least)
                found.append(pd.DataFrame({"query_id": ids[at + i], "chunk_id": names[j], "score": s[i, j]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": pd.Series(dtype=object), "chunk_id": pd.Series(dtype=object), "score": pd.Series(dtype=float)})

    by = ("block", "part")
    met = spread(q, *by).groupBy(*by).cogroup(spread(v, *by).groupBy(*by)).applyInPandas(search, "query_id string, chunk_id string, score double")
    return ranked(met, k)


def sparse_topk(queries: DataFrame, postings: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, chunk_id, score, rank) by the dot product over shared terms: an equi-join of the inverted lists.

    ``queries``: (query_id, term, weight); ``postings``: (chunk_id, term, weight). Chunks that share no term don't appear.
    """
    q = queries.select("query_id", "term", F.col("weight").alias("wq"))
    scores = postings.join(q, "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("wq") * F.col("weight")), 6).alias("score"))
    return ranked(scores, k)


def rrf(lists: DataFrame, k: int, rrf_k: int = 2) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, chunk_id, rank): sum of 1 / (rrf_k + position from 0)."""
    fused = lists.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank") - 1)), 6).alias("score"))
    return ranked(fused, k)


def sparse_vectors(embedded: DataFrame) -> DataFrame:
    """(chunk_id, term, weight) of parallel index and value arrays; repeated rows and zero weights are dropped."""
    rows = embedded.where("chunk_id is not null").groupBy("chunk_id").agg(F.max(F.struct("sparse_indices", "sparse_values")).alias("v"))
    flat = rows.select("chunk_id", F.explode(F.arrays_zip("v.sparse_indices", "v.sparse_values")).alias("t"))
    return flat.select("chunk_id", F.col("t.sparse_indices").alias("term"), F.col("t.sparse_values").cast("double").alias("weight")).where("term is not null and weight <> 0")


def graph_rerank(candidates: DataFrame, features: DataFrame, k: int, matched: float = 0.15, neighbour: float = 0.08, typed: float = 0.10) -> DataFrame:
    """Base score plus boosts for matched entities, neighbours and typed relations; ties by base score, then rank."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    score = F.round(F.col("score") + matched * zero("matched") + neighbour * zero("neighbours") + typed * zero("typed_relations"), 6)
    rows = candidates.join(features, ["query_id", "chunk_id"], "left").withColumn("new_score", score)
    w = Window.partitionBy("query_id").orderBy(F.desc("new_score"), F.desc("score"), "rank")
    return rows.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= k).select("query_id", "chunk_id", F.col("new_score").alias("score"), F.col("new_rank").alias("rank"))


def results(ranked_: DataFrame, chunks: DataFrame, method: str, preview: int = 500) -> DataFrame:
    """Ranked hits as result rows: method, document, and the text to be judged, the first of embedding text, masked text and
    summary that is there, with a preview. Of repeated chunks the first by text counts; a hit without a chunk stays."""
    says = lambda c: F.nullif(F.col(c), F.lit(""))
    text = F.coalesce(says("embedding_text"), says("masked_text"), says("summary"), F.lit(""))
    facts = F.struct("document_id", "dataset", "modality", "title", text.alias("retrieval_text"))
    c = chunks.where("chunk_id is not null").groupBy("chunk_id").agg(F.min(facts).alias("c"))
    rows = ranked_.join(c, "chunk_id", "left").select("query_id", F.lit(method).alias("retrieval_method"), "chunk_id", "rank", "score", "c.*")
    return rows.withColumn("retrieval_text", F.coalesce("retrieval_text", F.lit(""))).withColumn("preview", F.substring("retrieval_text", 1, preview))


def compact_records(results_: DataFrame) -> DataFrame:
    """(query_id, results): what a judge needs of a query's results, in the order of ranks."""
    row = F.struct("rank", "chunk_id", "retrieval_method", "score", "retrieval_text")
    return results_.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("results"))  # the k of a query


def topk_cached(cache: DataFrame, k: int, strategy: str) -> DataFrame:
    """(query_id) whose stored results of a strategy have at least ``k`` entries and need not be searched again."""
    return cache.where((F.col("strategy") == strategy) & (F.size("results") >= k)).select("query_id").distinct()

"""Resumable drivers: extraction, retrieval ablations, judging and making of qrels, each doing only what is not done."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archipel.functions.text import query_form, query_id
from archipel.operators.evaluation import judgment_key, with_qrels
from archipel.operators.qrels import reject_reasons
from archipel.sources.tables import append_new


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, none if it does not exist yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def resumed(units: DataFrame, key: list[str], work: Callable[[DataFrame], dict[str, DataFrame]], sink: str, keys: dict[str, list[str]], slices: int = 1) -> int:
    """Runs ``work`` on the units whose key is not in the log, slice by slice of a hash of the key, appending each of its
    tables below ``sink`` and then the keys to the log. A slice that broke off is done again and adds nothing twice. A
    slice holds whole keys, so work by block gets whole blocks. Returns how many keys were done."""
    spark, total = units.sparkSession, 0
    for k in range(slices):
        part = units.where(F.pmod(F.xxhash64(*key), F.lit(slices)) == k)
        log = stored(spark, f"{sink}/done")
        if log is not None:
            part = part.join(log.select(*key).distinct(), key, "left_anti")
        for name, table in work(part).items():
            append_new(table, f"{sink}/{name}", keys[name])
        total += append_new(part.select(*key).distinct(), f"{sink}/done", key)
    return total


def ablation(queries: DataFrame, strategies: dict[str, Callable[[DataFrame, int], DataFrame]], k: int, done: DataFrame | None = None) -> DataFrame:
    """(strategy, query_id, top_k, chunk_id, rank, score): every strategy's results for the queries it has none for in
    ``done`` (strategy, query_id, top_k). A strategy maps queries and k to (query_id, chunk_id, rank, score)."""
    out = None
    for name, retrieve in strategies.items():
        left = queries if done is None else queries.join(done.where((F.col("strategy") == name) & (F.col("top_k") == k)).select("query_id").distinct(), "query_id", "left_anti")
        found = retrieve(left, k).select(F.lit(name).alias("strategy"), "query_id", F.lit(k).alias("top_k"), "chunk_id", F.col("rank").cast("int").alias("rank"), "score")
        out = found if out is None else out.unionByName(found)
    return out


def scorer(judge: Callable[[pd.DataFrame], list[int]]) -> Callable:
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for e, t in batches:
            yield pd.Series(judge(pd.DataFrame({"expected": e, "text": t})), dtype="Int64")

    return F.pandas_udf(run, "bigint")


def judged(results: DataFrame, qrels: DataFrame, judges: dict[str, Callable[[pd.DataFrame], list[int]]], done: DataFrame | None = None) -> DataFrame:
    """Judgments (judgment_key, judge_model, strategy, query_id, chunk_id, rank, relevance_score, judgment_status,
    is_source_chunk) of results (strategy, query_id, chunk_id, rank, text) by every judge, but for the keys in ``done``.

    A judge maps a frame (expected, text) to scores; a score that is none of 0 to 3 makes the judgment failed. Equal pairs
    of query and chunk are judged once per judge, whatever strategies found them.
    """
    out = None
    known = with_qrels(results, qrels)
    for name, judge in judges.items():
        rows = known.withColumn("judge_model", F.lit(name)).withColumn("judgment_key", judgment_key(F.col("query_id"), F.col("chunk_id"), F.col("judge_model")))
        if done is not None:
            rows = rows.join(done.select("judgment_key").distinct(), "judgment_key", "left_anti")

        pairs = rows.groupBy("judgment_key").agg(F.min(F.struct("expected_relevant_information", "text")).alias("p"))
        scores = pairs.select("judgment_key", scorer(judge)(F.col("p.expected_relevant_information"), F.col("p.text")).alias("s"))
        scores = scores.select("judgment_key", F.when(F.col("s").between(0, 3), F.col("s")).alias("relevance_score"))
        part = rows.join(scores, "judgment_key").withColumn("judgment_status", F.when(F.col("relevance_score").isNull(), "failed").otherwise("completed"))
        part = part.select("judgment_key", "judge_model", "strategy", "query_id", "chunk_id", "rank", "relevance_score", "judgment_status", "is_source_chunk")
        out = part if out is None else out.unionByName(part)
    return out


GENERATED = "query:string,expected:string,answer:string,query_type:string,difficulty:string,rejected:boolean"


def generated_qrels(candidates: DataFrame, generator: Callable[[pd.Series], list[dict]], target: int, done: DataFrame | None = None) -> dict[str, DataFrame]:
    """Accepted and rejected qrels of candidates (chunk_id, text, candidate_rank): a generator writes a query per text, which
    is validated; of equal queries the one with the lowest rank stands; the first ``target`` are accepted. Chunks in
    ``done`` (source_chunk_id) are not asked again."""
    rows = candidates.where("chunk_id is not null").dropDuplicates(["chunk_id"])
    if done is not None:
        rows = rows.join(done.select(F.col("source_chunk_id").alias("chunk_id")).distinct(), "chunk_id", "left_anti")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(generator(texts), columns=[x.split(":")[0] for x in GENERATED.split(",")])

    made = rows.select("chunk_id", "candidate_rank", F.pandas_udf(run, f"struct<{GENERATED}>")(F.col("text")).alias("g")).select("chunk_id", "candidate_rank", "g.*")
    reasons = reject_reasons(F.col("query"), F.col("expected"), F.col("answer"), F.col("query_type"), F.col("difficulty"), F.col("rejected"))
    checked = made.withColumn("reasons", reasons).withColumn("form", query_form(F.col("query")))
    valid = checked.where(F.size("reasons") == 0)
    first = valid.groupBy("form").agg(F.min(F.struct("candidate_rank", "chunk_id")).alias("f")).select(F.col("f.chunk_id").alias("chunk_id"))
    accepted = valid.join(first, "chunk_id", "left_semi").orderBy("candidate_rank", "chunk_id").limit(target)
    again = valid.join(first, "chunk_id", "left_anti").withColumn("reasons", F.array(F.lit("duplicate_query")))
    columns = [query_id(F.col("chunk_id"), F.col("query")).alias("query_id"), "query", F.col("chunk_id").alias("source_chunk_id"), F.col("expected").alias("expected_relevant_information"), F.col("answer").alias("reference_answer"), "query_type", "difficulty", F.lit(True).alias("is_valid")]
    rejected = checked.where(F.size("reasons") > 0).unionByName(again)
    return {"accepted": accepted.select(*columns), "rejected": rejected.select(F.col("chunk_id").alias("source_chunk_id"), "query", "reasons")}

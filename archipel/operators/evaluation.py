"""Retrieval judgments: metrics at k, judge ensembles, latency, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archipel.functions.text import f1, ratio

RELEVANT = 2


# Fixed value: the order in which strategies are reported.
STRATEGIES = ["sparse", "dense", "hybrid_rrf", "graph_expanded_hybrid", "graph_expanded_hybrid_reranked"]


def judge_name(c: Column) -> Column:
    """One spelling per judge: the part after the owner, small letters, underscores and blanks as hyphens; blank is null."""
    tail = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"__|\\", "/"), "^.*/", "")
    return F.nullif(F.regexp_replace(tail, r"[_\s]+", "-"), F.lit(""))


def named_judges(judgments: DataFrame) -> DataFrame:
    return judgments.withColumn("judge_model", judge_name(F.col("judge_model"))).where("judge_model is not null")


def valid_judgments(judgments: DataFrame) -> DataFrame:
    """The last valid judgment of each (query, chunk, rank, strategy, judge): completed, score 0..3, judges under one name."""
    keys = ["query_id", "chunk_id", "rank", "evaluation_strategy", "judge_model"]
    rows = named_judges(judgments.where("judgment_status = 'completed' and relevance_score between 0 and 3"))
    w = Window.partitionBy(*keys).orderBy(F.desc("judged_at"), F.desc("record_id"))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def retrieval_metrics(judgments: DataFrame, ks: list[int] | None, by: tuple = ("evaluation_strategy",)) -> DataFrame:
    """Per group and k: nDCG, mean relevance, precision, hit rate, MRR and source-hit rate, averaged over queries. Without
    ``ks`` a group's k is its largest rank.

    The ideal ranking sorts the same scores. Needs one row per (group, query_id, rank).
    """
    by = list(by)
    rows = judgments.select(*by, "query_id", "rank", F.coalesce("relevance_score", F.lit(0)).alias("rel"), F.coalesce("is_source_chunk", F.lit(False)).alias("src"), "chunk_id")
    if ks is None:
        same = judgments.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.max("rank").cast("int").alias("k"))
        on = None
        for c in by:
            on = F.col(c).eqNullSafe(F.col(f"_{c}")) if on is None else on & F.col(c).eqNullSafe(F.col(f"_{c}"))
        rows = rows.join(same, on).drop(*(f"_{c}" for c in by))
    else:
        rows = rows.select("*", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    order = Window.partitionBy(*by, "query_id", "k")
    rows = rows.withColumn("pos", F.row_number().over(order.orderBy("rank", "chunk_id"))).where("pos <= k")
    rows = rows.withColumn("ideal", F.row_number().over(order.orderBy(F.desc("rel"), "chunk_id")))
    gain = F.pow(F.lit(2.0), F.col("rel")) - 1
    per_query = rows.groupBy(*by, "k", "query_id").agg(
        F.sum(gain / F.log2(F.col("pos") + 1.0)).alias("dcg"),
        F.sum(gain / F.log2(F.col("ideal") + 1.0)).alias("idcg"),
        (F.sum("rel") / F.col("k")).alias("mean_rel"),
        (F.count_if(F.col("rel") >= RELEVANT) / F.col("k")).alias("p"),
        F.max((F.col("rel") >= RELEVANT).cast("double")).alias("hit"),
        F.coalesce(1.0 / F.min(F.when(F.col("rel") >= RELEVANT, F.col("rank"))), F.lit(0.0)).alias("rr"),
        F.max(F.col("src").cast("double")).alias("source"),
    )
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return per_query.groupBy(*by, "k").agg(F.count("*").alias("queries"), mean(ratio(F.col("dcg"), F.col("idcg")), "ndcg"), mean("mean_rel", "mean_relevance"), mean("p", "precision"), mean("hit", "hit_rate"), mean("rr", "mrr"), mean("source", "source_hit_rate"))


def metrics_by_judge(judgments: DataFrame) -> DataFrame:
    """Metrics of every judge and strategy at the largest rank judged, with the strategy's place in the fixed order (after
    all others where it has none)."""
    place = F.coalesce(F.nullif(F.array_position(F.lit(STRATEGIES), F.col("evaluation_strategy")), F.lit(0)), F.lit(len(STRATEGIES) + 1))
    return retrieval_metrics(judgments, None, ("judge_model", "evaluation_strategy")).withColumn("strategy_order", place.cast("bigint"))


def best_k(metrics: DataFrame) -> DataFrame:
    """Per strategy the k with the best nDCG, then hit rate, then MRR, then the smallest."""
    w = Window.partitionBy("evaluation_strategy").orderBy(F.desc("ndcg"), F.desc("hit_rate"), F.desc("mrr"), "k")
    return metrics.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def with_latency(metrics: DataFrame, latencies: DataFrame, key: str = "evaluation_strategy") -> DataFrame:
    """Metrics with the latency of their strategy, null where none was measured."""
    return metrics.join(latencies, key, "left")


def with_qrels(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """Results with the expected information of their query, which no retriever has seen, and whether the chunk is the one
    the query was made from. A query without a qrel keeps its rows."""
    q = qrels.where("query_id is not null").groupBy("query_id").agg(F.min_by(F.struct("expected_relevant_information", "source_chunk_id"), F.struct("source_chunk_id", "expected_relevant_information")).alias("q")).select("query_id", "q.*")
    return results.join(q, "query_id", "left").withColumn("is_source_chunk", F.coalesce(F.col("chunk_id") == F.col("source_chunk_id"), F.lit(False)))


def judgment_key(query: Column, chunk: Column, judge: Column) -> Column:
    return F.sha1(F.concat_ws("|", query, chunk, judge))


def cached_judgments(judgments: DataFrame, include_failed: bool = False) -> DataFrame:
    """One record per key, the first as appended (``record_id``): failed ones are left out unless asked for. A record without
    a key gets the stable one of query, chunk and judge."""
    rows = judgments if include_failed else judgments.where(~F.col("judgment_status").eqNullSafe("failed"))
    key = F.coalesce(F.nullif(F.trim("judgment_key"), F.lit("")), judgment_key(F.col("query_id"), F.col("chunk_id"), F.col("judge_model")))
    w = Window.partitionBy("_key").orderBy("record_id")
    return rows.withColumn("_key", key).withColumn("_r", F.row_number().over(w)).where("_r = 1").withColumn("judgment_key", F.col("_key")).drop("_key", "_r")


def last_valid(judgments: DataFrame) -> DataFrame:
    """The record that counts per (judge, strategy, query, chunk, rank): the last with a usable score, else the last."""
    ok = F.coalesce(F.col("relevance_score").between(0, 3), F.lit(False)).cast("int")
    w = Window.partitionBy("judge_model", "evaluation_strategy", "query_id", "chunk_id", "rank").orderBy(F.desc(ok), F.desc("record_id"))
    return named_judges(judgments).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def ensemble(judgments: DataFrame, expected: int | None = None) -> DataFrame:
    """Per (query, chunk, rank, strategy): mean score, share of relevant votes, sample deviation, judges, and whether all
    ``expected`` judges (by default all there are) have judged."""
    keys = ["query_id", "chunk_id", "rank", "evaluation_strategy"]
    out = judgments.groupBy(*keys).agg(F.round(F.avg("relevance_score"), 6).alias("mean_score"), F.round(F.avg((F.col("relevance_score") >= RELEVANT).cast("double")), 6).alias("vote_rate"), F.round(F.coalesce(F.stddev_samp("relevance_score"), F.lit(0.0)), 6).alias("score_std"), F.count_distinct("judge_model").alias("n_judges"), F.array_join(F.array_sort(F.collect_set("judge_model")), ",").alias("judges"))
    n = expected if expected is not None else judgments.select("judge_model").distinct().count()
    return out.withColumn("complete", F.col("n_judges") == n)


def latency(rows: DataFrame, group: str, value: Column) -> DataFrame:
    v = value.cast("double")
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.percentile(v, F.lit(0.5)), 6).alias("median"), F.round(F.percentile(v, F.lit(0.95)), 6).alias("p95"), F.round(F.sum(v), 4).alias("total"))


def threshold_sweep(scored: DataFrame, thresholds: list[float], by: str | None = None) -> DataFrame:
    """(threshold, group, tp, fp, fn, precision, recall, f1) of rows (score, gold boolean); the group ``all`` and, with
    ``by``, each of its values, in one pass."""
    rows = scored.select("score", "gold", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"), F.explode(F.array(F.lit("all"), *( [F.coalesce(F.col(by).cast("string"), F.lit("none"))] if by else []))).alias("grp"))
    on = F.coalesce("score", F.lit(0.0)) >= F.col("threshold")
    c = rows.groupBy("threshold", "grp").agg(F.count_if(on & F.col("gold")).alias("tp"), F.count_if(on & ~F.col("gold")).alias("fp"), F.count_if(~on & F.col("gold")).alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1(p, r), 6).alias("f1"))


def best_threshold(sweep: DataFrame, floor: float = 0.0) -> DataFrame:
    """Per group the threshold with the best F1, precision, recall, then the smallest; those under the precision floor
    only if none reaches it."""
    w = Window.partitionBy("grp").orderBy((F.col("precision") >= floor).desc(), F.desc("f1"), F.desc("precision"), F.desc("recall"), "threshold")
    return sweep.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def pending(results: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return results.join(done.select(*keys).distinct(), keys, "left_anti")


def ensemble_metrics(votes: DataFrame, ks: list[int]) -> DataFrame:
    """Per strategy and k: mean over queries of the mean score, the share judged relevant by a majority, and the mean
    deviation between judges, over the first k ranks."""
    rows = votes.select("*", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).where("rank <= k")
    per = rows.groupBy("evaluation_strategy", "k", "query_id").agg(F.avg("mean_score").alias("m"), F.avg((F.col("vote_rate") >= 0.5).cast("double")).alias("v"), F.avg("score_std").alias("s"))
    return per.groupBy("evaluation_strategy", "k").agg(F.count("*").alias("queries"), F.round(F.avg("m"), 5).alias("mean_score"), F.round(F.avg("v"), 5).alias("majority_rate"), F.round(F.avg("s"), 5).alias("mean_std"))

"""Retrieval and evaluation queries, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archipel.operators import evaluation, graph, retrieval
from archipel.plans.archive import LINKED_SQL, entity_chain, linked
from archipel.session import table

ASKED = "conv(substring(md5(chunk_id), 1, 8), 16, 10) % 50 = 0"  # every id divisible by 50, of ids that are no numbers


def embedded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embedded_text").where("chunk_id is not null").groupBy("chunk_id").agg(F.max("dense").alias("dense"))


def dense_topk(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("dense"), "label", "vec_id")
    return retrieval.dense_topk(v.where("vec_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "dense"), v, 10)


def dense_topk_filtered(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("dense"), "label", "vec_id")
    return retrieval.dense_topk(v.where("vec_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "dense"), v, 5, "label in (1, 2, 3)")


def dense_list(spark, d, k):
    v = embedded(spark, d)
    return retrieval.dense_topk(v.where(ASKED).select(F.col("chunk_id").alias("query_id"), "dense"), v, k)


def sparse_list(spark, d, k, least=0.0):
    p = retrieval.sparse_vectors(table(spark, d, "embedded_text"))
    q = p.where(ASKED).where(F.abs("weight") >= least).select(F.col("chunk_id").alias("query_id"), "term", "weight")
    return retrieval.sparse_topk(q, p, k)


def sparse_topk(spark, d):
    return sparse_list(spark, d, 10)


def hybrid_rrf(spark, d):
    lists = dense_list(spark, d, 50).select("query_id", "chunk_id", "rank").union(sparse_list(spark, d, 50).select("query_id", "chunk_id", "rank"))
    return retrieval.rrf(lists, 10)


def multi_variant_rrf(spark, d):
    lists = dense_list(spark, d, 30)
    for part in (sparse_list(spark, d, 30), sparse_list(spark, d, 30, 0.2)):
        lists = lists.union(part)
    return retrieval.rrf(lists.select("query_id", "chunk_id", "rank"), 10, 60)


def features(spark, d):
    m = linked(spark, d).where("chunk_id is not null").select("chunk_id", "entity_id")
    matched = m.where(ASKED).select(F.col("chunk_id").alias("query_id"), "entity_id").distinct()
    return graph.chunk_features(m, matched, entity_chain(spark, d))


def chunk_graph_features(spark, d):
    return features(spark, d)


def graph_rerank(spark, d):
    return retrieval.graph_rerank(dense_list(spark, d, 25), features(spark, d), 5)


def judged(spark, d):
    return evaluation.valid_judgments(table(spark, d, "dense_judgments").dropDuplicates(["record_id"]))


def retrieval_metrics(spark, d):
    return evaluation.retrieval_metrics(judged(spark, d), [1, 3, 5], ("judge_model", "evaluation_strategy"))


def metrics_by_judge(spark, d):
    return evaluation.metrics_by_judge(judged(spark, d))


def best_k(spark, d):
    """The depth at which each strategy is best by the judges' mean opinion."""
    mean = judge_ensemble(spark, d).select("query_id", "chunk_id", "rank", "evaluation_strategy", F.round("mean_score").cast("bigint").alias("relevance_score"), F.lit(False).alias("is_source_chunk"))
    return evaluation.best_k(evaluation.retrieval_metrics(mean, [1, 2, 3, 5]))


def judge_ensemble(spark, d):
    return evaluation.ensemble(judged(spark, d))


def ensemble_metrics(spark, d):
    return evaluation.ensemble_metrics(judge_ensemble(spark, d), [1, 3])


def latency_summary(spark, d):
    return evaluation.latency(table(spark, d, "events"), "event_type", F.col("value"))


def scored(spark, d):
    return table(spark, d, "nil_mentions").select("mention_id", F.col("confidence").alias("score"), (F.col("extractor") == "manual_entry").alias("gold"), "mention_type").distinct()


def threshold_sweep(spark, d):
    return evaluation.threshold_sweep(scored(spark, d), [0.2, 0.4, 0.6, 0.8], "mention_type")


def best_threshold(spark, d):
    return evaluation.best_threshold(threshold_sweep(spark, d), 0.5)


def judge_pending(spark, d):
    """Retrieved (query, chunk, strategy) that a judge has not judged yet, for every judge."""
    j = evaluation.named_judges(table(spark, d, "dense_judgments"))
    keys = ["query_id", "chunk_id", "evaluation_strategy", "judge_model"]
    judges = sorted(r[0] for r in j.select("judge_model").distinct().collect())  # a handful of models
    wanted = j.select(*keys[:3]).distinct().select("*", F.explode(F.lit(judges)).alias("judge_model")) if judges else j.select(*keys).limit(0)
    return evaluation.pending(wanted, j.where("judgment_status = 'completed'"), keys)


ASKED_SQL = "('0x' || substr(md5(chunk_id), 1, 8))::ubigint % 50 = 0"
EMB = f"""emb as (select chunk_id, max(dense) as dense from embedded_text where chunk_id is not null group by 1), ev as (select chunk_id, dense::double[] as v from emb where dense is not null and list_sum(list_transform(dense, lambda x: x * x)) > 0),
    ds as (select q.chunk_id as query_id, c.chunk_id, round(list_cosine_similarity(q.v, c.v), 6) as score from ev q, ev c where ('0x' || substr(md5(q.chunk_id), 1, 8))::ubigint % 50 = 0),
    sv as (select chunk_id, unnest(v.a) as term, unnest(v.b)::double as weight from (select chunk_id, max(struct_pack(a := sparse_indices, b := sparse_values)) as v from embedded_text where chunk_id is not null group by 1)), po as (select * from sv where term is not null and weight <> 0)"""


def dense_sql(k: int) -> str:
    return f"(select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) as rank from ds qualify rank <= {k})"


def sparse_sql(k: int, least: float = 0.0) -> str:
    return f"(select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) as rank from (select q.chunk_id as query_id, p.chunk_id, round(sum(q.weight * p.weight), 6) as score from po q join po p on q.term = p.term where ('0x' || substr(md5(q.chunk_id), 1, 8))::ubigint % 50 = 0 and abs(q.weight) >= {least} group by all) qualify rank <= {k})"


def rrf_sql(lists: list[str], k: int, rrf_k: int) -> str:
    union = " union all ".join(f"select query_id, chunk_id, rank from {x}" for x in lists)
    return f"select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) as rank from (select query_id, chunk_id, round(sum(1.0::double / ({rrf_k} + rank - 1)), 6) as score from ({union}) group by all) qualify rank <= {k}"


TOPK = "with e as (select vec_id, vec_id::varchar as id, label, embedding::double[] as v from embeddings), s as (select q.id as query_id, c.id as chunk_id, round(list_cosine_similarity(q.v, c.v), 6) as score from e q, e c where q.vec_id % 50 = 0 {w}) select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s qualify rank <= {k}"
FEATURES = f"""{LINKED_SQL}, ins as (select distinct chunk_id, entity_id from linked where chunk_id is not null), mt as (select distinct chunk_id as query_id, entity_id from ins where {ASKED_SQL}), hit as (select distinct mt.query_id, ins.chunk_id, ins.entity_id from ins join mt using (entity_id)),
    ch as (select 'x' || entity_id as rid, entity_id as a, lead(entity_id) over (partition by entity_type, substr(canonical_name, 1, 1) order by canonical_name, entity_id) as b from local_entities), ed as (select rid, a, b from ch where b is not null union all select rid, b, a from ch where b is not null),
    ty as (select hit.*, ed.rid, ed.b from hit join ed on hit.entity_id = ed.a), rel as (select query_id, chunk_id, count(distinct rid) as t from ty group by all), nb as (select ty.query_id, ty.chunk_id, count(distinct ty.b) as n from ty join ins on ins.chunk_id = ty.chunk_id and ins.entity_id = ty.b group by all),
    fe as (select hit.query_id, hit.chunk_id, count(distinct hit.entity_id) as matched, coalesce(max(nb.n), 0) as neighbours, coalesce(max(rel.t), 0) as typed_relations from hit left join nb using (query_id, chunk_id) left join rel using (query_id, chunk_id) group by all)"""
JUDGE = r"nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim(judge_model)), '__|\\', '/', 'g'), '^.*/', ''), '[_\s]+', '-', 'g'), '')"
VALID = f"""o as (select distinct on (record_id) * replace ({JUDGE} as judge_model) from dense_judgments), ok as (select * from o where judge_model is not null and judgment_status = 'completed' and relevance_score between 0 and 3 qualify row_number() over (partition by query_id, chunk_id, rank, evaluation_strategy, judge_model order by judged_at desc nulls last, record_id desc) = 1)"""
METRICS = """x as (select s, j, q, rank, chunk_id, coalesce(relevance_score, 0) as rel, coalesce(is_source_chunk, false)::int as src, k from src_rows {ks}), p as (select *, row_number() over (partition by s, j, q, k order by rank nulls first, chunk_id) as pos from x qualify pos <= k), i as (select *, row_number() over (partition by s, j, q, k order by rel desc, chunk_id) as ideal from p),
    g as (select s, j, k, q, sum((2.0 ** rel - 1) / log2(pos + 1)) as dcg, sum((2.0 ** rel - 1) / log2(ideal + 1)) as idcg, sum(rel) / max(k) as mr, count(*) filter (rel >= 2) / max(k) as pr, max((rel >= 2)::int) as hit, coalesce(1.0 / min(rank) filter (rel >= 2), 0) as rr, max(src) as source from i group by all),
    mt as (select j as judge_model, s as evaluation_strategy, k, count(*) as queries, round(avg(case when idcg > 0 then dcg / idcg else 0 end), 6) as ndcg, round(avg(mr), 6) as mean_relevance, round(avg(pr), 6) as precision, round(avg(hit), 6) as hit_rate, round(avg(rr), 6) as mrr, round(avg(source), 6) as source_hit_rate from g group by all)"""
SOURCE = "src_rows as (select evaluation_strategy as s, judge_model as j, query_id as q, rank, chunk_id, relevance_score, is_source_chunk from ok)"
SWEEP = """d as (select distinct mention_id, confidence as score, extractor = 'manual_entry' as gold, mention_type from nil_mentions), r as (select score, gold, 'all' as grp from d union all select score, gold, coalesce(mention_type, 'none') from d), c as (select threshold, grp, count(*) filter (coalesce(score, 0) >= threshold and gold) as tp, count(*) filter (coalesce(score, 0) >= threshold and not gold) as fp, count(*) filter (coalesce(score, 0) < threshold and gold) as fn from r, (values (0.2::double), (0.4::double), (0.6::double), (0.8::double)) t(threshold) group by all),
    sw as (select *, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) as recall, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 6) as f1 from c)"""

SQL = {
    "dense_topk": TOPK.format(w="", k=10),
    "dense_topk_filtered": TOPK.format(w="and c.label in (1, 2, 3)", k=5),
    "sparse_topk": f"with {EMB} select * from {sparse_sql(10)}",
    "hybrid_rrf": f"with {EMB} {rrf_sql([dense_sql(50), sparse_sql(50)], 10, 2)}",
    "multi_variant_rrf": f"with {EMB} {rrf_sql([dense_sql(30), sparse_sql(30), sparse_sql(30, 0.2)], 10, 60)}",
    "chunk_graph_features": f"with {FEATURES} select * from fe",
    "graph_rerank": f"with {EMB}, {FEATURES}, r as (select b.query_id, b.chunk_id, b.score as base, b.rank as br, round(b.score + 0.15 * coalesce(matched, 0) + 0.08 * coalesce(neighbours, 0) + 0.10 * coalesce(typed_relations, 0), 6) as score from {dense_sql(25)} b left join fe using (query_id, chunk_id)) select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, base desc, br) as rank from r qualify rank <= 5",
    "retrieval_metrics": f"with {VALID}, {SOURCE}, " + METRICS.format(ks=", (values (1), (3), (5)) t(k)") + " select * from mt",
    "metrics_by_judge": f"with {VALID}, {SOURCE}, " + METRICS.format(ks="join (select s, j, max(rank)::int as k from src_rows group by all) using (s, j)") + f" select *, coalesce(nullif(list_position({evaluation.STRATEGIES}, evaluation_strategy), 0), {len(evaluation.STRATEGIES) + 1})::bigint as strategy_order from mt",
    "judge_ensemble": f"with {VALID} select query_id, chunk_id, rank, evaluation_strategy, round(avg(relevance_score), 6) as mean_score, round(avg((relevance_score >= 2)::int), 6) as vote_rate, round(coalesce(stddev_samp(relevance_score), 0), 6) as score_std, count(distinct judge_model) as n_judges, string_agg(distinct judge_model, ',' order by judge_model) as judges, count(distinct judge_model) = (select count(distinct judge_model) from ok) as complete from ok group by all",
    "best_k": f"with {VALID}, src_rows as (select evaluation_strategy as s, '' as j, query_id as q, rank, chunk_id, round(round(avg(relevance_score), 6))::bigint as relevance_score, false as is_source_chunk from ok group by all), " + METRICS.format(ks=", (values (1), (2), (3), (5)) t(k)") + " select * exclude (judge_model) from mt qualify row_number() over (partition by evaluation_strategy order by ndcg desc, hit_rate desc, mrr desc, k) = 1",
    "ensemble_metrics": f"with {VALID}, e as (select query_id, chunk_id, rank, evaluation_strategy, round(avg(relevance_score), 6) as m, round(avg((relevance_score >= 2)::int), 6) as v, round(coalesce(stddev_samp(relevance_score), 0), 6) as s from ok group by all), p as (select evaluation_strategy, k, query_id, avg(m) as m, avg((v >= 0.5)::int) as v, avg(s) as s from e, (values (1), (3)) t(k) where rank <= k group by all) select evaluation_strategy, k, count(*) as queries, round(avg(m), 5) as mean_score, round(avg(v), 5) as majority_rate, round(avg(s), 5) as mean_std from p group by all",
    "latency_summary": "select event_type, count(*) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.95), 6) as p95, round(sum(value), 4) as total from events group by 1",
    "threshold_sweep": f"with {SWEEP} select * from sw",
    "best_threshold": f"with {SWEEP} select * from sw qualify row_number() over (partition by grp order by (precision >= 0.5)::int desc, f1 desc, precision desc, recall desc, threshold) = 1",
    "judge_pending": f"with j as (select *, {JUDGE} as jm from dense_judgments), w as (select distinct query_id, chunk_id, evaluation_strategy, n.jm as judge_model from j, (select distinct jm from j where jm is not null) n where j.jm is not null) select * from w where not exists (select 1 from j c where c.judgment_status = 'completed' and c.query_id = w.query_id and c.chunk_id = w.chunk_id and c.evaluation_strategy = w.evaluation_strategy and c.jm = w.judge_model)",
}

QUERIES = {f.__name__: f for f in (dense_topk, dense_topk_filtered, sparse_topk, hybrid_rrf, multi_variant_rrf, chunk_graph_features, graph_rerank, retrieval_metrics, metrics_by_judge, best_k, judge_ensemble, ensemble_metrics, latency_summary, threshold_sweep, best_threshold, judge_pending)}

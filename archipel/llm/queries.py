"""Queries of the training-data operators. Each takes (spark, sf_dir) and runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archipel.llm import consensus, homoglyphs, mixing, names, neighbours, packing, personal, responses, scans, splitting
from archipel.session import table


def archive_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and chunks of the archive as one table of items."""
    documents = table(spark, sf_dir, "archive_documents").select(F.lit("document").alias("item_type"), F.col("document_id").alias("item_id"), "raw_text")
    chunks = table(spark, sf_dir, "archive_chunks").select(F.lit("chunk").alias("item_type"), F.col("chunk_id").alias("item_id"), "raw_text")
    return documents.unionByName(chunks)


def p1_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.defects(table(spark, sf_dir, "dense_judgments"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_defects(spark, sf_dir).select("record_id", "defect_type")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _ = consensus.consensus(table(spark, sf_dir, "dense_judgments"))
    return items.where("n_judges >= 3").select("query_id", "chunk_id", "relevance_score")


def p2_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.consensus(table(spark, sf_dir, "dense_judgments"))[0]


def p2_judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.judge_report(table(spark, sf_dir, "dense_judgments"))


def p2_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.alpha(table(spark, sf_dir, "dense_judgments"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.span_rows(personal.find(table(spark, sf_dir, "archive_chunks"))[0])


def p3_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.detect(table(spark, sf_dir, "archive_chunks")).select("chunk_id", "masked_text", F.size("entities").alias("n_entities"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.noise_rows(scans.worked(table(spark, sf_dir, "archive_chunks"))).select("chunk_id", "start_char", "noise_type")


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.worked(table(spark, sf_dir, "archive_chunks")).select("chunk_id", "clean_text", F.size("noise").alias("n_noise"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.links(table(spark, sf_dir, "nil_mentions"), table(spark, sf_dir, "local_entities")).select("mention_id", "entity_id")


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_items(archive_items(spark, sf_dir), ["item_type", "item_id"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized(p6_pieces(spark, sf_dir), ["item_type", "item_id"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbour_pairs(neighbours.nearest(table(spark, sf_dir, "embedded_text")))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "token_budgets"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fills(p8_packed(spark, sf_dir))


def p9_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(*mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return homoglyphs.alike_pairs(table(spark, sf_dir, "documents"))


def p10_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return homoglyphs.canonical(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return homoglyphs.classes(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p1_found, p1_defects, p2_found, p2_consensus, p2_judges, p2_agreement, p3_found, p3_masked, p4_found, p4_repaired, p5_found, p6_pieces, p6_found, p7_found, p8_packed, p8_fill, p9_mixed, p9_shares, p10_found, p10_canonical, p10_classes)
    return {f.__name__: f for f in own}


P6_FOUND = r"""
with items as (
    select distinct 'document' as item_type, document_id as item_id, raw_text from archive_documents where raw_text is not null
    union all
    select distinct 'chunk', chunk_id, raw_text from archive_chunks where raw_text is not null
), runs as (
    select item_type, item_id, len(regexp_extract_all(raw_text, '\S+')) as n,
        list_max(list_transform(string_split(regexp_replace(raw_text, '([.!?…。！？]["''’”»)\]]*)\s', '\1' || chr(10), 'g'), chr(10)),
            lambda s: len(regexp_extract_all(s, '\S+')))) as longest
    from items
)
select distinct item_type, item_id, case when longest > 350 then 'hard' else 'boundary' end as cut from runs where n > 350
"""


P2_AGREEMENT = r"""
with r as (
    select distinct record_id, query_id, chunk_id, relevance_score, regexp_replace(lower(relevance_label), '[^a-z]', '', 'g') as l,
        nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim(judge_model)), '__|\\', '/', 'g'), '^.*/', ''), '[_\s]+', '-', 'g'), '') as judge
    from dense_judgments where judgment_status = 'completed' and query_id is not null and chunk_id is not null
), v as (
    select query_id, chunk_id, judge, case when relevance_score between 0 and 3 then relevance_score
        when levenshtein(l, 'irrelevant') <= 2 then 0 when levenshtein(l, 'related') <= 2 then 1 when levenshtein(l, 'highlyrelevant') <= 2 then 2 when levenshtein(l, 'perfectlyrelevant') <= 2 then 3 end as label from r where judge is not null
), c as (select query_id, chunk_id, label, count(*) as n from v where label is not null group by all),
m as (select *, sum(n) over (partition by query_id, chunk_id) as m from c qualify m > 1),
i as (select query_id, chunk_id, any_value(m) as m, sum(n * (m - n)) as off from m group by all),
o as (select count(*) as items, sum(m)::bigint as pairable_votes, sum(off / (m - 1)) as d from i),
t as (select sum(t * t) as sq, sum(t) as total from (select sum(n) as t from m group by label))
select items, pairable_votes, round(d / pairable_votes, 6) as observed, round((total * total - sq) / (total * (total - 1)), 6) as expected,
    round(1 - (d / pairable_votes) / ((total * total - sq) / (total * (total - 1))), 6) as alpha from o, t
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_agreement": P2_AGREEMENT, "p6_found": P6_FOUND}

"""Queries over the archive: text, chunks, graph, mentions and qrels, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archipel.functions import text as T
from archipel.operators import chunking, coreference, extract, graph, masking, qrels, relations, spans
from archipel.session import table

SURFACE = r"trim(regexp_replace(lower(trim({c})), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def surface_sql(c: str) -> str:
    return SURFACE.format(c=c)


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "archive_documents")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "archive_chunks")


def mentions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nil_mentions")


def text_normalize(spark, d):
    n = T.normalize_text(F.col("raw_text"))
    return documents(spark, d).select("document_id", n.alias("t")).distinct().select("document_id", F.length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("digest"), T.word_count(F.col("t")).cast("bigint").alias("n_words"))


def word_windows(spark, d):
    rows = documents(spark, d).select("document_id", F.regexp_extract_all(F.coalesce("raw_text", F.lit("")), F.lit(r"[^ \t\n\r]+"), 0).alias("w")).distinct().where(F.size("w") > 0)
    w = rows.select("document_id", F.posexplode(chunking.word_windows(F.col("w"))).alias("window", "x"))
    return w.select("document_id", F.col("window").cast("bigint").alias("window"), F.col("x.start").cast("bigint").alias("start_word"), F.size("x.words").cast("bigint").alias("n_words"), F.md5(F.array_join("x.words", " ")).alias("digest"))


def stable_ids(spark, d):
    return documents(spark, d).select("document_id", T.stable_id(F.col("dataset"), F.col("source_id")).alias("stable_id")).distinct()


def vector_point_ids(spark, d):
    return chunks(spark, d).where("chunk_id is not null").select("chunk_id", T.uuid5(F.concat(F.lit("archive-chunk:"), F.col("chunk_id"))).alias("point_id")).distinct()


def quality_rows(spark, d):
    return qrels.with_quality(chunks(spark, d).select("chunk_id", "dataset", "access_level", "masked_text").distinct())


def text_quality(spark, d):
    return quality_rows(spark, d).drop("access_level", "masked_text", "dataset")


def public_candidates(spark, d):
    rows = qrels.public_candidates(chunks(spark, d).select("chunk_id", "dataset", "access_level", "masked_text").distinct())
    return rows.select("chunk_id", "length_bucket", "text_token_count")


def candidate_summary(spark, d):
    return quality_rows(spark, d).groupBy("dataset", "length_bucket", "query_candidate_quality").agg(F.count("*").alias("n"), F.round(F.avg("text_token_count"), 6).alias("mean_tokens"))


def archive_skeleton_nodes(spark, d):
    return graph.skeleton_nodes(chunks(spark, d))


def archive_skeleton_edges(spark, d):
    return graph.skeleton_edges(chunks(spark, d))


def graph_statistics(spark, d):
    return graph.statistics(graph.skeleton_nodes(chunks(spark, d)), graph.skeleton_edges(chunks(spark, d)))


def connected_mentions(spark, d):
    """Mention edges whose chunk exists; dangling ones are dropped."""
    edges = mentions(spark, d).select(F.lit("HAS_MENTION").alias("type"), F.col("chunk_id").alias("start_id"), F.col("mention_id").alias("end_id"))
    return graph.connected_edges(edges, chunks(spark, d).select(F.col("chunk_id").alias("node_id")), mentions(spark, d).select(F.col("mention_id").alias("node_id")))


def transcript_turns(spark, d):
    rows = documents(spark, d).where("dataset = 'mediasum'").select("document_id", "raw_text").distinct()
    lines = rows.select("document_id", F.posexplode(F.split("raw_text", "\n")).alias("turn", "line"))
    speaker = F.regexp_extract("line", r"^([^:]{1,80}):", 1)
    return lines.select("document_id", F.col("turn").cast("bigint").alias("turn"), speaker.alias("speaker"), F.length("line").cast("bigint").alias("n_chars")).where("speaker <> ''")


def speaker_counts(spark, d):
    return transcript_turns(spark, d).groupBy("speaker").agg(F.count("*").alias("turns"), F.count_distinct("document_id").alias("documents"))


def ocr_lines(spark, d):
    rows = chunks(spark, d).select("chunk_id", "raw_text").distinct()
    found = F.regexp_extract_all("raw_text", F.lit(r"OCR Line \d+ \[(\d+,\d+,\d+,\d+)\]"), 1)
    flat = rows.select("chunk_id", F.explode(found).alias("box")).select("chunk_id", F.split("box", ",").cast("array<int>").alias("b"))
    return flat.groupBy("chunk_id").agg(F.count("*").alias("n_lines"), F.min(F.col("b")[0]).alias("x0"), F.min(F.col("b")[1]).alias("y0"), F.max(F.col("b")[2]).alias("x1"), F.max(F.col("b")[3]).alias("y1"))


def surface_block_keys(spark, d):
    s = T.surface(F.col("mention_text"))
    rows = mentions(spark, d).where("mention_text is not null").select("mention_text", s.alias("surface")).distinct()
    return rows.select("mention_text", "surface", T.block_key(F.col("surface")).alias("block"), T.is_acronym(F.col("mention_text")).alias("acronym"))


def kind_of(c) -> F.Column:
    """Mention types under the names of the relation schema; these tables say ORG."""
    k = F.upper(F.trim(c))
    return F.when(k == "ORG", "ORGANIZATION").otherwise(k)


def typed_mentions(spark, d):
    return mentions(spark, d).withColumn("mention_type", kind_of(F.col("mention_type")))


def coref_rows(spark, d):
    return coreference.candidates(typed_mentions(spark, d))


def exact_surface_clusters(spark, d):
    return coreference.exact_clusters(coref_rows(spark, d))


def coref_blocks(spark, d):
    return coref_rows(spark, d).groupBy("block_key").agg(F.count("*").alias("mentions"), F.count_distinct("surface").alias("surfaces"))


def agglomerative_coref(spark, d):
    return coreference.clusters(coref_rows(spark, d))


def coref_labels(spark, d):
    return coref_rows(spark, d).join(mentions(spark, d).select("mention_id", F.lower("normalized_mention_text").alias("gold")).distinct(), "mention_id").select(F.col("block_key").alias("pred"), F.nullif("gold", F.lit("")).alias("gold"))


def pairwise_coref(spark, d):
    return coreference.pairwise(coref_labels(spark, d))


def purity(spark, d):
    return coreference.purity(coref_labels(spark, d))


def nil_summary(spark, d):
    rows = mentions(spark, d).select("mention_id", "mention_type", T.surface(F.col("mention_text")).alias("surface")).distinct()
    return rows.groupBy("mention_type", "surface").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "surface", "mention_type").limit(100)


def linked(spark, d):
    """Mentions whose surface is that of an entity."""
    e = table(spark, d, "local_entities").select("entity_id", T.surface(F.col("canonical_name")).alias("surface"))
    m = mentions(spark, d).select("mention_id", "chunk_id", "start_char", "end_char", "confidence", "mention_type", T.surface(F.col("mention_text")).alias("surface")).distinct()
    return m.join(e, "surface")


def chunk_entity_edges(spark, d):
    return graph.chunk_entity_edges(linked(spark, d)).select("chunk_id", "entity_id", "mention_count", F.round("best_score", 6).alias("best_score"))


def asked_terms(spark, d):
    """The surface terms of all queries, and the words of all entity names that are long enough to be asked for."""
    q = table(spark, d, "dense_judgments").where("query is not null").select("query").distinct()
    return q.select(F.explode(T.surface_terms(F.col("query"))).alias("term")).union(table(spark, d, "nil_mentions").where("length(mention_text) between 2 and 60").select(F.col("mention_text"))).distinct()


def surface_containment(spark, d):
    """Entities whose name contains a term that is asked for, or whose name a term contains."""
    return graph.surface_matches(asked_terms(spark, d), table(spark, d, "local_entities"))


def entity_aliases(spark, d):
    e = table(spark, d, "local_entities")
    flat = e.select("entity_id", "canonical_name", F.explode_outer("aliases").alias("alias"))
    return flat.groupBy("entity_id", "canonical_name").agg(F.count_distinct("alias").alias("n_aliases"), F.coalesce(F.array_join(F.array_sort(F.collect_set("alias")), "|"), F.lit("")).alias("aliases"))


def entity_upsert(spark, d):
    """Entity nodes merged with what mentions know of them: a new property replaces, a null keeps."""
    old = table(spark, d, "local_entities").select("entity_id", F.col("canonical_name").alias("name"), F.col("entity_type").alias("kind"))
    new = linked(spark, d).groupBy("entity_id").agg(F.lit(None).cast("string").alias("name"), F.max("mention_type").alias("kind"))
    return graph.upsert(old, new, "entity_id")


def nation_graph(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("start_id"), F.concat(F.lit("r"), "n_regionkey").alias("end_id"), F.lit(" part_of ").alias("relation_type"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), F.lit("located_in"))
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), F.lit("lives in"))
    return n.union(s).union(c)


def typed_relation_counts(spark, d):
    return graph.typed_relations(nation_graph(spark, d)).groupBy("relation_type").agg(F.count("*").alias("n"))


def graph_hints(spark, d):
    edges = graph.typed_relations(nation_graph(spark, d))
    e = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("entity_id"))
    return graph.hints(e, edges)


def pair_candidates(spark, d):
    m = linked(spark, d).select("chunk_id", "entity_id", kind_of(F.col("mention_type")).alias("kind"), "start_char", "end_char").where("chunk_id is not null and kind is not null")
    return relations.pair_candidates(m, relations.relation_schema(spark)).select("chunk_id", "head", "tail", F.col("gap").cast("bigint").alias("gap"), F.col("rank").cast("bigint").alias("rank"))


def predictions(spark, d):
    l = table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.pmod("l_partkey", F.lit(50))).alias("head"), F.concat(F.lit("p"), F.pmod("l_suppkey", F.lit(50))).alias("tail"), F.when(F.col("l_returnflag") == "R", "works-for").when(F.col("l_returnflag") == "A", "part of").otherwise("located in").alias("label"), F.lit("ORGANIZATION").alias("head_type"), F.when(F.col("l_linestatus") == "O", "LOCATION").otherwise("ORGANIZATION").alias("tail_type"), F.col("l_discount").alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return l


def typed_relations_normalized(spark, d):
    return relations.normalized(predictions(spark, d), relations.relation_schema(spark), 0.05)


def edge_set_algebra(spark, d):
    rows = relations.normalized(predictions(spark, d), relations.relation_schema(spark), 0.0)
    return relations.edge_sets(rows.where("score >= 0.1"), rows.where("length(head) = 2 or score < 0.1"), ["head", "tail", "relation"], "relation")


def relation_side_weights(spark, d):
    rows = predictions(spark, d).select(F.upper("label").alias("relation"), "head_type", "tail_type", (F.col("score") >= 0.05).alias("head_gold"), (F.col("score") >= 0.08).alias("tail_gold"))
    return relations.side_weights(rows)


def score_combination(spark, d):
    rows = predictions(spark, d)
    p, r = F.col("score") * 10, F.pmod("ord", F.lit(7)) / 7.0
    return rows.groupBy("label").agg(F.round(F.avg(relations.combined(p, r, 0.3)), 6).alias("mean_sum"), F.round(F.avg(relations.combined(p, r, 0.5, 2.0)), 6).alias("mean_f2"))


def mask_tuning(spark, d):
    rows = predictions(spark, d).select((F.col("score") * 10).alias("policy"), (F.pmod("ord", F.lit(7)) / 7.0).alias("relation"), (F.pmod("ord", F.lit(3)) == 0).alias("gold"))
    return masking.tuned(rows, [0.0, 0.5, 1.0], [0.5, 1.0, 2.0], [0.2, 0.4, 0.6])


def score_bands(spark, d):
    s = F.col("l_discount") * 10
    band = F.when(s < 0.15, "very_low").when(s < 0.4, "low").when(s < 0.7, "medium").otherwise("high")
    return table(spark, d, "lineitem").groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def span_rows(spark, d):
    return mentions(spark, d).where("chunk_id is not null and start_char is not null and end_char > start_char").select("mention_id", "chunk_id", "start_char", "end_char", F.coalesce("mention_type", F.lit("NONE")).alias("label"), "confidence", "extractor").distinct()


def span_dedup_best(spark, d):
    rows = span_rows(spark, d).withColumn("score", F.col("confidence"))
    return spans.best_per_span(rows, ["chunk_id", "start_char", "end_char", "label"], "score", "mention_id").select("mention_id", "chunk_id", "start_char", "end_char", "label")


def sides(spark, d):
    rows = span_rows(spark, d).select("chunk_id", "start_char", "end_char", "label", "extractor").distinct()
    return rows.where("extractor = 'gliner'").drop("extractor"), rows.where("extractor = 'manual_entry'").drop("extractor")


def span_match_strict(spark, d):
    p, g = sides(spark, d)
    return spans.strict_match(p, g, ["chunk_id", "label"], ["label"])


def span_match_relaxed(spark, d):
    p, g = sides(spark, d)
    return spans.scored(spans.greedy_match(p, g, "chunk_id").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")))


def span_mismatches(spark, d):
    p, g = sides(spark, d)
    return spans.mismatches(p, g, "chunk_id").groupBy("kind", "label").agg(F.count("*").alias("n"))


def merged_span_length(spark, d):
    return spans.merged_lengths(span_rows(spark, d).select("chunk_id", "start_char", "end_char").distinct(), "chunk_id").select("chunk_id", F.col("merged_chars").cast("bigint").alias("merged_chars"))


def gold_spans(spark, d):
    rows = chunks(spark, d).select("chunk_id", F.explode("sensitive_entities").alias("e")).select("chunk_id", F.col("e.start").alias("start_char"), F.col("e.end").alias("end_char"), F.col("e.entity_type").alias("label"), "e.text")
    return rows.where("start_char is not null and end_char > start_char").distinct()


def masking_metrics(spark, d):
    p = span_rows(spark, d).select("chunk_id", "start_char", "end_char").distinct()
    g = gold_spans(spark, d).select("chunk_id", "start_char", "end_char").distinct()
    t = chunks(spark, d).select("chunk_id", "raw_text")
    known = t.select("chunk_id").distinct()
    return spans.masking_metrics(p.join(known, "chunk_id", "left_semi"), g, t, "chunk_id").select(*(F.col(c).cast("bigint").alias(c) for c in ("chars", "masked", "sensitive", "covered")), "ssr", "ssp", "f1", "rstr", "mcr")


def masked_chunks(spark, d):
    t = chunks(spark, d).where("raw_text is not null").groupBy("chunk_id").agg(F.min("raw_text").alias("raw_text"))
    g = gold_spans(spark, d).join(t, "chunk_id").where(F.substr("raw_text", F.col("start_char") + 1, F.col("end_char") - F.col("start_char")) == F.col("text")).select("chunk_id", "start_char", "end_char", "label")
    return masking.mask_spans(t, g)


def span_repair(spark, d):
    """Offsets the older masker recorded, put right where its text is found."""
    t = chunks(spark, d).where("raw_text is not null").groupBy("chunk_id").agg(F.min("raw_text").alias("raw_text"))
    g = gold_spans(spark, d).where("text is not null").join(t, "chunk_id")
    at = spans.repaired(F.col("raw_text"), F.col("text"), F.col("start_char"), F.col("end_char"))
    return g.select("chunk_id", "start_char", "label", "text", at.alias("repaired_start"))


def dataset_summary(spark, d):
    rows = chunks(spark, d).select("chunk_id", "dataset", F.length("raw_text").cast("double").alias("n")).distinct()
    q = lambda p, name: F.round(F.percentile("n", F.lit(p)), 6).alias(name)
    return rows.groupBy("dataset").agg(F.count("n").alias("n"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_samp("n"), 6).alias("std"), F.min("n").alias("least"), q(0.25, "q1"), q(0.5, "median"), q(0.75, "q3"), F.max("n").alias("most"))


def label_support(spark, d):
    return gold_spans(spark, d).groupBy("label").agg(F.count("*").alias("spans"), F.count_distinct("chunk_id").alias("chunks"), F.round(F.avg(F.col("end_char") - F.col("start_char")), 6).alias("mean_chars"))


def assisted_gold_ids(spark, d):
    """A gold id for surfaces typed at least twice under one type."""
    rows = coref_rows(spark, d).where(~T.is_ambiguous(F.col("surface")))
    n = F.count("*").over(Window.partitionBy("mention_type", "surface"))
    return rows.withColumn("n", n).where("n >= 2").select("mention_id", F.concat_ws("_", F.lit("gold"), F.lower("mention_type"), F.regexp_replace("surface", " ", "_")).alias("gold_id"))


def quota_sample(spark, d):
    s = F.col("score") * 10
    band = F.when(s < 0.15, "very_low").when(s < 0.4, "low").when(s < 0.7, "medium").otherwise("high")
    rows = predictions(spark, d).select(F.col("ord").cast("string").alias("key"), F.col("label").alias("family"), band.alias("band")).distinct()
    return qrels.quota_sample(rows, "band", "family", "key", 200, {"very_low": 0.2, "low": 0.35, "medium": 0.35, "high": 0.1})


def relation_summary(spark, d):
    rows = relations.normalized(predictions(spark, d), relations.relation_schema(spark), 0.0)
    per = rows.groupBy("relation").agg(F.count("*").alias("edges"), F.count_distinct("head").alias("heads"), F.count_distinct("tail").alias("tails"), F.round(F.avg("score"), 6).alias("mean_score"))
    return per.join(F.broadcast(relations.relation_schema(spark).select("relation", "family").distinct()), "relation")


def context_windows(spark, d):
    """Mentions that may be clustered, with the text around them, 240 characters to each side, marked."""
    rows = coreference.prepared(typed_mentions(spark, d), chunks(spark, d), "raw_text")
    return rows.select("mention_id", "block_key", F.md5("context_text").alias("digest"))


def document_chunks(spark, d):
    return chunking.chunk_documents(documents(spark, d))


def token_windows(spark, d):
    rows = documents(spark, d).where("raw_text is not null").select("document_id", "raw_text").distinct()
    rows = rows.select("document_id", T.token_offsets(F.col("raw_text")).alias("offsets"))
    w = rows.select("document_id", F.posexplode(chunking.token_windows(F.col("offsets"))).alias("window", "x"))
    return w.select("document_id", "window", "x.*")


def rule_extraction(spark, d):
    rows = chunks(spark, d).where("raw_text is not null").select("chunk_id", "raw_text").distinct()
    return extract.extract_spans(rows, "raw_text").groupBy("label").agg(F.count("*").alias("n"))


def query_terms(spark, d):
    q = table(spark, d, "dense_judgments").where("query is not null").select("query_id", "query").distinct()
    return q.select("query_id", "query", F.array_join(T.surface_terms(F.col("query")), "|").alias("terms"))


def qrel_rows(spark, d):
    return table(spark, d, "dense_judgments").where("query is not null").select("query_id", "query", "source_chunk_id").distinct()


def qrel_dedup(spark, d):
    return qrels.deduplicated(qrel_rows(spark, d))


def query_ids(spark, d):
    return qrel_rows(spark, d).select("source_chunk_id", "query", T.query_id(F.col("source_chunk_id"), F.col("query")).alias("made_id"))


def qrel_validation(spark, d):
    rows = table(spark, d, "dense_judgments").select("query", F.col("expected_relevant_information").alias("e"), F.col("rationale").alias("a"), F.col("evaluation_strategy").alias("t"), F.col("relevance_label").alias("l"), (F.col("judgment_status") == "failed").alias("x"))
    r = qrels.reject_reasons(F.col("query"), F.col("e"), F.col("a"), F.col("t"), F.col("l"), F.col("x"))
    return rows.select(F.explode(r).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def split_dev_test(spark, d):
    rows = documents(spark, d).select("document_id", F.coalesce("dataset", F.lit("none")).alias("dataset")).distinct()
    return qrels.split_dev_test(rows, "dataset", "document_id").select("document_id", "dataset", "split")


def stratified_sample(spark, d):
    rows = documents(spark, d).select("document_id", F.coalesce("dataset", F.lit("none")).alias("dataset")).distinct()
    return qrels.stratified_sample(rows, "dataset", "document_id", 60)


def incremental_resume(spark, d):
    """Chunks that have no embedding yet."""
    have = table(spark, d, "embedded_text").where("dense is not null")
    return chunks(spark, d).where("chunk_id is not null").select("chunk_id", "dataset").distinct().join(have.select("chunk_id").distinct(), "chunk_id", "left_anti")


def late_documents(spark, d):
    rows = table(spark, d, "documents").where("created_at is not null")
    late = F.col("ingested_at") > F.col("created_at") + F.expr("INTERVAL 7 DAYS")
    return rows.groupBy(F.date_trunc("month", "created_at").alias("month")).agg(F.count("*").alias("n"), F.count_if(late).alias("late"))


def unique_violations(spark, d):
    return chunks(spark, d).groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1")


def entity_chain(spark, d):
    """Typed relations between entities that follow each other by name: a stand-in for extracted relations."""
    e = table(spark, d, "local_entities").select("entity_id", "entity_type", "canonical_name")
    nxt = F.lead("entity_id").over(Window.partitionBy("entity_type", F.substring("canonical_name", 1, 1)).orderBy("canonical_name", "entity_id"))
    return e.select(F.concat(F.lit("x"), "entity_id").alias("relation_id"), F.col("entity_id").alias("start_id"), nxt.alias("end_id")).where("end_id is not null")


KIND_SQL = "case when upper(trim(mention_type)) = 'ORG' then 'ORGANIZATION' else upper(trim(mention_type)) end"

TERMS_SQL = r"""list_slice(list_filter(tidy, lambda x, i: list_position(low, lower(x)) = i), 1, {n})"""

QUERY_TERMS_SQL = r"""qt as (select query_id, query, list_filter(list_transform(list_filter(list_concat(list_transform(regexp_extract_all(query, '"([^"]+)"|''([^'']+)'''), lambda x: x[2:-2]), regexp_extract_all(query, '\b[A-Z][A-Za-z0-9&.-]*(?:\s+[A-Z][A-Za-z0-9&.-]*)*'), regexp_extract_all(query, '\b[A-Z]{2,}\b')), lambda x: trim(x) not in ({stop})), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') as tidy from (select distinct query_id, query from dense_judgments where query is not null)),
    ql as (select *, list_transform(tidy, lambda x: lower(x)) as low from qt), qs as (select query_id, query, list_filter(tidy, lambda x, i: list_position(low, lower(x)) = i) as terms from ql)""".replace("{stop}", ", ".join(f"'{w}'" for w in T.QUERY_STOPWORDS))

LINKED_SQL = f"""linked as (
    select m.*, e.entity_id from (select distinct mention_id, chunk_id, start_char, end_char, confidence, mention_type, {surface_sql('mention_text')} as surface from nil_mentions) m
    join (select entity_id, {surface_sql('canonical_name')} as surface from local_entities) e using (surface))"""

NORMAL_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(raw_text, ''), '\r\n?', chr(10), 'g'), '\\([''"])', '\1', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""

QUALITY_SQL = r"""s as (
    select distinct chunk_id, dataset, access_level, masked_text, coalesce(masked_text, '') as t from archive_chunks
), w as (
    select *, regexp_extract_all(lower(t), '[a-z0-9_]+') as words, length(regexp_replace(t, '\s', '', 'g')) as solid, length(regexp_replace(t, '[^\p{L}]', '', 'g')) as alpha, length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) as alnum from s
), q as (
    select chunk_id, dataset, access_level, masked_text, length(t) as text_char_count, len(words) as text_token_count, len(list_distinct(words)) as unique_token_count,
        round(alpha / greatest(length(t), 1), 6) as alpha_ratio, round(greatest(greatest(solid, 1) - alnum, 0) / greatest(solid, 1), 6) as punctuation_noise_ratio from w
), f as (
    select *, case when text_token_count <= 80 then 'short' when text_token_count <= 180 then 'medium' when text_token_count <= 400 then 'long' else 'very_long' end as length_bucket,
        regexp_matches(coalesce(masked_text, ''), '(?i)^\s*(dataset|modality|title|summary|metadata)\s*:') and text_token_count < 120 as is_metadata_only_like from q
), z as (
    select *, case when is_metadata_only_like then 'metadata_only' when alpha_ratio < 0.45 or punctuation_noise_ratio > 0.35 or (unique_token_count < 25 and text_token_count >= 80) then 'ocr_noise'
        when text_char_count < 300 or text_token_count < 45 or unique_token_count < 20 then 'too_short' else 'usable' end as query_candidate_quality from f)"""

QUOTED = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)

BLOCK_SQL = f"""case when len(ws) = 0 then '' when len(ws) = 1 then substr(ws[1], 1, 4) when len(tel) > 0 then list_filter(tel, lambda w: length(w) = list_max(list_transform(tel, lambda x: length(x))))[1] else array_to_string(ws[1:2], ' ') end"""

COREF_SQL = f"""m as (
    select distinct mention_id, mention_text, case when upper(trim(mention_type)) = 'ORG' then 'ORGANIZATION' else upper(trim(mention_type)) end as mention_type, dataset, document_id, chunk_id, {surface_sql('mention_text')} as surface from nil_mentions
), k as (
    select *, list_filter(string_split(surface, ' '), lambda w: w <> '') as ws, list_filter(string_split(surface, ' '), lambda w: length(w) > 2 and w not in ({QUOTED(T.BLOCK_STOPWORDS)})) as tel, string_split(surface, ' ')[-1] as lastw,
        regexp_replace(coalesce(mention_text, ''), '[^\\p{{L}}]', '', 'g') as letters from m
), c as (
    select *, {BLOCK_SQL} as block from k where mention_type in ({QUOTED(coreference.TYPES)}) and surface is not null and surface <> '' and surface not in ({QUOTED(T.PRONOUNS + T.GENERIC + T.ROLES)})
        and not (mention_type = 'PERSON' and (regexp_matches(surface, '^(a|an|another|her|his|my|other|our|some|their|your) ') or lastw in ({QUOTED(T.ROLES + T.PERSON_WORDS)})))
        and not (mention_type = 'ORGANIZATION' and (regexp_matches(surface, '^(a|an|another|other|some) ') or lastw in ('authorities', 'center', 'commission', 'entities', 'judges', 'owners', 'voters', 'workers')))
), g as (
    select *, case when surface in ({QUOTED(T.AMBIGUOUS)}) or (not contains(surface, ' ') and length(surface) <= 3) then concat_ws('|', mention_type, 'ambiguous', coalesce(dataset, ''), coalesce(document_id, ''), block)
        when length(letters) between 2 and 8 and letters = upper(letters) then concat_ws('|', mention_type, 'acronym', coalesce(dataset, ''), block) else concat_ws('|', mention_type, 'surface', block) end as block_key from c)"""

LABEL_SQL = f"""{COREF_SQL}, labels as (
    select g.block_key as pred, nullif(n.gold, '') as gold from g join (select distinct mention_id, lower(normalized_mention_text) as gold from nil_mentions) n using (mention_id)
), ct as (select pred, gold, count(*) as n from labels where pred is not null and gold is not null group by all)"""

PRED_SQL = """p as (select 'p' || (l_partkey % 50) as head, 'p' || (l_suppkey % 50) as tail, case when l_returnflag = 'R' then 'works-for' when l_returnflag = 'A' then 'part of' else 'located in' end as label, 'ORGANIZATION' as head_type,
    case when l_linestatus = 'O' then 'LOCATION' else 'ORGANIZATION' end as tail_type, l_discount as score, l_orderkey * 10 + l_linenumber as ord from lineitem)"""

ALLOWED = ", ".join(f"('{r}', '{h}', '{t}')" for r, _, h, t in relations.schema_rows())

NORMALIZED_SQL = f"""{PRED_SQL}, schema as (select * from (values {ALLOWED}) v(relation, ht, tt)), okp as (
    select *, upper(regexp_replace(trim(label), '[\\s-]+', '_', 'g')) as relation from p where head <> tail
), normal as (
    select head, tail, relation, score from okp where exists (select 1 from schema s where s.relation = okp.relation and s.ht = head_type and s.tt = tail_type) and score >= {{t}}
    qualify row_number() over (partition by head, tail, relation order by score desc, ord) = 1)"""

SPAN_SQL = """sp as (select distinct mention_id, chunk_id, start_char, end_char, coalesce(mention_type, 'NONE') as label, confidence, extractor from nil_mentions where chunk_id is not null and start_char is not null and end_char > start_char)"""

GOLD_SQL = """gs as (select distinct chunk_id, start_char, end_char from (select chunk_id, e.start as start_char, e."end" as end_char from (select chunk_id, unnest(sensitive_entities) as e from archive_chunks)) where start_char is not null and end_char > start_char)"""

MERGE_SQL = """(select chunk_id, sum(greatest(0, end_char - greatest(start_char, coalesce(reach, start_char)))) as m from (select *, max(end_char) over (partition by chunk_id order by start_char, end_char rows between unbounded preceding and 1 preceding) as reach from {t}) group by 1)"""

EDGES_SQL = "select 'n' || n_nationkey as start_id, 'r' || n_regionkey as end_id, ' part_of ' as relation_type from nation union all select 's' || s_suppkey, 'n' || s_nationkey, 'located_in' from supplier union all select 'c' || c_custkey, 'n' || c_nationkey, 'lives in' from customer"

FORM_SQL = r"trim(regexp_replace(regexp_replace(lower(query), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"

DICE_SQL = "(('0x' || substr(md5('42|' || {k}), 1, 8))::ubigint / 4294967296.0)"

SCORED_SQL = "round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) as recall, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 6) as f1"

SQL = {
    "text_normalize": f"select document_id, length(t) as n_chars, md5(t) as digest, len(regexp_extract_all(t, '\\S+')) as n_words from (select distinct document_id, {NORMAL_SQL} as t from archive_documents)",
    "word_windows": r"""with w as (select distinct document_id, regexp_extract_all(coalesce(raw_text, ''), '[^ \t\n\r]+') as w from archive_documents), x as (select document_id, w, unnest(range(greatest(1, ceil((len(w) - 60) / 290.0)::bigint))) as window_ from w where len(w) > 0)
        select document_id, window_ as "window", window_ * 290 as start_word, len(w[window_ * 290 + 1 : window_ * 290 + 350]) as n_words, md5(array_to_string(w[window_ * 290 + 1 : window_ * 290 + 350], ' ')) as digest from x""",
    "stable_ids": "select distinct document_id, substr(sha256(concat_ws('::', dataset, source_id)), 1, 24) as stable_id from archive_documents",
    "vector_point_ids": "select distinct chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::int % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as point_id from (select chunk_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('archive-chunk:' || chunk_id)) as h from archive_chunks where chunk_id is not null)",
    "text_quality": f"with {QUALITY_SQL} select chunk_id, text_char_count, text_token_count, unique_token_count, alpha_ratio, punctuation_noise_ratio, length_bucket, is_metadata_only_like, query_candidate_quality from z",
    "public_candidates": f"with {QUALITY_SQL} select chunk_id, length_bucket, text_token_count from z where lower(access_level) = 'public' and masked_text is not null and trim(masked_text) <> '' and text_token_count >= 45 and unique_token_count >= 20 and alpha_ratio >= 0.45 and punctuation_noise_ratio <= 0.35 and not is_metadata_only_like",
    "candidate_summary": f"with {QUALITY_SQL} select dataset, length_bucket, query_candidate_quality, count(*) as n, round(avg(text_token_count), 6) as mean_tokens from z group by all",
    "archive_skeleton_nodes": "select distinct label, node_id from (select 'Dataset' as label, dataset as node_id from archive_chunks union all select 'Modality', modality from archive_chunks union all select 'Document', document_id from archive_chunks union all select 'Chunk', chunk_id from archive_chunks) where node_id is not null",
    "archive_skeleton_edges": "select distinct type, start_id, end_id from (select 'HAS_DOCUMENT' as type, dataset as start_id, document_id as end_id from archive_chunks union all select 'HAS_CHUNK', document_id, chunk_id from archive_chunks union all select 'HAS_MODALITY', document_id, modality from archive_chunks) where start_id is not null and end_id is not null",
    "graph_statistics": "with n as (select distinct label, node_id from (select 'Dataset' as label, dataset as node_id from archive_chunks union all select 'Modality', modality from archive_chunks union all select 'Document', document_id from archive_chunks union all select 'Chunk', chunk_id from archive_chunks) where node_id is not null), e as (select distinct type, start_id, end_id from (select 'HAS_DOCUMENT' as type, dataset as start_id, document_id as end_id from archive_chunks union all select 'HAS_CHUNK', document_id, chunk_id from archive_chunks union all select 'HAS_MODALITY', document_id, modality from archive_chunks) where start_id is not null and end_id is not null) select 'node' as kind, label as name, count(*) as n from n group by all union all select 'edge', type, count(*) from e group by all",
    "connected_mentions": "select distinct 'HAS_MENTION' as type, chunk_id as start_id, mention_id as end_id from nil_mentions where chunk_id in (select chunk_id from archive_chunks where chunk_id is not null) and mention_id is not null",
    "transcript_turns": "with l as (select document_id, unnest(string_split(raw_text, chr(10))) as line, generate_subscripts(string_split(raw_text, chr(10)), 1) - 1 as turn from (select distinct document_id, raw_text from archive_documents where dataset = 'mediasum')) select document_id, turn, regexp_extract(line, '^([^:]{1,80}):', 1) as speaker, length(line) as n_chars from l where regexp_extract(line, '^([^:]{1,80}):', 1) <> ''",
    "speaker_counts": "with l as (select document_id, unnest(string_split(raw_text, chr(10))) as line from (select distinct document_id, raw_text from archive_documents where dataset = 'mediasum')) select regexp_extract(line, '^([^:]{1,80}):', 1) as speaker, count(*) as turns, count(distinct document_id) as documents from l where regexp_extract(line, '^([^:]{1,80}):', 1) <> '' group by 1",
    "ocr_lines": r"with b as (select chunk_id, string_split(unnest(regexp_extract_all(raw_text, 'OCR Line \d+ \[(\d+,\d+,\d+,\d+)\]', 1)), ',') as b from (select distinct chunk_id, raw_text from archive_chunks)) select chunk_id, count(*) as n_lines, min(b[1]::int) as x0, min(b[2]::int) as y0, max(b[3]::int) as x1, max(b[4]::int) as y1 from b group by 1",
    "surface_block_keys": f"with m as (select distinct mention_text, {surface_sql('mention_text')} as surface from nil_mentions where mention_text is not null), k as (select *, list_filter(string_split(surface, ' '), lambda w: w <> '') as ws, list_filter(string_split(surface, ' '), lambda w: length(w) > 2 and w not in ({QUOTED(T.BLOCK_STOPWORDS)})) as tel, regexp_replace(mention_text, '[^\\p{{L}}]', '', 'g') as letters from m) select mention_text, surface, {BLOCK_SQL} as block, length(letters) between 2 and 8 and letters = upper(letters) as acronym from k",
    "coref_blocks": f"with {COREF_SQL} select block_key, count(*) as mentions, count(distinct surface) as surfaces from g group by 1",
    "exact_surface_clusters": f"with {COREF_SQL}, per as (select block_key, surface, mention_text, count(*) as c from g group by all), b as (select *, sum(c) over (partition by block_key, surface) as n, row_number() over (partition by block_key, surface order by c desc, (mention_text = upper(mention_text) and length(mention_text) > 3)::int, length(mention_text) desc, mention_text desc) as r from per) select block_key, surface, n::bigint as n, mention_text as canonical_name from b where r = 1 and n >= 2",
    "pairwise_coref": f"with {LABEL_SQL}, a as (select (select sum(n * (n - 1) / 2) from ct) as tp, (select sum(n * (n - 1) / 2) from (select sum(n) as n from ct group by pred)) as pp, (select sum(n * (n - 1) / 2) from (select sum(n) as n from ct group by gold)) as gp) select tp::bigint as tp, pp::bigint as pred_pairs, gp::bigint as gold_pairs, round(case when pp > 0 then tp / pp else 0 end, 6) as precision, round(case when gp > 0 then tp / gp else 0 end, 6) as recall, round(case when pp + gp > 0 then 2 * tp / (pp + gp) else 0 end, 6) as f1 from a",
    "purity": f"with {LABEL_SQL} select (select sum(n) from ct)::bigint as total, round((select sum(m) from (select max(n) as m from ct group by pred)) / (select sum(n) from ct), 6) as purity, round((select sum(m) from (select max(n) as m from ct group by gold)) / (select sum(n) from ct), 6) as inverse_purity, round((select count(pred) / count(*) from labels), 6) as coverage",
    "nil_summary": f"select mention_type, surface, count(*) as n from (select distinct mention_id, mention_type, {surface_sql('mention_text')} as surface from nil_mentions) group by all order by n desc, surface nulls first, mention_type nulls first limit 100",
    "chunk_entity_edges": f"with {LINKED_SQL} select chunk_id, entity_id, count(*) as mention_count, round(max(confidence), 6) as best_score from linked group by all",
    "surface_containment": f"with {QUERY_TERMS_SQL}, t as (select distinct unnest(terms[1:8]) as term from qs union select distinct mention_text from nil_mentions where length(mention_text) between 2 and 60) select distinct term, entity_id from local_entities, t where length(trim(term)) >= 2 and (contains(lower(canonical_name), lower(trim(term))) or (length(canonical_name) >= 2 and contains(lower(trim(term)), lower(canonical_name))))",
    "query_terms": f"with {QUERY_TERMS_SQL} select query_id, query, array_to_string(terms[1:8], '|') as terms from qs",
    "entity_aliases": "with f as (select entity_id, canonical_name, unnest(case when aliases is null or len(aliases) = 0 then [null] else aliases end) as alias from local_entities) select entity_id, canonical_name, count(distinct alias) as n_aliases, coalesce(array_to_string(list_sort(list_distinct(list(alias) filter (alias is not null))), '|'), '') as aliases from f group by all",
    "entity_upsert": f"with {LINKED_SQL}, n as (select entity_id, max(mention_type) as kind from linked group by 1) select entity_id, canonical_name as name, coalesce(n.kind, e.entity_type) as kind from local_entities e left join n using (entity_id)",
    "typed_relation_counts": f"select relation_type, count(*) as n from (select upper(trim(relation_type)) as relation_type from ({EDGES_SQL})) where regexp_matches(relation_type, '^[A-Z][A-Z0-9_]*$') group by 1",
    "graph_hints": f"with e as (select * from ({EDGES_SQL}) where regexp_matches(upper(trim(relation_type)), '^[A-Z][A-Z0-9_]*$')), b as (select start_id as entity_id, end_id as other from e union select end_id, start_id from e), k as (select * from b where entity_id in (select 'n' || n_nationkey from nation) qualify row_number() over (partition by entity_id order by other) <= 12) select entity_id, string_agg(other, ',' order by other) as neighbours from k group by 1",
    "pair_candidates": f"""with {LINKED_SQL}, m as (select distinct chunk_id, entity_id, {KIND_SQL} as kind, coalesce(start_char::double, '-inf'::double) as s, greatest(coalesce(start_char::double, '-inf'::double), coalesce(end_char::double, 'inf'::double)) as e from linked where chunk_id is not null and mention_type is not null),
        al as (select distinct ht, tt from (values {ALLOWED}) v(relation, ht, tt)), g as (select h.chunk_id, h.entity_id as head, t.entity_id as tail, greatest(0, greatest(h.s, t.s) - least(h.e, t.e)) as gap, h.s as hs, t.s as ts from m h join m t on h.chunk_id = t.chunk_id and h.entity_id <> t.entity_id join al on h.kind = ht and t.kind = tt)
        select chunk_id, head, tail, gap::bigint as gap, row_number() over (partition by chunk_id order by gap, hs, ts, head, tail) as rank from g where gap <= 2000 qualify rank <= 8""",
    "typed_relations_normalized": f"with {NORMALIZED_SQL.format(t=0.05)} select head, tail, relation, score from normal",
    "edge_set_algebra": f"with {NORMALIZED_SQL.format(t=0.0)}, x as (select distinct head, tail, relation from normal where score >= 0.1), y as (select distinct head, tail, relation from normal where length(head) = 2 or score < 0.1), j as (select coalesce(x.relation, y.relation) as relation, x.head is not null as in_p, y.head is not null as in_g from x full join y on x.head = y.head and x.tail = y.tail and x.relation = y.relation), c as (select relation, count(*) filter (in_p and in_g) as tp, count(*) filter (not in_g) as fp, count(*) filter (not in_p) as fn from j group by 1) select *, {SCORED_SQL} from c",
    "relation_side_weights": f"with {PRED_SQL}, s as (select upper(label) as relation, 'head' as side, head_type as entity_type, (score >= 0.05)::int as g from p union all select upper(label), 'tail', tail_type, (score >= 0.08)::int from p) select relation, side, entity_type, count(*) as n, round(avg(g), 6) as weight from s group by all",
    "score_combination": f"with {PRED_SQL}, x as (select label, score * 10 as a, (ord % 7) / 7.0 as b from p) select label, round(avg(0.3 * a + 0.7 * b), 6) as mean_sum, round(avg(5 * a * b / (4 * a + b + 1e-9)), 6) as mean_f2 from x group by 1",
    "mask_tuning": f"with {PRED_SQL}, x as (select score * 10 as a, (ord % 7) / 7.0 as b, ord % 3 = 0 as gold from p), f as (select 'sum' as form, v as parameter, round(v * a + (1 - v) * b, 9) as s, gold from x, (values (0.0::double), (0.5::double), (1.0::double)) t(v) union all select 'fbeta', v, round((1 + v * v) * a * b / (v * v * a + b + 1e-9), 9), gold from x, (values (0.5::double), (1.0::double), (2.0::double)) t(v)), c as (select form, parameter, th as threshold, count(*) filter (s >= th and gold) as tp, count(*) filter (s >= th and not gold) as fp, count(*) filter (s < th and gold) as fn from f, (values (0.2::double), (0.4::double), (0.6::double)) t(th) group by all) select *, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 6) as f1 from c",
    "score_bands": "select case when l_discount * 10 < 0.15 then 'very_low' when l_discount * 10 < 0.4 then 'low' when l_discount * 10 < 0.7 then 'medium' else 'high' end as band, count(*) as n from lineitem group by 1",
    "span_dedup_best": f"with {SPAN_SQL} select mention_id, chunk_id, start_char, end_char, label from sp qualify row_number() over (partition by chunk_id, start_char, end_char, label order by confidence desc nulls last, mention_id) = 1",
    "span_match_strict": f"with {SPAN_SQL}, x as (select distinct chunk_id, label from sp where extractor = 'gliner'), y as (select distinct chunk_id, label from sp where extractor = 'manual_entry'), j as (select coalesce(x.label, y.label) as label, x.chunk_id is not null as in_p, y.chunk_id is not null as in_g from x full join y on x.chunk_id = y.chunk_id and x.label = y.label), c as (select label, count(*) filter (in_p and in_g) as tp, count(*) filter (not in_g) as fp, count(*) filter (not in_p) as fn from j group by 1) select *, {SCORED_SQL} from c",
    "merged_span_length": f"with {SPAN_SQL}, d as (select distinct chunk_id, start_char, end_char from sp) select chunk_id, m::bigint as merged_chars from {MERGE_SQL.format(t='d')}",
    "masking_metrics": f"with {SPAN_SQL}, {GOLD_SQL}, ps as (select distinct chunk_id, start_char, end_char from sp where chunk_id in (select chunk_id from archive_chunks)), u as (select * from ps union all select * from gs), tx as (select chunk_id, max(length(raw_text)) as chars from archive_chunks group by 1), mp as {MERGE_SQL.format(t='ps')}, mg as {MERGE_SQL.format(t='gs')}, mu as {MERGE_SQL.format(t='u')}, s as (select sum(chars)::bigint as chars, coalesce(sum(mp.m), 0)::bigint as masked, coalesce(sum(mg.m), 0)::bigint as sensitive, coalesce(sum(coalesce(mp.m, 0) + coalesce(mg.m, 0) - mu.m), 0)::bigint as covered from tx left join mp using (chunk_id) left join mg using (chunk_id) left join mu using (chunk_id)) select *, round(covered / sensitive, 6) as ssr, round(covered / masked, 6) as ssp, round(2 * covered / (sensitive + masked), 6) as f1, round(1 - covered / sensitive, 6) as rstr, round(masked / chars, 6) as mcr from s",
    "span_repair": """with t as (select chunk_id, min(raw_text) as t from archive_chunks where raw_text is not null group by 1), g as (select distinct chunk_id, start_char, end_char, label, text from (select chunk_id, e.start as start_char, e."end" as end_char, e.entity_type as label, e.text as text from (select chunk_id, unnest(sensitive_entities) as e from archive_chunks)) where start_char is not null and end_char > start_char and text is not null)
        select chunk_id, start_char, label, text, case when substr(t, start_char + 1, end_char - start_char) = text or substr(t, start_char + 1, end_char - start_char + 1) = text then start_char when start_char > 0 and substr(t, start_char, length(text)) = text then start_char - 1
        when instr(substr(t, greatest(start_char - 80, 0) + 1, length(text) + 160), text) > 0 then greatest(start_char - 80, 0) + instr(substr(t, greatest(start_char - 80, 0) + 1, length(text) + 160), text) - 1 end as repaired_start from g join t using (chunk_id)""",
    "dataset_summary": "with r as (select distinct chunk_id, dataset, length(raw_text)::double as n from archive_chunks) select dataset, count(n) as n, round(avg(n), 6) as mean, round(stddev_samp(n), 6) as std, min(n) as least, round(quantile_cont(n, 0.25), 6) as q1, round(quantile_cont(n, 0.5), 6) as median, round(quantile_cont(n, 0.75), 6) as q3, max(n) as most from r group by 1",
    "label_support": """with g as (select distinct chunk_id, start_char, end_char, label, text from (select chunk_id, e.start as start_char, e."end" as end_char, e.entity_type as label, e.text as text from (select chunk_id, unnest(sensitive_entities) as e from archive_chunks)) where start_char is not null and end_char > start_char) select label, count(*) as spans, count(distinct chunk_id) as chunks, round(avg(end_char - start_char), 6) as mean_chars from g group by 1""",
    "assisted_gold_ids": f"with {COREF_SQL} select mention_id, concat_ws('_', 'gold', lower(mention_type), replace(surface, ' ', '_')) as gold_id from (select *, count(*) over (partition by mention_type, surface) as n from g where not (surface in ({QUOTED(T.AMBIGUOUS)}) or (not contains(surface, ' ') and length(surface) <= 3))) where n >= 2",
    "quota_sample": f"with {PRED_SQL}, r as (select distinct ord::varchar as key, label as family, case when score * 10 < 0.15 then 'very_low' when score * 10 < 0.4 then 'low' when score * 10 < 0.7 then 'medium' else 'high' end as band from p), t as (select *, row_number() over (partition by band, family order by {DICE_SQL.format(k='key')}, key) as turn from r), q as (select *, row_number() over (partition by band order by turn, family, key) as place from t) select key, family, band from q where place <= case band when 'very_low' then 40 when 'low' then 70 when 'medium' then 70 else 20 end",
    "relation_summary": f"with {NORMALIZED_SQL.format(t=0.0)} select relation, count(*) as edges, count(distinct head) as heads, count(distinct tail) as tails, round(avg(score), 6) as mean_score, case relation when 'WORKS_FOR' then 'actor_affiliation' when 'PART_OF' then 'structure' else 'location' end as family from normal group by 1",
    "context_windows": f"""with {COREF_SQL}, t as (select chunk_id, min(raw_text) as t from archive_chunks where chunk_id is not null group by 1), n as (select mention_id, any_value(modality) as modality, any_value(start_char) as s, any_value(end_char) as e from (select distinct mention_id, modality, start_char, end_char from nil_mentions) group by 1),
        x as (select g.*, n.modality, coalesce(t, '') as t, greatest(0, least(coalesce(s::int, 0), length(coalesce(t, '')))) as s, e from g join n using (mention_id) left join t using (chunk_id)), y as (select *, greatest(s, least(coalesce(e::int, s), length(t))) as z from x)
        select mention_id, block_key, md5('Dataset: ' || coalesce(dataset, '') || chr(10) || 'Modality: ' || coalesce(modality, '') || chr(10) || 'Mention type: ' || mention_type || chr(10) || 'Mention: ' || mention_text || chr(10) || 'Context: ' || trim(substr(t, greatest(s - 240, 0) + 1, least(s, 240))) || ' [MENTION] ' || case when trim(substr(t, s + 1, z - s)) <> '' then trim(substr(t, s + 1, z - s)) else mention_text end || ' [/MENTION] ' || trim(substr(t, z + 1, 240))) as digest from y""",
    "qrel_dedup": f"select query_id, query, source_chunk_id from (select distinct query_id, query, source_chunk_id from dense_judgments where query is not null) qualify row_number() over (partition by {FORM_SQL} order by source_chunk_id nulls first, query_id nulls first) = 1",
    "query_ids": f"select distinct source_chunk_id, query, 'q_' || substr(sha1(concat_ws('|', source_chunk_id, {FORM_SQL})), 1, 16) as made_id from (select distinct query_id, query, source_chunk_id from dense_judgments where query is not null)",
    "qrel_validation": r"""with r as (select trim(coalesce(query, '')) as q, trim(coalesce(expected_relevant_information, '')) as e, trim(coalesce(rationale, '')) as a, trim(coalesce(evaluation_strategy, '')) as t, trim(coalesce(relevance_label, '')) as l, coalesce(judgment_status = 'failed', false) as x from dense_judgments),
        s as (select unnest(case when x then ['model_rejected'] else list_filter([case when length(q) < 15 then 'query_too_short' end, case when regexp_matches(q, '(?i)\b(this|the) (passage|chunk|document|article|transcript|text|source|page|image|video)\b') then 'query_mentions_source_frame' end, case when length(e) < 30 then 'expected_information_too_short' end, case when len(regexp_extract_all(e, '\S+')) < 5 then 'expected_information_not_self_contained' end, case when a = '' then 'missing_reference_answer' end, case when t = '' then 'missing_query_type' end, case when l = '' then 'missing_difficulty' end], lambda y: y is not null) end) as reason from r) select reason, count(*) as n from s group by 1""",
    "split_dev_test": f"with r as (select distinct document_id, coalesce(dataset, 'none') as dataset from archive_documents), n as (select *, count(*) over (partition by dataset) as c, row_number() over (partition by dataset order by {DICE_SQL.format(k='document_id')}, document_id) as r from r) select document_id, dataset, case when r <= (case when c > 1 then greatest(1, least(round_even(c * 0.3, 0), c - 1)) else round_even(c * 0.3, 0) end) then 'dev' else 'test' end as split from n",
    "stratified_sample": f"with r as (select distinct document_id, coalesce(dataset, 'none') as dataset from archive_documents), k as (select greatest(1, 60 // greatest(count(distinct dataset), 1)) as base from r), n as (select r.*, {DICE_SQL.format(k='document_id')} as d, row_number() over (partition by dataset order by {DICE_SQL.format(k='document_id')}, document_id) as r from r) select document_id, dataset from n, k order by (r > base)::int, d, document_id limit 60",
    "incremental_resume": "select distinct chunk_id, dataset from archive_chunks where chunk_id is not null and chunk_id not in (select chunk_id from embedded_text where dense is not null and chunk_id is not null)",
    "late_documents": "select date_trunc('month', created_at)::timestamp as month, count(*) as n, count(*) filter (ingested_at > created_at + interval 7 day) as late from documents where created_at is not null group by 1",
    "unique_violations": "select chunk_id, count(*) as n from archive_chunks group by 1 having count(*) > 1",
}

QUERIES = {f.__name__: f for f in (text_normalize, word_windows, stable_ids, vector_point_ids, text_quality, public_candidates, candidate_summary, archive_skeleton_nodes, archive_skeleton_edges, graph_statistics, connected_mentions, transcript_turns, speaker_counts, ocr_lines, surface_block_keys, coref_blocks, exact_surface_clusters, agglomerative_coref, pairwise_coref, purity, nil_summary, chunk_entity_edges, surface_containment, entity_aliases, entity_upsert, typed_relation_counts, graph_hints, pair_candidates, typed_relations_normalized, edge_set_algebra, relation_side_weights, score_combination, mask_tuning, score_bands, span_dedup_best, span_match_strict, span_match_relaxed, span_mismatches, merged_span_length, masking_metrics, masked_chunks, span_repair, dataset_summary, label_support, assisted_gold_ids, quota_sample, relation_summary, context_windows, document_chunks, token_windows, rule_extraction, query_terms, qrel_dedup, query_ids, qrel_validation, split_dev_test, stratified_sample, incremental_resume, late_documents, unique_violations)}

"""Queries over mappers, mentions, the graph, relations, masking and drivers, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archipel.functions import text as T
from archipel.operators import chunking, coreference, drivers, evaluation, extract, graph, masking, qrels, records, relations, retrieval, spans
from archipel.plans import archive as A
from archipel.plans import search as S
from archipel.session import checkpoint, table
from archipel.sources import tables


def chunk_texts(spark, d) -> DataFrame:
    return A.chunks(spark, d).where("raw_text is not null and chunk_id is not null").groupBy("chunk_id").agg(F.min("raw_text").alias("raw_text"))


def with_offsets(spark, d) -> DataFrame:
    return chunk_texts(spark, d).withColumn("offsets", T.token_offsets(F.col("raw_text")))


# text and mappers
def token_spans(spark, d):
    """Recorded spans as inclusive token spans, by overlap and by counting."""
    rows = A.gold_spans(spark, d).select("chunk_id", "start_char", "end_char").distinct().join(chunk_texts(spark, d), "chunk_id").withColumn("o", T.token_offsets(F.col("raw_text")))
    a, b = T.token_span(F.col("o"), F.col("start_char"), F.col("end_char")), T.token_span_sorted(F.col("o"), F.col("start_char"), F.col("end_char"))
    return rows.select("chunk_id", "start_char", "end_char", a["first"].cast("bigint").alias("first"), a["last"].cast("bigint").alias("last"), b["first"].cast("bigint").alias("first_counted"), b["last"].cast("bigint").alias("last_counted"))


def labels(spark, d):
    """Every label form there is of mention types, recorded entity types and sensitivity levels."""
    kinds = A.mentions(spark, d).select("mention_type").union(A.gold_spans(spark, d).select("label")).union(spark.createDataFrame([("Law or regulation",), ("PRODUCT/OR-BRAND",), ("creative work, title",), ("no_mask PERSON",), ("DATETIME",)], "x string")).distinct()
    k = F.col("mention_type")
    who = F.concat(F.lit("direct "), k)
    return kinds.where(k.isNotNull()).select(k.alias("label"), T.mention_label(k).alias("mention_label"), T.semantic_label(k).alias("semantic"), T.policy_label(k, F.lit("quasi")).alias("policy"), T.policy_label(k, F.lit("quasi"), True).alias("policy_compact"), T.policy_type(who).alias("policy_type"), T.policy_is_sensitive(who).alias("sensitive"), T.gold_slug(k).alias("slug"))


def model_slugs(spark, d):
    rows = table(spark, d, "dense_judgments").select("judge_model").distinct()
    return rows.select("judge_model", T.model_slug(F.col("judge_model")).alias("slug"), evaluation.judge_name(F.col("judge_model")).alias("judge"), T.masking_id(F.lit("a"), F.col("judge_model")).alias("id"))


def coerced(spark, d):
    rows = table(spark, d, "dense_judgments").select("record_id", "relevance_score", "contains_expected_information", "missing_information").distinct()
    return rows.select("record_id", T.as_int(F.concat(F.col("relevance_score").cast("string"), F.lit(".0"))).alias("score"), T.as_bool(F.col("contains_expected_information")).alias("flag"), F.size(T.as_list(F.col("missing_information"))).cast("bigint").alias("n_listed"))


def article_documents(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select(F.when(F.col("doc_id") % 3 != 0, F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("article"), F.col("title").alias("highlights"))
    return records.articles(rows).select("document_id", "source_id", "title", F.md5("raw_text").alias("digest"), "summary")


def transcript_documents(spark, d):
    """Transcripts taken apart into speakers and utterances and put together again."""
    rows = A.documents(spark, d).where("dataset = 'mediasum' and raw_text is not null").select(F.col("document_id").alias("id"), "title", "summary", F.split("raw_text", "\n").alias("l")).distinct()
    who, what = F.transform("l", lambda x: F.regexp_extract(x, "^([^:]{1,80}): ", 1)), F.transform("l", lambda x: F.regexp_replace(x, "^[^:]{1,80}: ", ""))
    made = records.transcripts(rows.select("id", "title", "summary", F.lit(None).cast("string").alias("document"), who.alias("speaker"), what.alias("utt")))
    return made.select("document_id", "source_id", "title", F.md5("raw_text").alias("digest"))


def video_documents(spark, d):
    rows = A.documents(spark, d).where("dataset = 'msr_vtt' and raw_text is not null").select("document_id", F.posexplode(F.split("raw_text", "\n")).alias("sen_id", "line")).distinct()
    parts = rows.select(F.col("document_id").alias("video_id"), "sen_id", F.regexp_extract("line", r"\[([\d.]+)s?-", 1).try_cast("double").alias("start_time"), F.regexp_extract("line", r"-([\d.]+)s?\]", 1).try_cast("double").alias("end_time"), F.regexp_replace("line", r"^[^\]]*\]:?\s*", "").alias("caption"))
    return records.videos(parts).select("document_id", "source_id", "title", F.md5("raw_text").alias("digest"), F.md5("summary").alias("summary_digest"))


def page_words(spark, d):
    """Words of scanned lines with boxes beside each other; every fourth word is poorly recognised."""
    found = A.chunks(spark, d).select("chunk_id", F.explode(F.regexp_extract_all("raw_text", F.lit(r"OCR Line \d+ \[\d+,\d+,\d+,\d+\]: ?[^\n]*"), 0)).alias("l")).distinct()
    part = lambda k: F.regexp_extract("l", r"OCR Line (\d+) \[(\d+),(\d+),(\d+),(\d+)\]: ?([^\n]*)", k)
    rows = found.select(F.col("chunk_id").alias("page_key"), part(1).cast("int").alias("line_no"), part(2).cast("int").alias("x"), part(3).cast("int").alias("top"), F.posexplode(F.split(part(6), " ")).alias("i", "text"))
    return rows.select("page_key", (F.col("line_no") % 3).alias("block"), F.lit(1).alias("par"), "line_no", (F.col("x") + 7 * F.col("i")).alias("left"), "top", F.lit(5).alias("width"), F.lit(9).alias("height"), "text", (F.when(F.col("i") % 4 == 3, 20.0).otherwise(80.0)).alias("conf"))


def page_lines(spark, d):
    return records.ocr_lines(page_words(spark, d)).select("page_key", F.col("line").cast("bigint").alias("line"), F.md5("projected").alias("digest"))


def page_documents(spark, d):
    return records.pages(records.ocr_lines(page_words(spark, d))).select("document_id", "source_id", F.md5("raw_text").alias("digest"))


def rebased_windows(spark, d):
    rows = with_offsets(spark, d).select("chunk_id", F.explode(chunking.rebased_windows(F.col("offsets"), 120, 30)).alias("w"), "raw_text")
    whole = F.md5(F.regexp_replace(F.substr("raw_text", F.col("w.char_start") + 1, F.col("w.char_end") - F.col("w.char_start")), r"[\s\x0b\x1c-\x1f\x85]+", " "))
    return rows.select("chunk_id", F.col("w.window").cast("bigint").alias("window"), F.col("w.start_token").cast("bigint").alias("start_token"), F.col("w.end_token").cast("bigint").alias("end_token"), F.md5(F.array_join("w.tokens", " ")).alias("digest"), (whole == F.md5(F.array_join("w.tokens", " "))).alias("rebased_right"))


def window_diagnostics(spark, d):
    """Tokens and mention windows per chunk, by dataset and modality."""
    rows = A.chunks(spark, d).where("chunk_id is not null").groupBy("chunk_id").agg(F.min(F.struct("dataset", "modality", F.coalesce("masked_text", "raw_text", F.lit("")).alias("t"))).alias("c")).select("c.*")
    n = T.word_count(F.col("t"))
    rows = rows.select("dataset", "modality", n.alias("n"), F.when(n > 0, F.greatest(F.lit(1), F.ceil((n - 80) / 240))).otherwise(0).alias("w"))
    return rows.groupBy("dataset", "modality").agg(F.count("*").alias("chunks"), F.round(F.avg("n"), 6).alias("mean_tokens"), F.max("n").cast("bigint").alias("most_tokens"), F.round(F.avg("w"), 6).alias("mean_windows"), F.max("w").cast("bigint").alias("most_windows"))


# benchmark records
def benchmark(spark, d):
    m = F.transform("sensitive_entities", lambda e: F.struct(e["entity_type"].alias("entity_type"), F.when(e["sensitivity_level"] == "S3", "DIRECT").when(e["sensitivity_level"] == "S2", "QUASI").otherwise("NO_MASK").alias("identifier_type"), e["text"].alias("text"), e["start"].alias("start"), e["end"].alias("end")))
    split = F.when(F.conv(F.substring(F.md5("document_id"), 1, 4), 16, 10).cast("int") % 10 < 6, "Train").when(F.conv(F.substring(F.md5("document_id"), 1, 4), 16, 10).cast("int") % 10 < 8, "dev").otherwise("test")
    return A.chunks(spark, d).select("chunk_id", "raw_text", split.alias("split"), m.alias("mentions"))


def benchmark_quality(spark, d):
    return records.benchmark_records(benchmark(spark, d)).groupBy(F.lower("split").alias("split"), "has_sensitive").agg(F.count("*").alias("records"), F.sum("sensitive_spans").alias("sensitive"), F.sum("gold_spans").alias("spans"))


def benchmark_labels(spark, d):
    return records.label_summary(records.benchmark_records(benchmark(spark, d)))


def benchmark_splits(spark, d):
    parts = qrels.split_by_label(records.benchmark_records(benchmark(spark, d)), "split")
    out = None
    for name, rows in parts.items():
        part = rows.select(F.lit(name).alias("split"), "chunk_id")
        out = part if out is None else out.union(part)
    return out


def training_records(spark, d):
    return records.training_records(records.benchmark_records(benchmark(spark, d)), True).select("chunk_id", F.size("tokens").alias("n_tokens"), F.to_json("ner").alias("ner"))


# graph
def document_nodes(spark, d):
    rows = A.chunks(spark, d).where("chunk_id is not null and document_id is not null")
    return graph.document_nodes(rows).select("document_id", "n_chunks", "dataset", "source_id")


def mention_nodes(spark, d):
    t = graph.mention_tables(A.mentions(spark, d))
    return t["mentions"].groupBy(F.lit("node").alias("kind"), "mention_type").agg(F.count("*").alias("n")).union(t["edges"].agg(F.lit("edge"), F.lit("HAS_MENTION"), F.count("*")))


def link_rows(spark, d):
    """What a linker could have said of every mention: the entity whose name it writes, or one of the names for nothing."""
    e = table(spark, d, "local_entities").select("entity_id", "canonical_name", T.surface(F.col("canonical_name")).alias("surface"))
    m = A.mentions(spark, d).select("mention_id", "mention_text", "mention_type", "confidence").distinct().withColumn("surface", T.surface(F.col("mention_text")))
    nothing = F.when(F.length("surface") % 2 == 0, "NIL").otherwise(" q-1 ")
    return m.join(e, "surface", "left").select("mention_id", "mention_text", "mention_type", F.coalesce("entity_id", nothing).alias("external_id"), F.col("canonical_name").alias("title"), F.col("confidence").alias("link_score"), F.concat_ws("|", "mention_id", "mention_text", "mention_type", F.col("confidence").cast("string")).alias("ord"))


def canonicalized_mentions(spark, d):
    a = graph.canonicalized(link_rows(spark, d), least=0.5)["audit"]
    return a.groupBy("status", "canonical_name").agg(F.count("*").alias("mentions"), F.min("entity_id").alias("entity_id"))


def canonical_entities(spark, d):
    old = table(spark, d, "local_entities").where("entity_type = 'ORG'").select(T.stable_id(F.lit("entity"), F.lit("wikidata"), F.col("entity_id")).alias("entity_id"))
    return graph.canonicalized(link_rows(spark, d), old, 0.5)["entities"].select("entity_id", "external_kb_id", "canonical_name", "entity_type")


def resolved(spark, d):
    """Mentions with the entity they were resolved to, from the two ways there are: by an unchanged name, or in capitals."""
    e = table(spark, d, "local_entities").select("entity_id", "canonical_name", T.surface(F.col("canonical_name")).alias("surface"))
    m = A.typed_mentions(spark, d).select("mention_id", "chunk_id", "document_id", "dataset", "modality", "mention_text", "mention_type", "start_char", "end_char", T.surface(F.col("mention_text")).alias("surface")).distinct()
    source = F.when(F.col("mention_text") == F.col("canonical_name"), "refined").otherwise("local_coreference")
    return m.join(e, "surface").withColumn("source", source).drop("surface")


def local_clusters(spark, d):
    p = resolved(spark, d).withColumn("min_similarity", F.lit(1.0)).withColumn("mean_similarity", F.length("mention_text") / 100).withColumn("block_key", F.substring("canonical_name", 1, 4)).withColumn("status", F.lit("CLUSTERED")).withColumn("ord", F.concat_ws("|", "mention_id", "mention_text", "mention_type"))
    c = graph.local_export(p)["clusters"]
    return c.select("entity_id", "canonical_name", "entity_type", F.array_join("aliases", "|").alias("aliases"), "cluster_size", "n_documents", F.array_join("datasets", "|").alias("datasets"))


def clean_resolved(spark, d):
    return relations.cleaned_mentions(resolved(spark, d)).select("chunk_id", "mention_id", "entity_id", "mention_type", "entity_label")


def mentions_to_link(spark, d):
    """Mentions with their chunk's text that are not linked yet: those of a name in the graph are."""
    done = A.linked(spark, d).select("mention_id")
    left = A.mentions(spark, d).where("mention_id is not null").select("mention_id", "chunk_id").distinct().join(done.distinct(), "mention_id", "left_anti")
    return left.join(chunk_texts(spark, d), "chunk_id", "left").select("mention_id", "chunk_id", F.length("raw_text").cast("bigint").alias("n_chars"))


def mention_spans(spark, d):
    """Resolved mentions with the recorded spans of their chunk that they equal in text."""
    g = A.gold_spans(spark, d).where("text is not null").select("chunk_id", F.col("text").alias("mention_text"), F.col("start_char").alias("span_start")).distinct()
    return resolved(spark, d).select("mention_id", "chunk_id", "mention_text", "entity_id").distinct().join(g, ["chunk_id", "mention_text"], "left")


def typed_chain(spark, d):
    e = A.entity_chain(spark, d)
    kind = F.when(F.conv(F.substring(F.md5("relation_id"), 1, 2), 16, 10).cast("int") % 2 == 0, "WORKS_FOR").otherwise("PART_OF")
    return e.select("start_id", "end_id", kind.alias("relation_type"))


def query_expansion(spark, d):
    """Queries that name an entity, expanded by its spellings and neighbours."""
    m = A.linked(spark, d).join(A.mentions(spark, d).select("mention_id", "mention_text").distinct(), "mention_id").select("entity_id", "mention_text").distinct()
    e = table(spark, d, "local_entities")
    q = table(spark, d, "dense_judgments").where("query is not null").select("query_id", "query").distinct().union(e.select(F.concat(F.lit("e_"), "entity_id"), F.concat(F.lit("What did "), "canonical_name", F.lit(" decide?"))))
    x = graph.expanded_queries(q, e, m, typed_chain(spark, d))
    return x.select("query_id", F.array_join("hint_terms", "|").alias("hint_terms"), F.array_join("relation_phrases", "|").alias("relation_phrases"), F.size("expanded_queries").cast("bigint").alias("variants"), F.md5(F.element_at("expanded_queries", -1)).alias("last_digest"))


# relations
def token_mentions(spark, d):
    """Clean mentions with their tokens, written once: the plans on them read them many times."""
    m = relations.cleaned_mentions(resolved(spark, d)).select("chunk_id", "mention_id", "entity_id", "mention_type", "mention_text", "start_char", "end_char")
    o = chunk_texts(spark, d).select("chunk_id", F.transform(T.token_offsets(F.col("raw_text")), lambda t: t.dropFields("token")).alias("offsets"))
    return checkpoint(relations.with_tokens(m, o))


def relation_chunk_inputs(spark, d):
    x = relations.chunk_inputs(token_mentions(spark, d), relations.relation_schema(spark))
    return x.select("chunk_id", F.col("n_entities").cast("bigint").alias("n_entities"), F.array_join(F.transform("ner", lambda m: m["mention_id"]), ",").alias("mentions"), F.array_join(F.transform("ner", lambda m: m["token_start"].cast("string")), ",").alias("starts"))


def relation_pair_windows(spark, d):
    m = token_mentions(spark, d)
    schema = relations.relation_schema(spark)
    near = relations.pair_candidates(m.select("chunk_id", "entity_id", F.col("mention_type").alias("kind"), F.col("token_start").alias("start_char"), (F.col("token_end") + 1).alias("end_char")), schema, 8, 96)
    n = chunk_texts(spark, d).select("chunk_id", T.word_count(F.col("raw_text")).alias("n_tokens"))
    return relations.pair_windows(near, m, n, relations.allowed_by_pair(spark))


def mask_windows(spark, d):
    w = with_offsets(spark, d).select("chunk_id", F.explode(chunking.rebased_windows(F.col("offsets"))).alias("w"))
    p = A.gold_spans(spark, d).groupBy("chunk_id", "start_char", "end_char").agg(F.min("label").alias("label")).withColumn("mention_id", F.concat_ws("-", "chunk_id", "start_char", "end_char"))
    return relations.window_inputs(w, p).select("chunk_id", F.col("window").cast("bigint").alias("window"), "input_id", F.col("n_spans").cast("bigint").alias("n_spans"))


def model_relations(mentions, most: int | None = 40):
    """What a relation model could have said of whole-chunk inputs of ``mentions``: every two mentions in a row are related.
    Scores fall to 0.2 by the fortieth, not below, so no later one is lost to a threshold for its place."""
    ner = checkpoint(relations.input_records(mentions, relations.relation_schema(mentions.sparkSession), most))
    nxt = Window.partitionBy("input_id").orderBy("ner_index")
    s, e = F.lead("token_start").over(nxt), F.lead("token_end").over(nxt)
    p = ner.select("input_id", F.col("ner_index").alias("ord"), F.col("token_start").alias("head_start"), (F.col("token_end") + F.col("ner_index") % 2).alias("head_end"), s.alias("tail_start"), (e + 1).alias("tail_end"), F.when(F.col("ner_index") % 2 == 0, "works for").otherwise("part of").alias("label"), F.greatest(F.lit(1.0) - F.col("ner_index") / 50, F.lit(0.2)).alias("score")).where("tail_start is not null")
    return p, ner


def relation_endpoints(spark, d):
    p, ner = model_relations(token_mentions(spark, d))
    return relations.endpoints(p, ner).select("input_id", F.col("ord").cast("bigint").alias("ord"), "head_mention_id", "tail_mention_id")


def relation_edges(spark, d):
    """Edges of all chunks, however many entities they have."""
    p, ner = model_relations(token_mentions(spark, d), None)
    return relations.validated(relations.endpoints(p, ner), relations.relation_schema(spark)).select("head", "relation", "tail", F.round("score", 6).alias("score"))


def sweep_edges(spark, d):
    rows = relations.normalized(A.predictions(spark, d), relations.relation_schema(spark), 0.0)
    more = rows.withColumn("family", F.when(F.col("relation") == "LOCATED_IN", "location").otherwise("other")).withColumn("ord", F.concat_ws("|", "head", "tail", "relation")).withColumn("score", F.col("score") * 10)
    return more, more.where("length(head) = 2 or score < 0.5")


def relation_sweep(spark, d):
    p, g = sweep_edges(spark, d)
    return relations.threshold_sweep(p, g, [0.15, 0.4, 0.7], ["relation", "family"])


def relation_threshold(spark, d):
    p, g = sweep_edges(spark, d)
    return relations.selected_threshold(relations.threshold_sweep(p, g, [0.05, 0.15, 0.4, 0.7], []).where("group_field = 'overall'"), 0.3).select("threshold", "precision", "recall", "f1")


def relation_chunk_statistics(spark, d):
    x = relations.chunk_statistics(relations.cleaned_mentions(resolved(spark, d)), relations.relation_schema(spark))
    return x.select("chunk_id", "entity_count", "valid_pairs", F.array_join("entity_types", "|").alias("entity_types"), F.array_join("families", "|").alias("families"), "has_refined", "has_local", "mixed", "promising_score")


def sampled_relation_chunks(spark, d):
    x = relations.chunk_statistics(relations.cleaned_mentions(resolved(spark, d)), relations.relation_schema(spark)).withColumn("primary_family", F.element_at("families", 1))
    return qrels.sample_chunks(x, 12, 12).select("chunk_id", "document_id", "split", "primary_family")


def relation_annotations(spark, d):
    m = token_mentions(spark, d)
    p, ner = model_relations(m)
    edges = relations.endpoints(p, ner).select(F.col("input_id").alias("chunk_id"), F.col("head_entity_id").alias("head"), F.col("label").alias("relation"), F.col("tail_entity_id").alias("tail"), "score")
    x = relations.annotation_records(chunk_texts(spark, d).withColumnRenamed("raw_text", "text"), m, edges)
    return x.select("chunk_id", F.size("mentions").alias("n_mentions"), F.size("predictions").alias("n_predictions"), F.md5("text").alias("digest"))


# masking
def mask_mentions(spark, d):
    """Mentions of the catalogue as mask predictions, with the gold target of the recorded span they overlap most."""
    p = A.span_rows(spark, d).groupBy("mention_id", "chunk_id").agg(F.min(F.struct("start_char", "end_char", "label", "confidence")).alias("m")).select("mention_id", "chunk_id", "m.*")
    g = A.gold_spans(spark, d).select("chunk_id", "start_char", "end_char", (F.col("label") != "PERSON_NAME").cast("int").alias("target"), F.concat_ws("|", F.lpad(F.col("start_char").cast("string"), 9, "0"), F.lpad(F.col("end_char").cast("string"), 9, "0"), "label").alias("ord")).distinct()
    return spans.best_target(p, g, "chunk_id", "mention_id").select("mention_id", "chunk_id", "start_char", "end_char", F.col("label").alias("mention_type"), F.col("confidence").alias("policy"), "gold_target")


def gold_targets(spark, d):
    return mask_mentions(spark, d).select("mention_id", "chunk_id", F.col("gold_target").cast("bigint").alias("gold_target")).where("gold_target is not null")


def mask_relations(spark, d):
    """Mentions of a chunk that follow each other are related."""
    w = Window.partitionBy("chunk_id").orderBy("start_char", "end_char", "mention_id")
    m = mask_mentions(spark, d)
    rows = m.select(F.lit("associated with").alias("relation"), F.col("mention_id").alias("head_id"), F.col("mention_type").alias("head_type"), F.lead("mention_id").over(w).alias("tail_id"), F.lead("mention_type").over(w).alias("tail_type"))
    return rows.where("tail_id is not null")


def mask_weights(spark, d):
    m, r = mask_mentions(spark, d), mask_relations(spark, d)
    side = lambda s: m.select(F.col("mention_id").alias(f"{s}_id"), F.col("gold_target").cast("boolean").alias(f"{s}_gold"))
    return relations.side_weights(r.join(side("head"), "head_id").join(side("tail"), "tail_id")).where("weight is not null")


def mention_relation_scores(spark, d):
    m = mask_mentions(spark, d)
    return masking.relation_scores(m, mask_relations(spark, d), mask_weights(spark, d), masking.type_priors(m)).select("mention_id", F.round("relation_score", 5).alias("relation_score"))


def mask_strategies(spark, d):
    """The three masking strategies, fitted and applied: what each would mask."""
    m, r, g = mask_mentions(spark, d).persist(), mask_relations(spark, d).persist(), A.gold_spans(spark, d).select("chunk_id", "start_char", "end_char").distinct()
    out = None
    for name in ("policy", "semantic", "both"):
        model = masking.fitted(m, r, g, name, [0.1, 0.3, 0.5, 0.7])
        part = masking.applied(m, r, model).where(F.col("sensitivity") >= model["threshold"]).agg(F.lit(name).alias("strategy"), F.lit(float(model["threshold"])).alias("threshold"), F.count("*").alias("masked"))
        out = part if out is None else out.union(part)
    return out


def detection_sweep(spark, d):
    p = A.span_rows(spark, d).select("chunk_id", "start_char", "end_char", F.col("confidence").alias("score"))
    return spans.detection(p, A.gold_spans(spark, d), "chunk_id", [0.0, 0.25, 0.5, 0.75])


# coreference
def coref_sweep(spark, d):
    gold = A.mentions(spark, d).groupBy("mention_id").agg(coreference.cluster_id(F.max(F.lower("normalized_mention_text"))).alias("gold"))
    return coreference.threshold_sweep(A.coref_rows(spark, d), gold, [0.75, 0.85, 0.95])


def coref_gold_summary(spark, d):
    rows = A.typed_mentions(spark, d).select("mention_id", "mention_text", "mention_type", F.lower("normalized_mention_text").alias("gold_id")).distinct()
    return coreference.gold_summary(rows)


def linkable_summary(spark, d):
    rows = link_rows(spark, d).select("mention_id", F.col("external_id").alias("gold_entity"))
    return coreference.linkable_summary(rows, "mention_id")


def annotated_mentions(spark, d):
    given = A.assisted_gold_ids(spark, d).groupBy("mention_id").agg(F.max("gold_id").alias("gold_id"))
    rows = A.mentions(spark, d).select("mention_id", "mention_text").distinct()
    return coreference.with_annotations(rows, given)


def sampled_mentions(spark, d):
    rows = A.coref_rows(spark, d)
    return qrels.sample_groups(rows, ["mention_type", "surface"], 60, strata=["dataset", "mention_type"]).select("mention_id", "mention_type", "surface", "split")


def candidate_queue(spark, d):
    """Query candidates with a reserve, an even share per dataset and length."""
    rows = A.quality_rows(spark, d).where("chunk_id is not null").groupBy("chunk_id").agg(F.min(F.struct(F.coalesce("dataset", F.lit("none")).alias("dataset"), "length_bucket")).alias("q")).select("chunk_id", "q.*")
    return qrels.stratified_sample(rows, ["dataset", "length_bucket"], "chunk_id", 15, reserve=4)


# mention evaluation
def mention_sweep(spark, d):
    """Strict mention metrics at several thresholds, overall and by dataset and modality."""
    rows = A.mentions(spark, d).where("chunk_id is not null and start_char is not null and end_char is not null").select("chunk_id", "start_char", "end_char", F.upper("mention_type").alias("label"), "dataset", "modality", "confidence", "extractor").where("label is not null")
    p, g = rows.where("extractor = 'gliner'"), rows.where("extractor = 'manual_entry'")
    return spans.threshold_sweep(p, g, ["chunk_id", "label"], [0.3, 0.6, 0.9], ["dataset", "modality"], "confidence")


# retrieval records
def result_records(spark, d):
    r = retrieval.results(S.dense_list(spark, d, 5), A.chunks(spark, d), "dense")
    return r.select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), "score", "document_id", F.md5("retrieval_text").alias("digest"), F.length("preview").cast("bigint").alias("n_preview"))


def compact_records(spark, d):
    r = retrieval.compact_records(retrieval.results(S.dense_list(spark, d, 5), A.chunks(spark, d), "dense"))
    return r.select("query_id", F.size("results").cast("bigint").alias("n"), F.array_join(F.transform("results", lambda x: x["chunk_id"]), "|").alias("chunks"))


def results_with_qrels(spark, d):
    j = table(spark, d, "dense_judgments")
    r = j.select("query_id", "chunk_id", "evaluation_strategy").distinct()
    return evaluation.with_qrels(r, j.select("query_id", "expected_relevant_information", "source_chunk_id")).groupBy("evaluation_strategy").agg(F.count("*").alias("results"), F.count_if("is_source_chunk").alias("sources"), F.count_if(F.col("expected_relevant_information").isNull()).alias("without"))


def strategy_latency(spark, d):
    """Metrics of strategies with how long their judgments took to be loaded."""
    j = table(spark, d, "dense_judgments").dropDuplicates(["record_id"])
    took = F.expr("cast(cast(loaded_at - judged_at as interval second) as decimal(18, 6))")
    per = evaluation.latency(j.where("loaded_at is not null and judged_at is not null"), "evaluation_strategy", took)
    return evaluation.with_latency(S.ensemble_metrics(spark, d), per)


def judgment_cache(spark, d):
    rows = evaluation.cached_judgments(table(spark, d, "dense_judgments").dropDuplicates(["record_id"]))
    return rows.groupBy("evaluation_strategy").agg(F.count("*").alias("n"), F.min("record_id").alias("first"), F.max("record_id").alias("last"))


def judgment_log(spark, d):
    rows = evaluation.last_valid(table(spark, d, "dense_judgments").dropDuplicates(["record_id"]))
    return rows.groupBy("judge_model", "evaluation_strategy").agg(F.count("*").alias("n"), F.sum("relevance_score").alias("total"), F.sum("record_id").alias("ids"))


def first_queries(spark, d):
    j = table(spark, d, "dense_judgments").where("query_id is not null").select("query_id", "chunk_id", "record_id").distinct()
    return qrels.first_queries(j, 20, "record_id").groupBy("query_id").agg(F.count("*").alias("n"))


# drivers
def ablation_runs(spark, d):
    v = S.embedded(spark, d)
    q = v.where(S.ASKED).select(F.col("chunk_id").alias("query_id"), "dense")
    p = retrieval.sparse_vectors(table(spark, d, "embedded_text"))
    sparse = lambda asked, k: retrieval.sparse_topk(p.withColumnRenamed("chunk_id", "query_id").join(asked.select("query_id"), "query_id", "left_semi"), p, k)
    done = q.where("substring(query_id, 1, 1) < '4'").select(F.lit("dense").alias("strategy"), "query_id", F.lit(5).alias("top_k"))
    return drivers.ablation(q, {"dense": lambda asked, k: retrieval.dense_topk(asked, v, k), "sparse": sparse}, 5, done).select("strategy", "query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), "score")


def judged_runs(spark, d):
    j = table(spark, d, "dense_judgments")
    r = j.select(F.col("evaluation_strategy").alias("strategy"), "query_id", "chunk_id", "rank").distinct().join(chunk_texts(spark, d).withColumnRenamed("raw_text", "text"), "chunk_id")
    q = j.select("query_id", "expected_relevant_information", "source_chunk_id")
    out = drivers.judged(r, q, {"overlap": extract.overlap_judge, "strict": lambda f: [min(3, max(0, s - 1)) for s in extract.overlap_judge(f)]})
    return out.groupBy("judge_model", "strategy", "judgment_status").agg(F.count("*").alias("n"), F.round(F.avg("relevance_score"), 4).alias("mean_score"))


def generated_qrels(spark, d):
    c = A.chunks(spark, d).where("chunk_id is not null and raw_text is not null").groupBy("chunk_id").agg(F.min("raw_text").alias("text")).withColumn("candidate_rank", F.conv(F.substring(F.md5("chunk_id"), 1, 7), 16, 10).cast("bigint"))
    g = drivers.generated_qrels(c, extract.lead_query, 40)
    return g["accepted"].select("query_id", "source_chunk_id", "query", "difficulty")


def unembedded(spark, d):
    have = table(spark, d, "embedded_text").where("dense is not null")
    x = extract.embedded_new(A.chunks(spark, d), have)
    return x.select("chunk_id", "point_id", F.size("dense").alias("dim"), F.size("sparse_indices").alias("terms"))


def stored_points(spark, d):
    return tables.existing(A.chunks(spark, d), table(spark, d, "embedded_text"), "chunk_id")


def sensitive_load(spark, d):
    """The first documents whose texts fit a million bytes."""
    rows = A.documents(spark, d).where("raw_text is not null").groupBy("document_id").agg(F.min("raw_text").alias("raw_text"))
    return tables.within_bytes(rows, "raw_text", 100_000, "document_id").select("document_id")


NORM = lambda c: f"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), '\\r\\n?', chr(10), 'g'), '\\\\([''"])', '\\1', 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"""
ID = lambda *parts: f"substr(sha256(concat_ws('::', {', '.join(parts)})), 1, 24)"
TEXTS = "tx as (select chunk_id, min(raw_text) as raw_text from archive_chunks where raw_text is not null and chunk_id is not null group by 1)"
GOLD = """gs as (select distinct chunk_id, start_char, end_char, label, text from (select chunk_id, e.start as start_char, e."end" as end_char, e.entity_type as label, e.text as text from (select chunk_id, unnest(sensitive_entities) as e from archive_chunks)) where start_char is not null and end_char > start_char)"""
N = "len(regexp_extract_all({x}, '\\S+'))"
# tokens that end at or before a place, and tokens that begin before one
ENDED = f"({N.format(x='substr(raw_text, 1, {p})')} - case when regexp_matches(substr(raw_text, {{p}}, 1), '\\S') and regexp_matches(substr(raw_text, {{p}} + 1, 1), '\\S') then 1 else 0 end)"
BEGUN = N.format(x="substr(raw_text, 1, {p})")
TOKENS = f"{ENDED.format(p='start_char')} as fc, {BEGUN.format(p='end_char')} - 1 as lc, {N.format(x='raw_text')} as nt"
RESOLVED = f"""re as (select distinct m.mention_id, m.chunk_id, m.document_id, m.dataset, m.modality, m.mention_text, {A.KIND_SQL} as mention_type, m.start_char, m.end_char, e.entity_id, e.canonical_name, case when m.mention_text = e.canonical_name then 'refined' else 'local_coreference' end as source
    from nil_mentions m join (select *, {A.surface_sql('canonical_name')} as surface from local_entities) e on {A.surface_sql('mention_text')} = e.surface)"""
SCHEMA = f"al as (select * from (values {', '.join(f'({r!r}, {f!r}, {h!r}, {t!r})' for r, f, h, t in relations.schema_rows())}) v(relation, family, ht, tt))"
TYPES = ", ".join(f"'{t}'" for t in sorted({t for _, _, h, tl in relations.SCHEMA for t in h + tl}))
GENERIC = f"""(s is null or s = '' or s in ({A.QUOTED(T.PRONOUNS + T.GENERIC + T.ROLES)}) or (mention_type = 'PERSON' and (regexp_matches(s, '^(a|an|another|her|his|my|other|our|some|their|your) ') or string_split(s, ' ')[-1] in ({A.QUOTED(T.ROLES + T.PERSON_WORDS)})))
    or (mention_type in ('ORGANIZATION', 'ORG', 'POLITICAL_GROUP') and (regexp_matches(s, '^(a|an|another|other|some) ') or string_split(s, ' ')[-1] in ('authorities', 'center', 'commission', 'entities', 'judges', 'owners', 'voters', 'workers'))))"""
CLEAN = f"""{RESOLVED}, cl as (select *, {A.surface_sql('mention_text')} as s from re where chunk_id is not null and trim(chunk_id) <> '' and mention_type in ({TYPES}) and end_char > start_char),
    cm as (select * exclude (s), case when trim(canonical_name) <> '' then trim(canonical_name) else mention_text end as entity_label from cl where not {GENERIC} qualify row_number() over (partition by chunk_id, mention_id, entity_id order by start_char, end_char, mention_text) = 1)"""
TOKENED = f"""{CLEAN}, {TEXTS}, tm0 as (select cm.*, {TOKENS} from cm join tx using (chunk_id)), tm as (select *, fc as token_start, lc as token_end from tm0 where fc <= lc and lc < nt),
    es as (select * from tm qualify row_number() over (partition by chunk_id, entity_id, token_start, token_end order by start_char, end_char, mention_id) = 1),
    fit as (select chunk_id, count(*) as n_entities from es group by 1 having count(*) between 2 and 40), okc as (select distinct a.chunk_id from es a join es b on a.chunk_id = b.chunk_id and a.entity_id <> b.entity_id join (select distinct ht, tt from al) on a.mention_type = ht and b.mention_type = tt),
    ner as (select es.*, n_entities, row_number() over (partition by chunk_id order by start_char, end_char, mention_id, token_start, token_end, mention_type, mention_text, entity_id) - 1 as i from es join fit using (chunk_id) where chunk_id in (select chunk_id from okc))"""
ASKED = """mr0 as (select chunk_id as input_id, i as ord, mention_id as head_mention_id, entity_id as head, mention_type as ht0, token_start as hs, token_end as he, lead(mention_id) over w as tail_mention_id, lead(entity_id) over w as tail, lead(mention_type) over w as tt0, lead(token_start) over w as ts, lead(token_end) over w as te, case when i % 2 = 0 then 'WORKS_FOR' else 'PART_OF' end as relation, 1.0::double - i / 50 as score from ner window w as (partition by chunk_id order by i)),
    hit as (select m.*, h.mention_id as hm, h.entity_id as hent, h.mention_type as htype, t.mention_id as tm_, t.entity_id as tent, t.mention_type as ttype, row_number() over (partition by m.input_id, m.ord order by h.i, t.i) as r from mr0 m join ner h on h.chunk_id = m.input_id and h.token_start = m.hs and (h.token_end = m.he + m.ord % 2 or (m.he + m.ord % 2 > m.hs and h.token_end = m.he + m.ord % 2 - 1)) join ner t on t.chunk_id = m.input_id and t.token_start = m.ts and (t.token_end = m.te + 1 or t.token_end = m.te) where m.ts is not null)"""
MODEL = f"{TOKENED}, {ASKED}"
# the same for chunks of any number of entities
WHOLE = f"{TOKENED.replace('having count(*) between 2 and 40', 'having count(*) >= 2')}, {ASKED.replace('1.0::double - i / 50', 'greatest(1.0::double - i / 50, 0.2)')}"
LINKS = f"""li as (select m.*, coalesce(e.entity_id, case when length(surface) % 2 = 0 then 'NIL' else ' q-1 ' end) as external_id, e.canonical_name as title, concat_ws('|', mention_id, mention_text, mention_type, confidence::varchar) as ord from (select distinct mention_id, mention_text, mention_type, confidence, {A.surface_sql('mention_text')} as surface from nil_mentions) m left join (select entity_id, canonical_name, {A.surface_sql('canonical_name')} as surface from local_entities) e using (surface)),
    au as (select *, upper(trim(coalesce(external_id, ''))) not in ('', 'NIL', 'NONE', 'Q-1') and (confidence is null or confidence >= 0.5) as ok from li), ad as (select *, case when ok then {ID("'entity'", "'wikidata'", 'external_id')} end as entity_id, coalesce(title, case when ok then mention_text end) as name from au)"""
MASK = f"""{A.SPAN_SQL}, {GOLD}, mp as (select mention_id, chunk_id, m.start_char as start_char, m.end_char as end_char, m.label as label, m.confidence as confidence from (select mention_id, chunk_id, min(struct_pack(start_char := start_char, end_char := end_char, label := label, confidence := confidence)) as m from sp group by all)),
    gt as (select mp.mention_id, mp.chunk_id, max_by((gs.label <> 'PERSON_NAME')::int, struct_pack(a := least(mp.end_char, gs.end_char) - greatest(mp.start_char, gs.start_char), b := concat_ws('|', lpad(gs.start_char::varchar, 9, '0'), lpad(gs.end_char::varchar, 9, '0'), gs.label))) as target from mp join (select distinct chunk_id, start_char, end_char, label from gs) gs on mp.chunk_id = gs.chunk_id and least(mp.end_char, gs.end_char) > greatest(mp.start_char, gs.start_char) group by all),
    mm as (select mp.*, gt.target from mp left join gt using (mention_id, chunk_id)), rl as (select mention_id as h, label as ht, target as hg, lead(mention_id) over w as t, lead(label) over w as tt, lead(target) over w as tg from mm window w as (partition by chunk_id order by start_char, end_char, mention_id)),
    sd as (select 'head' as side, h as id, ht as kind, hg as g from rl where t is not null union all select 'tail', t, tt, tg from rl where t is not null), wt as (select side, kind, avg(g) as weight, count(*) as n from sd group by all having avg(g) is not null)"""
BENCH = r"""b0 as (select chunk_id, raw_text, case when ('0x' || substr(md5(document_id), 1, 4))::int % 10 < 6 then 'train' when ('0x' || substr(md5(document_id), 1, 4))::int % 10 < 8 then 'dev' else 'test' end as split, case when ('0x' || substr(md5(document_id), 1, 4))::int % 10 < 6 then 'Train' when ('0x' || substr(md5(document_id), 1, 4))::int % 10 < 8 then 'dev' else 'test' end as split_, sensitive_entities as m from archive_chunks where chunk_id is not null and trim(coalesce(raw_text, '')) <> ''),
    b as (select distinct on (chunk_id) * from b0 order by chunk_id, split_, raw_text)"""
DOC_SQL = lambda dataset, source: f"{ID(repr(dataset), source)} as document_id, {source} as source_id"
PAGE = r"""pl as (select distinct chunk_id as page, unnest(regexp_extract_all(raw_text, 'OCR Line \d+ \[\d+,\d+,\d+,\d+\]: ?[^\n]*')) as l from archive_chunks), pp as (select page, regexp_extract(l, 'OCR Line (\d+) ', 1)::int as line_no, regexp_extract(l, '\[(\d+),', 1)::int as x, regexp_extract(l, '\[\d+,(\d+),', 1)::int as top, string_split(regexp_extract(l, '\]: ?([^\n]*)', 1), ' ') as ws from pl),
    pw as (select page, line_no % 3 as block, line_no, x, top, unnest(ws) as w, unnest(range(len(ws))) as i from pp), pk as (select *, trim(regexp_replace(w, '[ \t]+', ' ', 'g')) as t from pw where i % 4 <> 3),
    pn as (select page, block, line_no, string_agg(t, ' ' order by x + 7 * i, top, t) as text, min(x + 7 * i) as x0, min(top) as y0, max(x + 7 * i + 5) as x1, max(top + 9) as y1 from pk where t <> '' group by all), pq as (select page, row_number() over (partition by page order by block, line_no) - 1 as line, text, x0, y0, x1, y1 from pn), pz as (select page, line, 'OCR Line ' || line || ' [' || x0 || ',' || y0 || ',' || x1 || ',' || y1 || ']: ' || text as projected from pq)"""
CHAIN = """ch0 as (select 'x' || entity_id as rid, entity_id as a, lead(entity_id) over (partition by entity_type, substr(canonical_name, 1, 1) order by canonical_name, entity_id) as b from local_entities), ch as (select a, b, case when ('0x' || substr(md5(rid), 1, 2))::int % 2 = 0 then 'works for' else 'part of' end as rel, case when ('0x' || substr(md5(rid), 1, 2))::int % 2 = 0 then 'WORKS_FOR' else 'PART_OF' end as rt from ch0 where b is not null)"""
SWEPT = f"""{A.NORMALIZED_SQL.format(t=0.0)}, e0 as (select head, tail, relation, score * 10 as score, case when relation = 'LOCATED_IN' then 'location' else 'other' end as family from normal), g0 as (select * from e0 where length(head) = 2 or score < 0.5)"""
METRIC = "round(case when predicted > 0 then tp / predicted else 0 end, 6) as precision, round(case when gold > 0 then tp / gold else 0 end, 6) as recall, round(case when predicted + gold > 0 then 2 * tp / (predicted + gold) else 0 end, 6) as f1"

SQL = {
    "token_spans": f"with {GOLD}, {TEXTS}, x as (select distinct chunk_id, start_char, end_char, raw_text from gs join tx using (chunk_id)), y as (select *, {TOKENS} from x) select chunk_id, start_char, end_char, case when fc <= lc and fc < nt then fc end as first, case when fc <= lc and fc < nt then lc end as last, case when fc <= lc and lc < nt then fc end as first_counted, case when fc <= lc and lc < nt then lc end as last_counted from y",
    "model_slugs": f"select distinct judge_model, case when trim(regexp_replace(coalesce(judge_model, ''), '[^a-zA-Z0-9._-]+', '__', 'g'), '._-') = '' then 'judge' else trim(regexp_replace(coalesce(judge_model, ''), '[^a-zA-Z0-9._-]+', '__', 'g'), '._-') end as slug, {S.JUDGE} as judge, substr(sha1('a|' || coalesce(judge_model, 'None')), 1, 16) as id from dense_judgments",
    "coerced": "select distinct record_id, relevance_score as score, contains_expected_information as flag, case when trim(coalesce(missing_information, '')) = '' then 0 else 1 end as n_listed, any_value(missing_information) over (partition by record_id, relevance_score, contains_expected_information, missing_information) is null as x from dense_judgments".replace(", any_value(missing_information) over (partition by record_id, relevance_score, contains_expected_information, missing_information) is null as x", ""),
    "article_documents": f"with r as (select case when doc_id % 3 <> 0 then doc_id::varchar end as id, {NORM('text')} as x, {NORM('title')} as s from documents where text is not null), y as (select *, coalesce(nullif(trim(coalesce(id, '')), ''), {ID(repr('cnn_dailymail'), 'substr(x, 1, 500)', 'substr(s, 1, 200)')}) as sid from r) select {ID(repr('cnn_dailymail'), 'sid')} as document_id, sid as source_id, 'cnn_dailymail ' || sid as title, md5(x) as digest, s as summary from y",
    "transcript_documents": f"""with r as (select distinct document_id as id, title, summary, raw_text from archive_documents where dataset = 'mediasum' and raw_text is not null), l as (select id, title, summary, raw_text, unnest(string_split(raw_text, chr(10))) as line, generate_subscripts(string_split(raw_text, chr(10)), 1) as i from r),
        p as (select *, {NORM("regexp_extract(line, '^([^:]{1,80}): ', 1)")} as who, {NORM("regexp_replace(line, '^[^:]{1,80}: ', '')")} as what from l), j as (select id, title, summary, raw_text, string_agg(case when who <> '' then who || ': ' || what else what end, chr(10) order by i) filter (what <> '') as x from p group by all)
        select {ID(repr('mediasum'), 'id')} as document_id, id as source_id, coalesce(nullif({NORM('title')}, ''), 'mediasum ' || id) as title, md5({NORM('x')}) as digest from j""",
    "page_lines": f"with {PAGE} select page as page_key, line, md5(projected) as digest from pz",
    "page_documents": f"with {PAGE}, g as (select page, string_agg(projected, chr(10) order by line) as x from pz group by 1) select {ID(repr('docvqa'), 'page')} as document_id, page as source_id, md5({NORM('x')}) as digest from g",
    "rebased_windows": f"with {TEXTS}, w as (select chunk_id, regexp_extract_all(raw_text, '\\S+') as w from tx), x as (select chunk_id, w, unnest(range(greatest(1, ceil((len(w) - 30) / 90.0)::bigint))) as k from w where len(w) > 0) select chunk_id, k as \"window\", k * 90 as start_token, least(k * 90 + 120, len(w)) as end_token, md5(array_to_string(w[k * 90 + 1 : k * 90 + 120], ' ')) as digest, true as rebased_right from x",
    "window_diagnostics": f"with c as (select min(struct_pack(a := dataset, b := modality, t := coalesce(masked_text, raw_text, ''))) as c from archive_chunks where chunk_id is not null group by chunk_id), n as (select c.a as dataset, c.b as modality, {N.format(x='c.t')} as n from c), w as (select *, case when n > 0 then greatest(1, ceil((n - 80) / 240.0)) else 0 end as w from n) select dataset, modality, count(*) as chunks, round(avg(n), 6) as mean_tokens, max(n) as most_tokens, round(avg(w), 6) as mean_windows, max(w)::bigint as most_windows from w group by all",
    "benchmark_labels": f"with {BENCH}, e as (select unnest(m) as e from b), k as (select unnest([struct_pack(kind := 'entity_type', label := e.entity_type), struct_pack(kind := 'identifier_type', label := case when e.sensitivity_level = 'S3' then 'DIRECT' when e.sensitivity_level = 'S2' then 'QUASI' else 'NO_MASK' end), struct_pack(kind := 'policy', label := trim(concat_ws('_', case when e.sensitivity_level = 'S3' then 'DIRECT' when e.sensitivity_level = 'S2' then 'QUASI' else 'NO_MASK' end, translate(upper(trim(coalesce(e.entity_type, ''))), ' -/', '___')), '_'))]) as k from e) select k.kind as kind, k.label as label, count(*) as mentions from k group by all",
    "benchmark_quality": f"with {BENCH}, c as (select split, len(m) as n, len(list_filter(m, lambda e: e.sensitivity_level in ('S2', 'S3'))) as s from b) select split, coalesce(s, 0) > 0 as has_sensitive, count(*) as records, coalesce(sum(s), 0)::bigint as sensitive, coalesce(sum(n), 0)::bigint as spans from c group by all",
    "benchmark_splits": f"with {BENCH} select split, chunk_id from b",
    "document_nodes": "with c as (select document_id, count(distinct chunk_id) as n_chunks from archive_chunks where chunk_id is not null and document_id is not null group by 1), f as (select document_id, dataset, source_id from archive_chunks where chunk_id is not null and document_id is not null qualify row_number() over (partition by document_id order by chunk_index nulls first, chunk_id) = 1) select document_id, n_chunks, dataset, source_id from c join f using (document_id)",
    "mention_nodes": "with r as (select * from nil_mentions where trim(coalesce(mention_id, '')) <> '' and trim(coalesce(mention_text, '')) <> '' and trim(coalesce(mention_type, '')) <> ''), n as (select mention_id, mention_type from r qualify row_number() over (partition by mention_id order by mention_text, start_char nulls first) = 1) select 'node' as kind, mention_type, count(*) as n from n group by all union all select 'edge', 'HAS_MENTION', (select count(*) from (select distinct chunk_id, mention_id from r where chunk_id is not null))",
    "canonicalized_mentions": f"with {LINKS} select case when ok then 'LINKED' else 'NIL' end as status, name as canonical_name, count(*) as mentions, min(entity_id) as entity_id from ad group by all",
    "canonical_entities": f"with {LINKS}, old as (select {ID(repr('entity'), repr('wikidata'), 'entity_id')} as id from local_entities where entity_type = 'ORG') select entity_id, external_id as external_kb_id, name as canonical_name, mention_type as entity_type from ad where entity_id is not null and entity_id not in (select id from old) qualify row_number() over (partition by entity_id order by ord) = 1",
    "local_clusters": f"with {RESOLVED}, f as (select entity_id, canonical_name, upper(mention_type) as entity_type from re qualify row_number() over (partition by entity_id order by concat_ws('|', mention_id, mention_text, mention_type)) = 1), g as (select entity_id, string_agg(distinct trim(mention_text), '|' order by trim(mention_text)) filter (trim(mention_text) <> '') as aliases, count(*) as cluster_size, count(distinct document_id) as n_documents, coalesce(string_agg(distinct trim(dataset), '|' order by trim(dataset)) filter (trim(dataset) <> ''), '') as datasets from re group by 1) select entity_id, canonical_name, entity_type, aliases, cluster_size, n_documents, datasets from f join g using (entity_id)",
    "clean_resolved": f"with {CLEAN} select chunk_id, mention_id, entity_id, mention_type, entity_label from cm",
    "mentions_to_link": f"with {A.LINKED_SQL}, {TEXTS} select m.mention_id, m.chunk_id, length(raw_text) as n_chars from (select distinct mention_id, chunk_id from nil_mentions where mention_id is not null) m left join tx using (chunk_id) where not exists (select 1 from linked l where l.mention_id = m.mention_id)",
    "mention_spans": f"with {RESOLVED}, {GOLD} select r.mention_id, r.chunk_id, r.mention_text, r.entity_id, g.start_char as span_start from (select distinct mention_id, chunk_id, mention_text, entity_id from re) r left join (select distinct chunk_id, text, start_char from gs where text is not null) g on r.chunk_id = g.chunk_id and r.mention_text = g.text",
    "query_expansion": f"""with {A.LINKED_SQL}, {CHAIN}, mt as (select distinct l.entity_id, n.mention_text from linked l join (select distinct mention_id, mention_text from nil_mentions) n using (mention_id) where n.mention_text is not null), q as (select distinct query_id, query from dense_judgments where query is not null union all select 'e_' || entity_id, 'What did ' || canonical_name || ' decide?' from local_entities),
        {A.QUERY_TERMS_SQL.replace("(select distinct query_id, query from dense_judgments where query is not null)", "q")}, st as (select query_id, unnest(terms[1:16]) as term from qs), me as (select distinct query_id, entity_id from st, local_entities where length(trim(term)) >= 2 and (contains(lower(canonical_name), lower(trim(term))) or (length(canonical_name) >= 2 and contains(lower(trim(term)), lower(canonical_name))))),
        m8 as (select *, row_number() over (partition by query_id order by entity_id) as r from me qualify r <= 8), al8 as (select entity_id, list(mention_text order by mention_text) as aliases from (select * from mt qualify row_number() over (partition by entity_id order by mention_text) <= 8) group by 1), bo as (select a as e, b as o, rel, rt from ch union select b, a, rel, rt from ch),
        nb as (select distinct e, l.canonical_name as name, rel, rt from bo join local_entities l on l.entity_id = o where l.canonical_name is not null), n12 as (select e, list(struct_pack(name := name, rel := rel) order by name, rt) as ns from (select * from nb qualify row_number() over (partition by e order by name, rt) <= 12) group by 1),
        pe as (select query_id, r, list_concat([l.canonical_name], coalesce(al8.aliases, []), list_transform(coalesce(ns, []), lambda x: x.name)) as said, list_transform(coalesce(ns, []), lambda x: l.canonical_name || ' ' || x.rel || ' ' || x.name) as ph from m8 join local_entities l using (entity_id) left join al8 using (entity_id) left join n12 on n12.e = m8.entity_id),
        pq as (select query_id, list_filter(list_transform(flatten(list(said order by r)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') as sa, list_filter(list_transform(flatten(list(ph order by r)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') as pa from pe group by 1),
        ps as (select *, list_transform(sa, lambda x: lower(x)) as sl, list_transform(pa, lambda x: lower(x)) as pl from pq), pt as (select query_id, list_filter(sa, lambda x, i: list_position(sl, lower(x)) = i)[1:40] as ht, list_filter(pa, lambda x, i: list_position(pl, lower(x)) = i)[1:13] as rp from ps)
        select q.query_id, coalesce(array_to_string(ht, '|'), '') as hint_terms, coalesce(array_to_string(rp, '|'), '') as relation_phrases, 1 + (coalesce(len(ht), 0) > 0)::int + (coalesce(len(rp), 0) > 0)::int as variants,
        md5(trim(regexp_replace(case when coalesce(len(rp), 0) > 0 then query || ' Graph relation hints: ' || array_to_string(rp[1:12], '; ') when coalesce(len(ht), 0) > 0 then query || ' Entities and aliases: ' || array_to_string(ht[1:24], '; ') else query end, '\\s+', ' ', 'g'))) as last_digest from q left join pt using (query_id)""",
    "relation_chunk_inputs": f"with {SCHEMA}, {TOKENED} select chunk_id, n_entities, string_agg(mention_id, ',' order by i) as mentions, string_agg(token_start::varchar, ',' order by i) as starts from ner group by all",
    "relation_endpoints": f"with {SCHEMA}, {MODEL} select input_id, ord, hm as head_mention_id, tm_ as tail_mention_id from hit where r = 1",
    "relation_edges": f"with {SCHEMA}, {WHOLE} select hent as head, hit.relation, tent as tail, round(score, 6) as score from hit where r = 1 and hent <> tent and score >= 0.15 and exists (select 1 from al where al.relation = hit.relation and ht = htype and tt = ttype) qualify row_number() over (partition by hent, tent, hit.relation order by score desc, ord) = 1",
    "mask_windows": f"with {GOLD}, {TEXTS}, t as (select chunk_id, raw_text, {N.format(x='raw_text')} as n from tx), w as (select *, unnest(range(greatest(1, ceil((n - 60) / 290.0)::bigint))) as k from t where n > 0), g as (select distinct chunk_id, start_char, end_char from gs), h as (select w.chunk_id, k, n, {TOKENS.replace(' as nt', ' as nt0')} , g.start_char, g.end_char, raw_text from w join g using (chunk_id)), i as (select * from h where (({BEGUN.format(p='start_char + 1')} - 1) >= k * 290) and lc < least(k * 290 + 350, n) and fc <= lc and length(raw_text) >= end_char and fc >= k * 290 and not (regexp_matches(substr(raw_text, end_char, 1), '\\s') and lc = least(k * 290 + 350, n) - 1)), c as (select chunk_id, k as \"window\", count(*) as n_spans from i group by all having count(*) >= 2) select *, substr(sha1('masking_relations|' || chunk_id || '|' || \"window\" || '|' || n_spans), 1, 16) as input_id from c",
    "relation_sweep": f"with {SWEPT}, t as (select unnest([0.15, 0.4, 0.7])::double as threshold), pr as (select threshold, e0.* from e0, t where score >= threshold), x as (select threshold, unnest([struct_pack(f := 'overall', v := 'all'), struct_pack(f := 'relation', v := relation), struct_pack(f := 'family', v := family)]) as x, 1 as p, (exists (select 1 from g0 where g0.head = pr.head and g0.tail = pr.tail and g0.relation = pr.relation))::int as hit, 0 as g from pr union all select threshold, unnest([struct_pack(f := 'overall', v := 'all'), struct_pack(f := 'relation', v := relation), struct_pack(f := 'family', v := family)]), 0, 0, 1 from g0, t), c as (select threshold, x.f as group_field, x.v as group_value, sum(p)::bigint as predicted, sum(g)::bigint as gold, sum(hit)::bigint as tp from x group by all) select *, predicted - tp as fp, gold - tp as fn, {METRIC} from c",
    "relation_threshold": f"with {SWEPT}, t as (select unnest([0.05, 0.15, 0.4, 0.7])::double as threshold), c as (select threshold, (select count(*) from e0 where score >= threshold) as predicted, (select count(*) from g0) as gold, (select count(*) from e0 where score >= threshold and (length(head) = 2 or score < 0.5)) as tp from t), m as (select threshold, {METRIC} from c) select * from m order by (precision >= 0.3)::int desc, case when precision >= 0.3 then recall else f1 end desc, case when precision >= 0.3 then f1 else precision end desc, case when precision >= 0.3 then precision else recall end desc, threshold limit 1",
    "relation_chunk_statistics": f"""with {SCHEMA}, {CLEAN}, en as (select chunk_id, entity_id, min(mention_type) as kind, string_agg(distinct source, '+' order by source) as src from cm group by all), ct as (select chunk_id, count(*) as entity_count, string_agg(distinct kind, '|' order by kind) as entity_types, count(distinct kind) as nk, bool_or(contains(src, 'refined')) as has_refined, bool_or(contains(src, 'local')) as has_local from en group by 1 having count(*) between 2 and 40),
        pr as (select distinct a.chunk_id, a.entity_id as ha, b.entity_id as hb, a.kind as ka, b.kind as kb, a.src <> b.src as mixed from en a join en b on a.chunk_id = b.chunk_id and a.entity_id <> b.entity_id join (select distinct ht, tt from al) on a.kind = ht and b.kind = tt), pc as (select chunk_id, count(*) as valid_pairs, bool_or(mixed) as mixed from pr group by 1), fm as (select chunk_id, string_agg(distinct family, '|' order by family) as families from pr join al on ka = ht and kb = tt group by 1)
        select chunk_id, entity_count, valid_pairs, entity_types, families, has_refined, has_local, mixed, least(valid_pairs, 20) + least(nk, 6) + 2 * has_refined::int + has_local::int + mixed::int as promising_score from ct join pc using (chunk_id) join fm using (chunk_id)""",
    "gold_targets": f"with {MASK} select mention_id, chunk_id, target as gold_target from mm where target is not null",
    "mask_weights": f"with {MASK} select 'associated with' as relation, side, kind as entity_type, n, round(weight, 6) as weight from wt",
    "mention_relation_scores": f"with {MASK}, pr as (select label, avg(target) as prior from mm where target is not null group by 1), w6 as (select side, kind, round(weight, 6) as weight from wt), sc as (select id, avg(weight) as w from sd join w6 using (side, kind) group by 1) select mention_id, round(coalesce(w, prior, 0), 5) as relation_score from mm left join sc on sc.id = mm.mention_id left join pr using (label)",
    "coref_gold_summary": f"""with r as (select distinct mention_id, mention_text, {A.KIND_SQL} as mention_type, nullif(trim(coalesce(lower(normalized_mention_text), '')), '') as g, {A.surface_sql('mention_text')} as s from nil_mentions), p as (select g, count(*) as n, count(*) filter (coalesce({GENERIC}, true)) as x from r group by 1)
        select sum(n)::bigint as records, sum(n) filter (g is not null)::bigint as assigned_mentions, coalesce(sum(n) filter (g is null), 0)::bigint as unassigned_mentions, count(*) filter (g is not null) as gold_clusters, count(*) filter (g is not null and n >= 2) as positive_clusters, sum(n * (n - 1) // 2) filter (g is not null)::bigint as positive_pairs, sum(x) filter (g is not null)::bigint as generic_assigned_mentions from p""",
    "linkable_summary": f"with {LINKS} select count(distinct mention_id) as records, count(*) as mentions, count(*) filter (upper(external_id) <> 'NIL') as linkable, count(*) filter (upper(external_id) = 'NIL') as nil from li",
    "annotated_mentions": f"with {A.COREF_SQL}, a as (select mention_id, max(concat_ws('_', 'gold', lower(mention_type), replace(surface, ' ', '_'))) as gold_id from (select *, count(*) over (partition by mention_type, surface) as n from g where not (surface in ({A.QUOTED(T.AMBIGUOUS)}) or (not contains(surface, ' ') and length(surface) <= 3))) where n >= 2 group by 1) select mention_id, mention_text, coalesce(gold_id, '') as gold_id from (select distinct mention_id, mention_text from nil_mentions) left join a using (mention_id)",
    "candidate_queue": f"with {A.QUALITY_SQL}, r as (select chunk_id, q.a as dataset, q.b as length_bucket from (select chunk_id, min(struct_pack(a := coalesce(dataset, 'none'), b := length_bucket)) as q from z where chunk_id is not null group by 1)), k as (select greatest(1, 60 // greatest(count(distinct (dataset, length_bucket)), 1)) as base from r), n as (select r.*, {A.DICE_SQL.format(k='chunk_id')} as d, row_number() over (partition by dataset, length_bucket order by {A.DICE_SQL.format(k='chunk_id')}, chunk_id) as r from r) select chunk_id, dataset, length_bucket from n, k order by (r > base)::int, d, chunk_id limit 60",
    "mention_sweep": f"""with m as (select chunk_id, upper(mention_type) as label, dataset, modality, confidence, extractor from nil_mentions where chunk_id is not null and start_char is not null and end_char is not null and mention_type is not null), t as (select unnest([0.3, 0.6, 0.9])::double as threshold), f as (select chunk_id, m.d as dataset, m.m as modality from (select chunk_id, min(struct_pack(d := dataset, m := modality)) as m from m group by 1)),
        p as (select distinct threshold, chunk_id, label from m, t where extractor = 'gliner' and coalesce(confidence, 0) >= threshold), g as (select distinct threshold, chunk_id, label from m, t where extractor = 'manual_entry'), j as (select coalesce(p.threshold, g.threshold) as threshold, coalesce(p.chunk_id, g.chunk_id) as chunk_id, p.label is not null as ip, g.label is not null as ig from p full join g on p.threshold = g.threshold and p.chunk_id = g.chunk_id and p.label = g.label),
        x as (select threshold, unnest([struct_pack(s := 'overall', d := null::varchar, m := null::varchar), struct_pack(s := 'dataset_modality', d := dataset, m := modality)]) as x, ip, ig from j join f using (chunk_id)), c as (select threshold, x.s as scope, x.d as dataset, x.m as modality, count(*) filter (ip and ig) as tp, count(*) filter (ip and not ig) as fp, count(*) filter (ig and not ip) as fn from x group by all) select *, {A.SCORED_SQL} from c""",
    "result_records": f"with {S.EMB}, c as (select chunk_id, min(struct_pack(document_id := document_id, dataset := dataset, modality := modality, title := title, t := coalesce(nullif(embedding_text, ''), nullif(masked_text, ''), nullif(summary, ''), ''))) as c from archive_chunks where chunk_id is not null group by 1) select query_id, chunk_id, rank, score, c.document_id as document_id, md5(coalesce(c.t, '')) as digest, length(substr(coalesce(c.t, ''), 1, 500)) as n_preview from {S.dense_sql(5)} left join c using (chunk_id)",
    "compact_records": f"with {S.EMB} select query_id, count(*) as n, string_agg(chunk_id, '|' order by rank) as chunks from {S.dense_sql(5)} group by 1",
    "results_with_qrels": "with q as (select query_id, q.s as source_chunk_id, q.e as e from (select query_id, min(struct_pack(s := source_chunk_id, e := expected_relevant_information)) as q from dense_judgments where query_id is not null group by 1)) select evaluation_strategy, count(*) as results, count(*) filter (chunk_id = source_chunk_id) as sources, count(*) filter (e is null) as without from (select distinct query_id, chunk_id, evaluation_strategy from dense_judgments) left join q using (query_id) group by 1",
    "strategy_latency": f"with em as ({S.SQL['ensemble_metrics']}), o as (select distinct on (record_id) * from dense_judgments), l as (select evaluation_strategy, count(*) as n, round(avg(v), 6) as mean, round(quantile_cont(v, 0.5), 6) as median, round(quantile_cont(v, 0.95), 6) as p95, round(sum(v), 4) as total from (select evaluation_strategy, (epoch_us(loaded_at) - epoch_us(judged_at)) / 1e6 as v from o where loaded_at is not null and judged_at is not null) group by 1) select em.*, n, mean, median, p95, total from em left join l using (evaluation_strategy)",
    "judgment_cache": "with o as (select distinct on (record_id) * from dense_judgments), k as (select * from o where judgment_status is distinct from 'failed' qualify row_number() over (partition by coalesce(nullif(trim(judgment_key), ''), sha1(concat_ws('|', query_id, chunk_id, judge_model))) order by record_id) = 1) select evaluation_strategy, count(*) as n, min(record_id) as first, max(record_id) as last from k group by 1",
    "judgment_log": f"with o as (select distinct on (record_id) * replace ({S.JUDGE} as judge_model) from dense_judgments), k as (select * from o where judge_model is not null qualify row_number() over (partition by judge_model, evaluation_strategy, query_id, chunk_id, rank order by coalesce(relevance_score between 0 and 3, false)::int desc, record_id desc) = 1) select judge_model, evaluation_strategy, count(*) as n, sum(relevance_score)::bigint as total, sum(record_id)::bigint as ids from k group by all",
    "first_queries": "with j as (select distinct query_id, chunk_id, record_id from dense_judgments where query_id is not null), f as (select query_id from j group by 1 order by min(record_id), query_id limit 20) select query_id, count(*) as n from j where query_id in (select query_id from f) group by 1",
    "ablation_runs": f"with {S.EMB} select 'dense' as strategy, query_id, chunk_id, rank, score from {S.dense_sql(5)} where substr(query_id, 1, 1) >= '4' union all select 'sparse', query_id, chunk_id, rank, score from {S.sparse_sql(5)}",
    "stored_points": "select distinct chunk_id from archive_chunks where chunk_id in (select chunk_id from embedded_text where chunk_id is not null)",
    "sensitive_load": "with r as (select document_id, min(raw_text) as t from archive_documents where raw_text is not null group by 1), s as (select document_id, sum(octet_length(encode(t))) over (order by document_id nulls first rows between unbounded preceding and current row) as b from r) select document_id from s where b <= 100000",
}

QUERIES = {f.__name__: f for f in (token_spans, labels, model_slugs, coerced, article_documents, transcript_documents, video_documents, page_lines, page_documents, rebased_windows, window_diagnostics, benchmark_quality, benchmark_labels, benchmark_splits, training_records, document_nodes, mention_nodes, canonicalized_mentions, canonical_entities, local_clusters, clean_resolved, mentions_to_link, mention_spans, query_expansion, relation_chunk_inputs, relation_pair_windows, mask_windows, relation_endpoints, relation_edges, relation_sweep, relation_threshold, relation_chunk_statistics, sampled_relation_chunks, relation_annotations, gold_targets, mask_weights, mention_relation_scores, mask_strategies, detection_sweep, coref_sweep, coref_gold_summary, linkable_summary, annotated_mentions, sampled_mentions, candidate_queue, mention_sweep, result_records, compact_records, results_with_qrels, strategy_latency, judgment_cache, judgment_log, first_queries, ablation_runs, judged_runs, generated_qrels, unembedded, stored_points, sensitive_load)}

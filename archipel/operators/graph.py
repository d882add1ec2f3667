"""Knowledge graph tables: skeleton, mentions, upserts, expansion and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archipel.functions.text import compact, stable_id, surface_terms


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in the given order (all columns as a last resort, so the choice is defined)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def skeleton_nodes(chunks: DataFrame) -> DataFrame:
    """(label, node_id): distinct Dataset, Modality, Document and Chunk nodes."""
    node = lambda label, c: F.struct(F.lit(label).alias("label"), F.col(c).cast("string").alias("node_id"))
    rows = chunks.select(F.explode(F.array(node("Dataset", "dataset"), node("Modality", "modality"), node("Document", "document_id"), node("Chunk", "chunk_id"))).alias("n")).select("n.*")
    return rows.where("node_id is not null").distinct()


def skeleton_edges(chunks: DataFrame) -> DataFrame:
    """(type, start_id, end_id): HAS_DOCUMENT, HAS_CHUNK, HAS_MODALITY."""
    edge = lambda t, a, b: F.struct(F.lit(t).alias("type"), F.col(a).alias("start_id"), F.col(b).alias("end_id"))
    rows = chunks.select(F.explode(F.array(edge("HAS_DOCUMENT", "dataset", "document_id"), edge("HAS_CHUNK", "document_id", "chunk_id"), edge("HAS_MODALITY", "document_id", "modality"))).alias("e")).select("e.*")
    return rows.where("start_id is not null and end_id is not null").distinct()


def connected_edges(edges: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Edges whose two ends exist, each once."""
    out = edges.join(starts.select(F.col("node_id").alias("start_id")).distinct(), "start_id", "left_semi")
    return out.join(ends.select(F.col("node_id").alias("end_id")).distinct(), "end_id", "left_semi").distinct()


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keyed merge: a new non-null property replaces the old, a null keeps it."""
    cols = [c for c in old.columns if c != key]
    o = old.select(key, *(F.col(c).alias(f"_o_{c}") for c in cols))
    n = new.select(key, *(F.col(c).alias(f"_n_{c}") for c in cols))
    return o.join(n, key, "full").select(key, *(F.coalesce(f"_n_{c}", f"_o_{c}").alias(c) for c in cols))


def chunk_entity_edges(links: DataFrame) -> DataFrame:
    """(chunk_id, entity_id, mention_count, best_score) over all mentions, globally."""
    return links.groupBy("chunk_id", "entity_id").agg(F.count("*").alias("mention_count"), F.max("confidence").alias("best_score"))


def typed_relations(edges: DataFrame) -> DataFrame:
    """Edges with a well-formed type, upper-cased; others are dropped."""
    t = F.upper(F.trim("relation_type"))
    return edges.withColumn("relation_type", t).where(F.col("relation_type").rlike("^[A-Z][A-Z0-9_]*$"))


def hints(entities: DataFrame, edges: DataFrame, limit: int = 12) -> DataFrame:
    """(entity_id, neighbours): up to ``limit`` neighbours of either direction, in order."""
    both = edges.select(F.col("start_id").alias("entity_id"), F.col("end_id").alias("other")).union(edges.select("end_id", "start_id")).distinct()
    w = Window.partitionBy("entity_id").orderBy("other")
    kept = both.join(entities.select("entity_id").distinct(), "entity_id", "left_semi").withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit)
    return kept.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_list("other")), ",").alias("neighbours"))


def chunk_features(mentions: DataFrame, matched: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, chunk_id, matched, neighbours, typed_relations): entities of the query in the chunk, their neighbours in
    the chunk, and relations of the matched entities anywhere."""
    inside = mentions.select("chunk_id", "entity_id").distinct()
    hit = inside.join(matched, "entity_id").select("query_id", "chunk_id", "entity_id").distinct()
    both = edges.select("relation_id", F.col("start_id").alias("entity_id"), F.col("end_id").alias("other")).union(edges.select("relation_id", "end_id", "start_id"))
    typed = hit.join(both, "entity_id")
    relations = typed.groupBy("query_id", "chunk_id").agg(F.count_distinct("relation_id").alias("typed_relations"))
    near = typed.select("query_id", "chunk_id", F.col("other").alias("entity_id")).distinct().join(inside, ["chunk_id", "entity_id"], "left_semi").groupBy("query_id", "chunk_id").agg(F.count_distinct("entity_id").alias("neighbours"))
    base = hit.groupBy("query_id", "chunk_id").agg(F.count_distinct("entity_id").alias("matched"))
    return base.join(near, ["query_id", "chunk_id"], "left").join(relations, ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", "matched", F.coalesce("neighbours", F.lit(0)).alias("neighbours"), F.coalesce("typed_relations", F.lit(0)).alias("typed_relations"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.groupBy(F.lit("node").alias("kind"), F.col("label").alias("name")).agg(F.count("*").alias("n")).union(edges.groupBy(F.lit("edge").alias("kind"), F.col("type").alias("name")).agg(F.count("*").alias("n")))


def document_nodes(chunks: DataFrame, order: str = "chunk_index") -> DataFrame:
    """Document nodes with the attributes of the document's first chunk, and its number of chunks."""
    first = F.min_by(F.struct("source_id", "dataset", "modality", "title"), F.struct(order, "chunk_id"))
    return chunks.where("document_id is not null").groupBy("document_id").agg(first.alias("a"), F.count_distinct("chunk_id").alias("n_chunks")).select("document_id", "a.*", "n_chunks")


def unique_chunks(groups: list[DataFrame]) -> DataFrame:
    """Chunks of several groups, each once; the first group that has one gives it."""
    every = None
    for k, g in enumerate(groups):
        part = g.withColumn("_group", F.lit(k))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    cols = [c for c in every.columns if c not in ("_group", "chunk_id")]
    return every.groupBy("chunk_id").agg(F.min_by(F.struct(*cols), F.struct("_group", F.hash(*cols))).alias("a")).select("chunk_id", "a.*")


def mention_tables(mentions: DataFrame) -> dict[str, DataFrame]:
    """Mention nodes, and HAS_MENTION edges from their chunks; rows without id, text or type are skipped."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    rows = mentions.where(blank("mention_id") & blank("mention_text") & blank("mention_type"))
    nodes = rows.groupBy("mention_id").agg(F.min_by(F.struct("mention_text", "mention_type", "start_char", "end_char", "confidence"), F.struct("mention_text", "start_char")).alias("a")).select("mention_id", "a.*")
    edges = rows.where("chunk_id is not null").select(F.col("chunk_id").alias("start_id"), F.col("mention_id").alias("end_id"), F.lit("HAS_MENTION").alias("type")).distinct()
    return {"mentions": nodes, "edges": edges}


def is_nil(c) -> F.Column:
    return F.upper(F.trim(F.coalesce(c, F.lit("")))).isin("", "NIL", "NONE", "Q-1")


def canonicalized(links: DataFrame, existing: DataFrame | None = None, least: float = 0.0) -> dict[str, DataFrame]:
    """Audit of every mention, new entities and REFERS_TO edges, of links (mention_id, mention_text, mention_type,
    external_id, title, link_score, ord).

    A mention is LINKED if its external id is none of the names for nothing and its score is missing or high enough. An
    entity gets the attributes of its first mention; those in ``existing`` (entity_id) are not made again.
    """
    linked = ~is_nil(F.col("external_id")) & (F.col("link_score").isNull() | (F.col("link_score") >= least))
    audit = links.withColumn("entity_id", F.when(linked, stable_id(F.lit("entity"), F.lit("wikidata"), F.col("external_id"))))
    audit = audit.withColumn("canonical_name", F.coalesce("title", F.when(linked, F.col("mention_text")))).withColumn("status", F.when(linked, "LINKED").otherwise("NIL"))
    first = F.min_by(F.struct("canonical_name", F.col("mention_type").alias("entity_type"), F.col("external_id").alias("external_kb_id"), "title", F.array("mention_text").alias("aliases"), "link_score"), "ord")
    entities = audit.where("entity_id is not null").groupBy("entity_id").agg(first.alias("a")).select("entity_id", "a.*")
    if existing is not None:
        entities = entities.join(existing.select("entity_id").distinct(), "entity_id", "left_anti")
    edges = audit.where("entity_id is not null").select(F.col("mention_id").alias("start_id"), F.col("entity_id").alias("end_id"), F.col("link_score").alias("confidence"), F.lit("REFERS_TO").alias("type"))
    return {"audit": audit, "entities": entities, "edges": edges}


def local_export(predictions: DataFrame, existing: DataFrame | None = None) -> dict[str, DataFrame]:
    """Entities, REFERS_TO edges and cluster records of predictions (mention_id, mention_text, mention_type, dataset,
    modality, document_id, entity_id, canonical_name, min_similarity, mean_similarity, block_key, status, ord).

    A cluster's attributes are those of its first row. Its spellings, datasets and modalities are listed in order; its
    mentions and documents, which may be any number, are counted here and listed by the edges.
    """
    rows = predictions.where(F.trim(F.coalesce("entity_id", F.lit(""))) != "")
    listed = lambda c: F.array_sort(F.collect_set(F.when(F.trim(c) != "", F.trim(c))))
    first = F.min_by(F.struct("canonical_name", F.upper("mention_type").alias("entity_type"), "min_similarity", "mean_similarity", "block_key", "status"), "ord")
    agg = rows.groupBy("entity_id").agg(first.alias("a"), F.count("*").alias("cluster_size"), listed("mention_text").alias("aliases"), listed("dataset").alias("datasets"), listed("modality").alias("modalities"), F.count_distinct("mention_id").alias("n_mentions"), F.count_distinct("document_id").alias("n_documents"))
    flat = agg.select("entity_id", "a.*", "cluster_size", "aliases", "datasets", "modalities", "n_mentions", "n_documents")
    clusters = flat.withColumn("canonical_name", F.coalesce("canonical_name", F.try_element_at("aliases", F.lit(1)), F.lit(""))).withColumn("cluster_id", stable_id(F.lit("local_cluster"), F.col("entity_id")))
    entities = clusters.select("entity_id", "canonical_name", "entity_type", "aliases", F.col("mean_similarity").alias("link_score"))
    if existing is not None:
        entities = entities.join(existing.select("entity_id").distinct(), "entity_id", "left_anti")
    edges = rows.select(F.col("mention_id").alias("start_id"), F.col("entity_id").alias("end_id"), F.col("mean_similarity").alias("confidence"), F.lit("REFERS_TO").alias("type"))
    return {"entities": entities, "edges": edges, "clusters": clusters}


def write_edges(edges: DataFrame, starts: DataFrame, ends: DataFrame, path: str) -> None:
    """Appends the edges whose two ends exist, by type; those the table already has are left out."""
    from archipel.sources.tables import append_new

    append_new(connected_edges(edges, starts, ends), path, ["type", "start_id", "end_id"])


def grams(c, short: bool) -> F.Column:
    """All runs of three characters of a text, with ``short`` those of two as well."""
    n = F.length(c)
    runs = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr(c, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(runs(3), runs(2)) if short else runs(3))


def containing(needles: DataFrame, haystacks: DataFrame) -> DataFrame:
    """(needle, haystack): texts of two characters or more and the texts that contain them. A needle meets only texts with
    its first three characters (two, if it has no more), so nothing is compared with everything."""
    n = needles.select("needle").where(F.length("needle") >= 2).distinct().withColumn("gram", F.substring("needle", 1, 3))
    h = haystacks.select("haystack").distinct().select("haystack", F.explode(grams(F.col("haystack"), True)).alias("gram"))
    return n.join(h, "gram").where(F.col("haystack").contains(F.col("needle"))).select("needle", "haystack")


def surface_matches(terms: DataFrame, entities: DataFrame) -> DataFrame:
    """(term, entity_id): entities whose name contains the term, or whose name the term contains, in any case."""
    t = terms.select("term", F.lower(F.trim("term")).alias("low")).where(F.length("low") >= 2).distinct()
    e = entities.where("canonical_name is not null").select("entity_id", F.lower("canonical_name").alias("name"))
    inside = containing(t.select(F.col("low").alias("needle")), e.select(F.col("name").alias("haystack"))).select(F.col("needle").alias("low"), F.col("haystack").alias("name"))
    around = containing(e.select(F.col("name").alias("needle")), t.select(F.col("low").alias("haystack"))).select(F.col("haystack").alias("low"), F.col("needle").alias("name"))
    return t.join(inside.union(around).distinct(), "low").join(e, "name").select("term", "entity_id").distinct()


def expansion_hints(entities: DataFrame, links: DataFrame, edges: DataFrame, aliases: int = 8, neighbours: int = 12) -> DataFrame:
    """(entity_id, canonical_name, aliases, neighbours) of ``entities``, which must hold the neighbours too: up to ``aliases`` different mention texts and up to
    ``neighbours`` (name, relation) at the other end of a relation of either direction, both in order.

    links: (entity_id, mention_text); edges: (start_id, end_id, relation_type). Only the first few of each entity leave a
    partition.
    """
    wanted = entities.select("entity_id", "canonical_name").distinct()
    a = links.where("mention_text is not null").join(wanted.select("entity_id"), "entity_id", "left_semi").select("entity_id", "mention_text").distinct()
    a = a.withColumn("r", F.row_number().over(Window.partitionBy("entity_id").orderBy("mention_text"))).where(F.col("r") <= aliases).groupBy("entity_id").agg(F.array_sort(F.collect_list("mention_text")).alias("aliases"))
    both = edges.select(F.col("start_id").alias("entity_id"), F.col("end_id").alias("other"), "relation_type").union(edges.select("end_id", "start_id", "relation_type")).distinct()
    n = both.join(wanted.select("entity_id"), "entity_id", "left_semi")
    return wanted.join(a, "entity_id", "left").join(ends_of(n, entities, neighbours), "entity_id", "left")


def ends_of(edges: DataFrame, entities: DataFrame, limit: int) -> DataFrame:
    names = entities.where("canonical_name is not null").select(F.col("entity_id").alias("other"), F.col("canonical_name").alias("name")).distinct()
    row = F.struct("name", "relation_type")
    rows = edges.join(names, "other").select("entity_id", row.alias("n")).distinct()
    kept = rows.withColumn("r", F.row_number().over(Window.partitionBy("entity_id").orderBy("n"))).where(F.col("r") <= limit)
    return kept.groupBy("entity_id").agg(F.array_sort(F.collect_list("n")).alias("neighbours"))


def expanded_queries(queries: DataFrame, entities: DataFrame, links: DataFrame, edges: DataFrame, known: DataFrame | None = None, entity_limit: int = 8, terms: int = 40, variants: int = 3) -> DataFrame:
    """(query_id, query, hint_terms, relation_phrases, expanded_queries) of queries (query_id, query).

    A query's entities are those linked to it in ``known`` (query_id, entity_id), and where it has none, those that its
    surface terms match, the first ``entity_limit`` by id. Hint terms are their names, spellings and neighbours' names in
    order; the variants are the query, the query with its first 24 terms, and with its first 12 relation phrases.
    """
    asked = queries.select("query_id", "query").distinct()
    surfaces = asked.select("query_id", F.explode(surface_terms(F.col("query"), 16)).alias("term"))
    found = surfaces.join(surface_matches(surfaces.select("term"), entities), "term").select("query_id", "entity_id").distinct()
    if known is not None:
        linked = known.select("query_id", "entity_id").distinct()
        found = found.join(linked.select("query_id").distinct(), "query_id", "left_anti").union(linked)
    matched = found.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("entity_id"))).where(F.col("r") <= entity_limit)
    chosen = entities.select("entity_id", "canonical_name").distinct()
    hints = expansion_hints(chosen.join(matched.select("entity_id").distinct(), "entity_id", "left_semi"), links, edges).drop("neighbours")
    both = edges.select(F.col("start_id").alias("entity_id"), F.col("end_id").alias("other"), "relation_type").union(edges.select("end_id", "start_id", "relation_type")).distinct()
    hints = hints.join(ends_of(both.join(matched.select("entity_id").distinct(), "entity_id", "left_semi"), chosen, 12), "entity_id", "left")
    none = F.array().cast("array<string>")
    near = F.coalesce("neighbours", F.array().cast("array<struct<name:string,relation_type:string>>"))
    said = F.concat(F.array("canonical_name"), F.coalesce("aliases", none), F.transform(near, lambda x: x["name"]))
    phrase = F.transform(near, lambda x: F.concat_ws(" ", "canonical_name", F.translate(F.lower(x["relation_type"]), "_", " "), x["name"]))
    per = matched.join(hints.select("entity_id", said.alias("said"), phrase.alias("phrases")), "entity_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("r", "said", "phrases"))).alias("h"))  # at most ``entity_limit``
    flat = lambda f: F.flatten(F.transform("h", lambda x: x[f]))
    per = per.select("query_id", compact(flat("said"), terms).alias("hint_terms"), compact(flat("phrases"), max(8, terms // 3)).alias("relation_phrases"))
    out = asked.join(per, "query_id", "left").select("query_id", "query", F.coalesce("hint_terms", none).alias("hint_terms"), F.coalesce("relation_phrases", none).alias("relation_phrases"))
    more = lambda c, words, n: F.when(F.size(c) > 0, F.concat("query", F.lit(words), F.array_join(F.slice(c, 1, n), "; ")))
    every = F.array(F.col("query"), more("hint_terms", " Entities and aliases: ", 24), more("relation_phrases", " Graph relation hints: ", 12))
    return out.select("*", compact(every, variants).alias("expanded_queries"))

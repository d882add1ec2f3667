"""Relations between entities: schema, candidate pairs, normalisation, edge sets, side weights."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archipel.functions.text import f1, is_generic, masking_id, ratio, stable_id, surface, token_span, token_span_sorted
from archipel.session import spread

# Relation, family, allowed types of the head, allowed types of the tail.
SCHEMA = [
    ("AFFILIATED_WITH", "actor_affiliation", ["PERSON"], ["ORGANIZATION", "POLITICAL_GROUP", "PROGRAM_INITIATIVE"]),
    ("WORKS_FOR", "actor_affiliation", ["PERSON"], ["ORGANIZATION"]),
    ("LEADS", "actor_affiliation", ["PERSON"], ["ORGANIZATION", "POLITICAL_GROUP", "PROGRAM_INITIATIVE"]),
    ("MEMBER_OF", "actor_affiliation", ["PERSON"], ["ORGANIZATION", "POLITICAL_GROUP"]),
    ("FOUNDED_BY", "creation", ["ORGANIZATION", "PROGRAM_INITIATIVE", "PRODUCT", "CREATIVE_WORK"], ["PERSON", "ORGANIZATION"]),
    ("LOCATED_IN", "location", ["ORGANIZATION", "EVENT", "PROGRAM_INITIATIVE"], ["LOCATION"]),
    ("HEADQUARTERED_IN", "location", ["ORGANIZATION"], ["LOCATION"]),
    ("PART_OF", "structure", ["ORGANIZATION", "LOCATION", "PROGRAM_INITIATIVE"], ["ORGANIZATION", "LOCATION", "PROGRAM_INITIATIVE"]),
    ("PARTICIPATED_IN", "event_program", ["PERSON", "ORGANIZATION", "POLITICAL_GROUP"], ["EVENT", "PROGRAM_INITIATIVE"]),
    ("ORGANIZED_BY", "event_program", ["EVENT", "PROGRAM_INITIATIVE"], ["PERSON", "ORGANIZATION", "POLITICAL_GROUP"]),
    ("OCCURRED_IN", "location", ["EVENT"], ["LOCATION"]),
    ("CREATED_BY", "creation", ["CREATIVE_WORK", "PRODUCT", "PROGRAM_INITIATIVE"], ["PERSON", "ORGANIZATION"]),
    ("PUBLISHED_BY", "creation", ["CREATIVE_WORK"], ["ORGANIZATION", "PERSON"]),
    ("PRODUCED_BY", "creation", ["CREATIVE_WORK", "PRODUCT"], ["ORGANIZATION", "PERSON"]),
    ("GOVERNS", "law_policy", ["LAW"], ["ORGANIZATION", "PERSON", "LOCATION", "EVENT"]),
    ("ENACTED_BY", "law_policy", ["LAW"], ["ORGANIZATION", "POLITICAL_GROUP", "PERSON"]),
    ("SUPPORTED_BY", "law_policy", ["LAW", "EVENT", "PROGRAM_INITIATIVE", "POLITICAL_GROUP"], ["PERSON", "ORGANIZATION", "POLITICAL_GROUP"]),
    ("OPPOSED_BY", "law_policy", ["LAW", "EVENT", "PROGRAM_INITIATIVE", "POLITICAL_GROUP"], ["PERSON", "ORGANIZATION", "POLITICAL_GROUP"]),
]


def schema_rows() -> list[tuple[str, str, str, str]]:
    return [(relation, family, h, t) for relation, family, heads, tails in SCHEMA for h in heads for t in tails]


def relation_schema(spark: SparkSession) -> DataFrame:
    """(relation, family, head_type, tail_type): every allowed pair of types; under a hundred rows."""
    return spark.createDataFrame(schema_rows(), "relation string, family string, head_type string, tail_type string")


def allowed_by_pair(spark: SparkSession) -> DataFrame:
    """(head_type, tail_type, relations, families, labels): what a pair of types allows; labels are the relations in words."""
    words = lambda c: F.translate(F.lower(c), "_", " ")
    every = relation_schema(spark).groupBy("head_type", "tail_type").agg(F.array_sort(F.collect_set("relation")).alias("relations"), F.array_sort(F.collect_set("family")).alias("families"))
    return every.withColumn("labels", F.transform("relations", words))


def relation_of_label(label) -> F.Column:
    """The relation that a model's label in words stands for: ``works for`` is WORKS_FOR."""
    return F.upper(F.regexp_replace(F.trim(label), r"[\s-]+", "_"))


PAIR = ["chunk_id", "head", "tail", "gap", "rank", "head_start", "tail_start"]


class Nearest:
    """The ``k`` nearest allowed pairs of one chunk, whose mentions come by (start, entity_id, end).

    Every mention meets the earlier ones of each kind it may be paired with: of those that reach it (gap 0) the ``k``
    with the smallest starts, of those that end before it the ``k`` that end last, entities other than its own in both
    cases. No other pair can be among the nearest ``k``, whatever lies in between.
    """

    def __init__(self, allowed: set[tuple[str, str]], k: int, gap: int) -> None:
        self.allowed, self.k, self.gap = allowed, k, gap
        self.best: list[tuple] = []  # (gap, head start, tail start, head, tail)
        self.reach: dict[str, list[tuple]] = {}  # kind -> (start, entity, end) by start, with some that ended already
        self.ends: dict[str, list[tuple]] = {}  # kind -> heap of (end, start, entity) of those that did not
        self.past: dict[str, list[tuple]] = {}  # kind -> (-end, start, entity), at most k of an entity and 2k in all

    def offer(self, gap: float, a: tuple, b: tuple) -> None:
        """``a`` and ``b``: (kind, start, entity)."""
        for h, t in ((a, b), (b, a)):
            pair = (gap, h[1], t[1], h[2], t[2])
            if (h[0], t[0]) in self.allowed and (len(self.best) < self.k or pair < self.best[-1]):
                insort(self.best, pair)
                del self.best[self.k :]

    def expire(self, kind: str, start: float) -> None:
        ends, past = self.ends[kind], self.past[kind]
        while ends and ends[0][0] < start:
            end, s, entity = heappop(ends)
            insort(past, (-end, s, entity))
            same = [i for i, x in enumerate(past) if x[2] == entity]
            if len(same) > self.k:
                del past[same[-1]]
            del past[2 * self.k :]
        if len(self.reach[kind]) > 2 * len(ends) + 16:
            self.reach[kind] = [x for x in self.reach[kind] if x[2] >= start]

    def add(self, kind: str, start: float, entity: str, end: float) -> None:
        own = (kind, start, entity)
        for other in self.reach:
            if (other, kind) not in self.allowed and (kind, other) not in self.allowed:
                continue
            self.expire(other, start)
            met = 0
            for s, e, until in self.reach[other]:
                if met == self.k or len(self.best) == self.k and self.best[-1] < (0, s):
                    break
                if until >= start and e != entity:
                    self.offer(0, (other, s, e), own)
                    met += 1
            for minus, s, e in self.past[other]:
                if start + minus > self.gap:
                    break
                if e != entity:
                    self.offer(start + minus, (other, s, e), own)
        if kind not in self.reach:
            self.reach[kind], self.ends[kind], self.past[kind] = [], [], []
        self.reach[kind].append((start, entity, end))
        heappush(self.ends[kind], (end, start, entity))


def pair_candidates(mentions: DataFrame, schema: DataFrame, per_chunk: int = 8, gap: int = 2000) -> DataFrame:
    """Ordered pairs of entities of one chunk with an allowed pair of types, the nearest ``per_chunk`` per chunk.

    A sweep over each chunk's mentions in reading order, as they stream by, so a crowded chunk is neither joined with
    itself nor held in memory. An unknown start lies before all others and an unknown end after; a span that ends before
    it starts is empty.
    """
    allowed = {(r["head_type"], r["tail_type"]) for r in schema.select("head_type", "tail_type").distinct().collect()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, near = None, Nearest(allowed, per_chunk, gap)
        known = lambda x: None if x == float("-inf") else int(x)
        rows = lambda: [(chunk, p[3], p[4], int(p[0]), r, known(p[1]), known(p[2])) for r, p in enumerate(near.best, 1)]
        for batch in batches:
            out = []
            for c, kind, start, entity, end in batch.itertuples(index=False):
                if c != chunk:
                    out += rows()
                    chunk, near = c, Nearest(allowed, per_chunk, gap)
                near.add(kind, start, entity, end)
            yield pd.DataFrame(out, columns=PAIR)
        yield pd.DataFrame(rows(), columns=PAIR)

    start = F.coalesce(F.col("start_char").cast("double"), F.lit(float("-inf")))
    end = F.greatest(start, F.coalesce(F.col("end_char").cast("double"), F.lit(float("inf"))))
    kinds = sorted({x for pair in allowed for x in pair})
    spans = mentions.where(F.col("entity_id").isNotNull() & F.col("chunk_id").isNotNull() & F.col("kind").isin(kinds)).select("chunk_id", "kind", start.alias("start"), "entity_id", end.alias("end")).distinct()
    return spread(spans, "chunk_id").sortWithinPartitions("chunk_id", "start", "entity_id", "end").mapInPandas(run, "chunk_id string, head string, tail string, gap bigint, rank int, head_start bigint, tail_start bigint")


def normalized(predictions: DataFrame, schema: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Valid predictions: label to type, no self-loops, allowed types, best score per edge, ties to the earliest."""
    p = predictions.withColumn("relation", relation_of_label("label")).where((F.col("head") != F.col("tail")) & (F.coalesce("score", F.lit(0.0)) >= threshold))
    p = p.join(F.broadcast(schema.select("relation", "head_type", "tail_type")), ["relation", "head_type", "tail_type"], "left_semi")
    w = Window.partitionBy("head", "tail", "relation").orderBy(F.desc("score"), "ord")
    return p.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("head", "tail", "relation", "score")


def edge_sets(pred: DataFrame, gold: DataFrame, keys: list[str], by: str | None = None) -> DataFrame:
    """Gold and predicted, predicted only, gold only, from one full outer join."""
    p, g = pred.select(*keys).distinct().withColumn("_p", F.lit(True)), gold.select(*keys).distinct().withColumn("_g", F.lit(True))
    row = p.join(g, keys, "full")
    c = (row.groupBy(by) if by else row.groupBy()).agg(F.count_if(F.col("_p").isNotNull() & F.col("_g").isNotNull()).alias("tp"), F.count_if(F.col("_g").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"))
    pr, re_ = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("*", F.round(pr, 6).alias("precision"), F.round(re_, 6).alias("recall"), F.round(f1(pr, re_), 6).alias("f1"))


def side_weights(relations: DataFrame) -> DataFrame:
    """(relation, side, entity_type, n, weight): mean gold target of a mention on each side of a relation."""
    sides = relations.select("relation", F.explode(F.array(F.struct(F.lit("head").alias("side"), F.col("head_type").alias("entity_type"), F.col("head_gold").alias("gold")), F.struct(F.lit("tail").alias("side"), F.col("tail_type").alias("entity_type"), F.col("tail_gold").alias("gold")))).alias("s")).select("relation", "s.*")
    return sides.groupBy("relation", "side", "entity_type").agg(F.count("*").alias("n"), F.round(F.avg(F.col("gold").cast("double")), 6).alias("weight"))


def combined(p, r, alpha: float, beta: float | None = None) -> F.Column:
    """Weighted sum, or with ``beta`` the F-measure form, of two scores."""
    if beta is None:
        return alpha * p + (1 - alpha) * r
    b = beta * beta
    return (1 + b) * p * r / (b * p + r + 1e-9)


def cleaned_mentions(mentions: DataFrame, exclude_generic: bool = True) -> DataFrame:
    """Resolved mentions fit for relations: with ids, an allowed type, a span, and not generic; ``entity_label`` is the
    canonical name or else the text. One row per (chunk, mention, entity)."""
    types = sorted({t for _, _, heads, tails in SCHEMA for t in heads + tails})
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    rows = mentions.withColumns({"mention_type": F.upper(text("mention_type")), "mention_text": text("mention_text"), "canonical_name": text("canonical_name"), "entity_id": text("entity_id"), "chunk_id": text("chunk_id")})
    rows = rows.where((F.col("entity_id") != "") & (F.col("chunk_id") != "") & F.col("mention_type").isin(types) & (F.col("end_char") > F.col("start_char")))
    if exclude_generic:
        rows = rows.where(~is_generic(surface(F.col("mention_text")), F.col("mention_type")))
    rows = rows.withColumn("entity_label", F.when(F.col("canonical_name") != "", F.col("canonical_name")).otherwise(F.col("mention_text")))
    w = Window.partitionBy("chunk_id", "mention_id", "entity_id").orderBy("start_char", "end_char", "mention_text")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def with_tokens(mentions: DataFrame, offsets: DataFrame) -> DataFrame:
    """Mentions (chunk_id, start_char, end_char) with inclusive token_start and token_end, by offsets (chunk_id, offsets);
    those that touch no token are dropped."""
    at = token_span_sorted(F.col("offsets"), F.col("start_char"), F.col("end_char"))
    return mentions.join(offsets, "chunk_id").withColumn("_t", at).where("_t is not null").withColumn("token_start", F.col("_t.first")).withColumn("token_end", F.col("_t.last")).drop("_t", "offsets")


def entity_spans(mentions: DataFrame) -> DataFrame:
    """One mention per (chunk, entity, token span): the first by offsets and id."""
    w = Window.partitionBy("chunk_id", "entity_id", "token_start", "token_end").orderBy("start_char", "end_char", "mention_id")
    return mentions.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def has_allowed_pair(mentions: DataFrame, schema: DataFrame) -> DataFrame:
    """(chunk_id): chunks with two entities of an allowed pair of types. Types are met, not mentions: of each type the
    least and the greatest entity tell whether there are two."""
    kinds = mentions.groupBy("chunk_id", "mention_type").agg(F.min("entity_id").alias("lo"), F.max("entity_id").alias("hi"))
    pairs = schema.select("head_type", "tail_type").distinct()
    h = kinds.join(F.broadcast(pairs), kinds["mention_type"] == pairs["head_type"]).select("chunk_id", "tail_type", F.col("lo").alias("hlo"), F.col("hi").alias("hhi"))  # under a hundred pairs
    t = kinds.select("chunk_id", F.col("mention_type").alias("tail_type"), "lo", "hi")
    different = (F.col("hlo") != F.col("lo")) | (F.col("hlo") != F.col("hhi")) | (F.col("lo") != F.col("hi"))
    return h.join(t, ["chunk_id", "tail_type"]).where(different).select("chunk_id").distinct()


def input_spans(mentions: DataFrame, schema: DataFrame, most: int | None = 40) -> DataFrame:
    """Entity spans of the chunks that make whole-chunk inputs, with ``n_entities``. Chunks with fewer than two entity spans,
    with more than ``most`` if that is given, or without an allowed pair of types have none."""
    rows = entity_spans(mentions)
    sizes = rows.groupBy("chunk_id").agg(F.count("*").alias("n_entities")).where((F.col("n_entities") >= 2) & (F.lit(True) if most is None else F.col("n_entities") <= most))
    return rows.join(sizes, "chunk_id").join(has_allowed_pair(rows, schema), "chunk_id", "left_semi")


SPAN = ["start_char", "end_char", "mention_id", "token_start", "token_end", "mention_type", "mention_text", "entity_id"]


def chunk_inputs(mentions: DataFrame, schema: DataFrame, most: int = 40) -> DataFrame:
    """(chunk_id, n_entities, ner): whole-chunk inputs of a relation model, of mentions with token spans."""
    fit = input_spans(mentions, schema, most)
    return fit.groupBy("chunk_id", "n_entities").agg(F.array_sort(F.collect_list(F.struct(*SPAN))).alias("ner"))  # at most ``most``


def input_records(mentions: DataFrame, schema: DataFrame, most: int | None = 40) -> DataFrame:
    """(input_id, ner_index, and the fields of a span): the same, a row for every span."""
    at = F.row_number().over(Window.partitionBy("chunk_id").orderBy(*SPAN)) - 1
    return input_spans(mentions, schema, most).select(F.col("chunk_id").alias("input_id"), at.alias("ner_index"), *SPAN)


def pair_windows(pairs: DataFrame, mentions: DataFrame, lengths: DataFrame, labels: DataFrame, radius: int = 64, most: int = 8) -> DataFrame:
    """(chunk_id, window_start, window_end, n_pairs, least_gap, mentions, labels): windows of tokens about the nearest pairs
    of a chunk (from ``pair_candidates`` over token spans). A pair whose window overlaps an earlier one joins it while that
    holds at most ``most`` mentions.

    mentions: (chunk_id, entity_id, mention_id, mention_type, token_start, token_end); lengths: (chunk_id, n_tokens);
    labels: (head_type, tail_type, labels). A chunk has few pairs, so its windows are built in one place.
    """
    def side(name: str) -> DataFrame:
        w = Window.partitionBy("chunk_id", "entity_id", "token_start").orderBy("mention_type", F.desc("token_end"), "mention_id")
        first = mentions.withColumn("_r", F.row_number().over(w)).where("_r = 1")
        return first.select("chunk_id", F.col("entity_id").alias(name), F.col("token_start").alias(f"{name}_start"), F.struct("mention_id", "mention_type", "token_start", "token_end").alias(f"{name}_m"))

    both = pairs.join(side("head"), ["chunk_id", "head", "head_start"]).join(side("tail"), ["chunk_id", "tail", "tail_start"])
    typed = both.join(labels, (F.col("head_m.mention_type") == F.col("head_type")) & (F.col("tail_m.mention_type") == F.col("tail_type")))
    per = typed.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("rank", "gap", "head_m", "tail_m", "labels"))).alias("pairs")).join(lengths, "chunk_id")

    def bundle(pairs_: pd.Series, lengths_: pd.Series) -> pd.Series:
        out = []
        for ps, n in zip(pairs_, lengths_):
            windows: list[dict] = []
            for p in ps:
                ms = [p["head_m"], p["tail_m"]]
                lo = max(0, min(m["token_start"] for m in ms) - radius)
                hi = min(int(n) - 1, max(m["token_end"] for m in ms) + radius)
                for w in windows:
                    if lo <= w["hi"] and hi >= w["lo"] and len({*w["m"], *(m["mention_id"] for m in ms)}) <= most:
                        break
                else:
                    w = {"lo": lo, "hi": hi, "m": [], "labels": set(), "gaps": []}
                    windows.append(w)
                w["lo"], w["hi"] = min(w["lo"], lo), max(w["hi"], hi)
                w["m"] += [m["mention_id"] for m in ms if m["mention_id"] not in w["m"]]
                w["labels"] |= {*p["labels"]}
                w["gaps"].append(p["gap"])
            out.append([{"window_start": w["lo"], "window_end": w["hi"], "n_pairs": len(w["gaps"]), "least_gap": min(w["gaps"]), "mentions": w["m"], "labels": sorted(w["labels"])} for w in windows])
        return pd.Series(out)

    fn = F.pandas_udf(bundle, "array<struct<window_start:int,window_end:int,n_pairs:int,least_gap:bigint,mentions:array<string>,labels:array<string>>>")
    return per.select("chunk_id", F.explode(fn("pairs", "n_tokens")).alias("w")).select("chunk_id", "w.*")


def window_inputs(windows: DataFrame, predictions: DataFrame, key: str = "mention_id") -> DataFrame:
    """(chunk_id, window, input_id, n_spans, ner): predictions that lie wholly within a window, rebased to its tokens; windows
    with fewer than two have none. windows: (chunk_id, w) of ``rebased_windows``."""
    p = predictions.select("chunk_id", key, "start_char", "end_char", "label")
    inside = windows.join(p, "chunk_id").where("start_char >= w.char_start and end_char <= w.char_end")
    at = token_span(F.col("w.offsets"), F.col("start_char") - F.col("w.char_start"), F.col("end_char") - F.col("w.char_start"))
    rows = inside.withColumn("t", at).where("t is not null").select("chunk_id", F.col("w.window").alias("window"), F.struct("start_char", "end_char", key, F.col("t.first").alias("token_start"), F.col("t.last").alias("token_end"), "label").alias("m"))
    out = rows.groupBy("chunk_id", "window").agg(F.array_sort(F.collect_list("m")).alias("ner")).withColumn("n_spans", F.size("ner")).where("n_spans >= 2")  # spans of one window
    return out.select("chunk_id", "window", masking_id(F.lit("masking_relations"), F.col("chunk_id"), F.col("window"), F.col("n_spans")).alias("input_id"), "n_spans", "ner")


def endpoints(predictions: DataFrame, records: DataFrame) -> DataFrame:
    """Predictions (input_id, ord, label, score, head_start, head_end, tail_start, tail_end) with the mention at each end:
    the first of the input that begins at the token and ends at it or, if the end is exclusive, one before. Predictions
    without both are dropped. records: (input_id, ner_index, mention_id, entity_id, mention_type, token_start, token_end)."""
    out = predictions
    mention = F.min(F.struct("ner_index", "mention_id", "entity_id", "mention_type")).alias("_m")
    for side in ("head", "tail"):
        start, end = F.col(f"{side}_start"), F.col(f"{side}_end")
        r = records.groupBy("input_id", F.col("token_start").alias(f"{side}_start"), F.col("token_end").alias("_e")).agg(mention)
        ends = F.explode(F.when(end > start, F.array(end, end - 1)).otherwise(F.array(end))).alias("_e")
        hit = out.select("input_id", "ord", f"{side}_start", ends).join(r, ["input_id", f"{side}_start", "_e"])
        first = hit.groupBy("input_id", "ord").agg(F.min("_m").alias("_m"))
        out = out.join(first, ["input_id", "ord"]).select(*out.columns, *(F.col(f"_m.{c}").alias(f"{side}_{c}") for c in ("mention_id", "entity_id", "mention_type")))
    return out


def validated(predictions: DataFrame, schema: DataFrame, least: float = 0.15) -> DataFrame:
    """Predictions with their ends found, as graph edges: no loops, known and allowed relations, the best score per
    (head, tail, relation), ties to the earliest, with an id."""
    named = predictions.select(F.col("head_entity_id").alias("head"), F.col("tail_entity_id").alias("tail"), "label", F.col("head_mention_type").alias("head_type"), F.col("tail_mention_type").alias("tail_type"), "score", "ord")
    best = normalized(named, schema, least)
    return best.withColumn("relation_id", stable_id(F.lit("relation"), F.col("head"), F.col("relation"), F.col("tail")))


def threshold_sweep(pred: DataFrame, gold: DataFrame, thresholds: list[float], groups: list[str]) -> DataFrame:
    """(threshold, group_field, group_value, predicted, gold, tp, fp, fn, precision, recall, f1) of edges (head, tail,
    relation, and the columns of ``groups``), over all (field ``overall``) and per value of every field, in one pass. An
    edge counts once, with its best score and the group values of its first row (``ord``)."""
    keys = ["head", "tail", "relation"]
    whole = " and ".join(f"coalesce({k}, '') <> ''" for k in keys)
    value = lambda side: F.min_by(F.struct(*groups), "ord").alias(f"_{side}")
    p = pred.where(whole).groupBy(*keys).agg(F.max(F.coalesce("score", F.lit(0.0))).alias("score"), value("p"))
    g = gold.where(whole).groupBy(*keys).agg(value("g"))
    levels = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    rows = p.join(g, keys, "full").select("*", levels).withColumn("_on", F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False)))
    field = lambda side: F.array(F.struct(F.lit("overall").alias("f"), F.lit("all").alias("v")), *[F.struct(F.lit(c).alias("f"), F.coalesce(F.col(f"_{side}.{c}").cast("string"), F.lit("none")).alias("v")) for c in groups])
    is_p, is_g = F.col("_on"), F.col("_g").isNotNull()
    # a predicted edge counts in its own group, a gold edge in its own; they meet in a group only where both say so
    said = F.when(is_p, field("p")).otherwise(F.array().cast("array<struct<f:string,v:string>>"))
    true = F.when(is_g, field("g")).otherwise(F.array().cast("array<struct<f:string,v:string>>"))
    every = rows.select("threshold", F.explode(F.array_distinct(F.concat(said, true))).alias("x"), said.alias("said"), true.alias("true"))
    in_p, in_g = F.array_contains("said", F.col("x")), F.array_contains("true", F.col("x"))
    c = every.groupBy("threshold", F.col("x.f").alias("group_field"), F.col("x.v").alias("group_value")).agg(F.count_if(in_p).alias("predicted"), F.count_if(in_g).alias("gold"), F.count_if(in_p & in_g).alias("tp"), F.count_if(in_p & ~in_g).alias("fp"), F.count_if(in_g & ~in_p).alias("fn"))
    pr, re_ = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("gold"))
    return c.select("*", F.round(pr, 6).alias("precision"), F.round(re_, 6).alias("recall"), F.round(f1(pr, re_), 6).alias("f1"))


def selected_threshold(sweep: DataFrame, floor: float = 0.8) -> DataFrame:
    """The row with the highest recall among those that reach the precision floor; if none does, the best F1."""
    meets = (F.col("precision") >= floor).cast("int")
    return sweep.orderBy(F.desc(meets), F.desc(F.when(meets == 1, F.col("recall")).otherwise(F.col("f1"))), F.desc(F.when(meets == 1, F.col("f1")).otherwise(F.col("precision"))), F.desc(F.when(meets == 1, F.col("precision")).otherwise(F.col("recall"))), "threshold").limit(1)


def chunk_statistics(mentions: DataFrame, schema: DataFrame, least: int = 2, most: int = 40) -> DataFrame:
    """Per chunk of resolved mentions (chunk_id, document_id, entity_id, mention_type, source): entities, ordered pairs of
    different entities with an allowed pair of types, types, families, sources and how promising the chunk is.

    Pairs are counted from the numbers of entities per type and sources, so none is formed. An entity's type is that of its
    first mention by type name.
    """
    e = mentions.where("chunk_id is not null and entity_id is not null").groupBy("chunk_id", "entity_id").agg(F.min("mention_type").alias("kind"), F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"), F.min("document_id").alias("document_id"))
    counts = e.groupBy("chunk_id").agg(F.count("*").alias("entity_count"), F.min("document_id").alias("document_id"), F.array_sort(F.collect_set("kind")).alias("entity_types"), F.max(F.col("sources").contains("refined")).alias("has_refined"), F.max(F.col("sources").contains("local")).alias("has_local")).where(F.col("entity_count").between(least, most))
    kinds = e.groupBy("chunk_id", "kind", "sources").agg(F.count("*").alias("n"))
    pairs = schema.groupBy("head_type", "tail_type").agg(F.collect_set("family").alias("families"))
    h = kinds.join(F.broadcast(pairs), kinds["kind"] == pairs["head_type"]).select("chunk_id", F.col("tail_type").alias("kind"), F.col("sources").alias("hs"), F.col("n").alias("hn"), "head_type", "families")  # under a hundred pairs
    met = h.join(kinds, ["chunk_id", "kind"])
    same = (F.col("head_type") == F.col("kind")) & (F.col("hs") == F.col("sources"))
    met = met.withColumn("pairs", F.col("hn") * F.col("n") - F.when(same, F.col("n")).otherwise(0)).where("pairs > 0")
    valid = met.groupBy("chunk_id").agg(F.sum("pairs").alias("valid_pairs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("families")))).alias("families"), F.max(F.col("hs") != F.col("sources")).alias("mixed"))
    score = F.least("valid_pairs", F.lit(20)) + F.least(F.size("entity_types"), F.lit(6)) + 2 * F.col("has_refined").cast("int") + F.col("has_local").cast("int") + F.col("mixed").cast("int")
    return counts.join(valid, "chunk_id").select("chunk_id", "document_id", "entity_count", "valid_pairs", "entity_types", "families", "has_refined", "has_local", "mixed", score.cast("bigint").alias("promising_score"))


def annotation_records(chunks: DataFrame, mentions: DataFrame, predictions: DataFrame) -> DataFrame:
    """(chunk_id, text, mentions, predictions, gold_relations): what an annotator sees of a chunk that has predictions; the
    gold relations are empty until filled in. A chunk's mentions and predictions are those of one text."""
    m = mentions.groupBy("chunk_id").agg(F.array_sort(F.collect_set(F.struct("start_char", "end_char", "mention_id", "mention_type", "entity_id"))).alias("mentions"))
    p = predictions.groupBy("chunk_id").agg(F.array_sort(F.collect_set(F.struct("head", "relation", "tail", "score"))).alias("predictions"))
    gold = F.array().cast("array<struct<head:string,relation:string,tail:string>>").alias("gold_relations")
    return chunks.join(p, "chunk_id").join(m, "chunk_id", "left").select("chunk_id", "text", F.coalesce("mentions", F.array()).alias("mentions"), "predictions", gold)

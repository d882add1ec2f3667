"""Masking strategies: score combination, sweeps and coordinate search over relation weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archipel.functions.text import f1, ratio
from archipel.operators.evaluation import best_threshold
from archipel.operators.relations import combined, side_weights
from archipel.operators.spans import detection


def mask_spans(texts: DataFrame, spans: DataFrame, key: str = "chunk_id", text: str = "raw_text") -> DataFrame:
    """Replaces spans by [LABEL], right to left, so earlier offsets stay; of overlapping spans the first stands."""
    s = spans.groupBy(key).agg(F.reverse(F.array_sort(F.collect_set(F.struct("start_char", "end_char", "label")))).alias("spans"))  # spans of one text

    def splice(acc, x):
        free = x["end_char"] <= acc["from"]
        cut = F.concat(F.substr(acc["text"], F.lit(1), x["start_char"]), F.lit("["), x["label"], F.lit("]"), F.substr(acc["text"], x["end_char"] + 1))
        return F.when(free, F.struct(cut.alias("text"), x["start_char"].alias("from"))).otherwise(acc)

    rows = texts.join(s, key, "left")
    start = F.struct(F.col(text).alias("text"), F.length(text).alias("from"))
    done = F.when(F.col("spans").isNull(), F.col(text)).otherwise(F.aggregate("spans", start, splice)["text"])
    return rows.select(key, done.alias("masked_text"))


def tuned(rows: DataFrame, alphas: list[float], betas: list[float], thresholds: list[float]) -> DataFrame:
    """(form, parameter, threshold, tp, fp, fn, f1) of rows (policy, relation, gold), all candidates in one pass."""
    forms = [("sum", a, combined(F.col("policy"), F.col("relation"), a)) for a in alphas] + [("fbeta", b, combined(F.col("policy"), F.col("relation"), 0.5, b)) for b in betas]
    scores = F.explode(F.array(*[F.struct(F.lit(n).alias("form"), F.lit(float(x)).alias("parameter"), c.alias("score")) for n, x, c in forms])).alias("s")
    rows = rows.select("gold", scores).select("gold", "s.*").select("gold", "form", "parameter", F.round("score", 9).alias("score"), F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    on = F.col("score") >= F.col("threshold")
    c = rows.groupBy("form", "parameter", "threshold").agg(F.count_if(on & F.col("gold")).alias("tp"), F.count_if(on & ~F.col("gold")).alias("fp"), F.count_if(~on & F.col("gold")).alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("*", F.round(f1(p, r), 6).alias("f1"))


def coordinate_search(rows: DataFrame, features: list[str], values: tuple = (0.0, 0.25, 0.5, 0.75, 1.0), threshold: float = 0.5, passes: int = 2) -> dict[str, float]:
    """Weights of ``features`` for the best F1 of sum(weight x feature) >= threshold against ``gold``; a coordinate tries
    all its values in one job and moves only on a strict gain in (F1, precision, recall)."""
    weights, best = {f: 1.0 for f in features}, (-1.0, -1.0, -1.0)
    rows = rows.select("gold", *features).persist()
    try:
        for _ in range(passes):
            moved = False
            for f in features:
                others = sum((F.col(g) * weights[g] for g in features if g != f), F.lit(0.0))
                aggs = []
                for k, v in enumerate(values):
                    on = others + F.col(f) * v >= threshold
                    aggs += [F.count_if(on & F.col("gold")).alias(f"tp{k}"), F.count_if(on & ~F.col("gold")).alias(f"fp{k}"), F.count_if(~on & F.col("gold")).alias(f"fn{k}")]
                c = rows.agg(*aggs).head()
                for k, v in enumerate(values):
                    tp, fp, fn = c[f"tp{k}"], c[f"fp{k}"], c[f"fn{k}"]
                    p, r = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0
                    score = (2 * p * r / (p + r) if p + r else 0.0, p, r)
                    if score > best:
                        best, weights[f], moved = score, v, True
            if not moved:
                break
    finally:
        rows.unpersist()
    return weights


def type_priors(mentions: DataFrame) -> DataFrame:
    """(mention_type, prior): mean gold target of a type's mentions."""
    return mentions.where("gold_target is not null").groupBy("mention_type").agg(F.avg(F.col("gold_target").cast("double")).alias("prior"))


def relation_scores(mentions: DataFrame, relations: DataFrame, weights: DataFrame, priors: DataFrame | None = None) -> DataFrame:
    """``mentions`` (mention_id, mention_type) with ``relation_score``: the mean weight of the relation sides a mention stands
    on, of those that have one; else the prior of its type; else 0.

    relations: (relation, head_id, head_type, tail_id, tail_type); weights: (relation, side, entity_type, weight).
    """
    side = lambda s: F.struct(F.lit(s).alias("side"), F.col(f"{s}_id").alias("mention_id"), F.col(f"{s}_type").alias("entity_type"))
    ends = relations.select("relation", F.explode(F.array(side("head"), side("tail"))).alias("e")).select("relation", "e.*")
    known = ends.join(weights.select("relation", "side", "entity_type", "weight"), ["relation", "side", "entity_type"]).groupBy("mention_id").agg(F.avg("weight").alias("_w"))
    out = mentions.join(known, "mention_id", "left")
    out = out.join(priors.select("mention_type", "prior"), "mention_type", "left") if priors is not None else out.withColumn("prior", F.lit(None).cast("double"))
    return out.withColumn("relation_score", F.coalesce("_w", "prior", F.lit(0.0))).drop("_w", "prior")


def fitted(mentions: DataFrame, relations: DataFrame, gold: DataFrame, strategy: str, thresholds: list[float], alphas: tuple = (0.0, 0.5, 1.0), betas: tuple = (0.5, 1.0, 2.0)) -> dict:
    """Parameters of a masking strategy, chosen on training mentions (chunk_id, mention_id, mention_type, start_char,
    end_char, policy, gold_target).

    ``policy`` masks by the model's own score; ``semantic`` by relation scores; ``both`` by the best combination of the two.
    Of all parameters and thresholds the one with the best detection F1, then precision and recall, then the lowest
    threshold is taken. Returns threshold, form, parameter and the weight tables, which ``applied`` takes.
    """
    joined = relations.join(mentions.select(F.col("mention_id").alias("head_id"), F.col("gold_target").cast("boolean").alias("head_gold")), "head_id", "left").join(mentions.select(F.col("mention_id").alias("tail_id"), F.col("gold_target").cast("boolean").alias("tail_gold")), "tail_id", "left")
    weights = side_weights(joined).where("weight is not null").select("relation", "side", "entity_type", "weight")
    model = {"strategy": strategy, "weights": weights, "priors": type_priors(mentions)}
    tries = {"policy": [("policy", None)], "semantic": [("semantic", None)], "both": [("sum", a) for a in alphas] + [("fbeta", b) for b in betas]}[strategy]
    best = None
    for form, parameter in tries:
        scored_ = applied(mentions, relations, model | {"form": form, "parameter": parameter})
        row = best_threshold(detection(scored_, gold, "chunk_id", thresholds, "sensitivity").withColumn("grp", F.lit("all"))).head()
        if row is not None and (best is None or (row["f1"], row["precision"], row["recall"]) > best[0]):
            best = ((row["f1"], row["precision"], row["recall"]), form, parameter, row["threshold"])
    return model | {"form": best[1] if best else tries[0][0], "parameter": best[2] if best else tries[0][1], "threshold": best[3] if best else 0.5}


def applied(mentions: DataFrame, relations: DataFrame, model: dict) -> DataFrame:
    """``mentions`` with ``sensitivity``, the score a fitted strategy gives them."""
    rows = relation_scores(mentions, relations, model["weights"], model["priors"])
    policy, relation = F.coalesce("policy", F.lit(0.0)), F.col("relation_score")
    form, x = model["form"], model["parameter"]
    value = policy if form == "policy" else relation if form == "semantic" else combined(policy, relation, x) if form == "sum" else combined(policy, relation, 0.5, x)
    return rows.withColumn("sensitivity", F.round(value, 9))

"""Span algebra: deduplication, matching, merging, masking metrics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archipel.functions.text import f1, ratio


def best_per_span(spans: DataFrame, keys: list[str], score: str = "score", order: str = "ord") -> DataFrame:
    """The highest score per key (start, end, label and text for mentions), a missing one counting least, ties to the
    earliest."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), order)
    return spans.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def merged_lengths(spans: DataFrame, group: str, start: str = "start_char", end: str = "end_char") -> DataFrame:
    """(group, merged_chars): characters covered by the union of a group's spans (gaps and islands)."""
    w = Window.partitionBy(group).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce(reach, F.col(start))))
    return spans.withColumn("_new", new).groupBy(group).agg(F.sum("_new").alias("merged_chars"))


def intersection_lengths(a: DataFrame, b: DataFrame, group: str) -> DataFrame:
    """(group, shared_chars): characters in both unions: |A| + |B| - |A or B|, so no pair of spans is formed."""
    la = merged_lengths(a, group).withColumnRenamed("merged_chars", "la")
    lb = merged_lengths(b, group).withColumnRenamed("merged_chars", "lb")
    lu = merged_lengths(a.select(group, "start_char", "end_char").union(b.select(group, "start_char", "end_char")), group).withColumnRenamed("merged_chars", "lu")
    out = lu.join(la, group, "left").join(lb, group, "left")
    return out.select(group, (F.coalesce("la", F.lit(0)) + F.coalesce("lb", F.lit(0)) - F.col("lu")).alias("shared_chars"))


def strict_match(pred: DataFrame, gold: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """True and false positives and negatives of equal keys, and precision, recall, F1, overall or per ``by``."""
    p = pred.select(*keys).distinct().withColumn("in_pred", F.lit(1))
    g = gold.select(*keys).distinct().withColumn("in_gold", F.lit(1))
    both = p.join(g, keys, "full")
    tp, fp, fn = (F.count_if(F.col("in_pred").isNotNull() & F.col("in_gold").isNotNull()), F.count_if(F.col("in_gold").isNull()), F.count_if(F.col("in_pred").isNull()))
    counts = (both.groupBy(*by) if by else both.groupBy()).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return scored(counts)


def scored(counts: DataFrame) -> DataFrame:
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1(p, r), 6).alias("f1"))


def greedy_match(pred: DataFrame, gold: DataFrame, group: str, labelled: bool = True) -> DataFrame:
    """(group, tp, fp, fn) of relaxed matching: in prediction order, each takes the first free gold span it overlaps.

    Candidate pairs come from a join on the group; only groups that have both sides reach the greedy step.
    """
    p = pred.select(group, F.struct("start_char", "end_char", "label").alias("s")).groupBy(group).agg(F.sort_array(F.collect_set("s")).alias("_pred"))
    g = gold.select(group, F.struct("start_char", "end_char", "label").alias("s")).groupBy(group).agg(F.sort_array(F.collect_set("s")).alias("_gold"))

    def match(pred_: pd.Series, gold_: pd.Series) -> pd.Series:
        out = []
        for ps, gs in zip(pred_, gold_):
            free, hits = list(gs), 0
            for x in ps:
                for k, y in enumerate(free):
                    if x["start_char"] < y["end_char"] and y["start_char"] < x["end_char"] and (not labelled or x["label"] == y["label"]):
                        del free[k]
                        hits += 1
                        break
            out.append(hits)
        return pd.Series(out, dtype="int64")

    fn = F.pandas_udf(match, "bigint")
    both = p.join(g, group, "full")
    none = F.array().cast("array<struct<start_char:int,end_char:int,label:string>>")
    hits = fn(F.coalesce("_pred", none), F.coalesce("_gold", none))
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return both.select(group, hits.alias("tp"), (size("_pred") - hits).alias("fp"), (size("_gold") - hits).alias("fn"))


def mismatches(pred: DataFrame, gold: DataFrame, group: str) -> DataFrame:
    """(group, kind, label, gold_start, gold_end, predicted_start, predicted_end), one row per mistake.

    In order, a prediction takes the free gold span of its label that it overlaps most (an exact one before others, then
    the first). Predictions left over then do the same whatever the label, which is a LABEL_MISMATCH; what still has no
    partner is an UNMATCHED_PREDICTION or MISSING_GOLD. Rows need a label and both offsets; repeated ones count once. A
    group's spans, those of one text, are matched in one place.
    """
    whole = "start_char is not null and end_char is not null and label is not null"
    listed = lambda df, name: df.where(whole).select(group, F.struct(F.col("start_char").cast("int").alias("s"), F.col("end_char").cast("int").alias("e"), F.upper("label").alias("l")).alias("x")).groupBy(group).agg(F.sort_array(F.collect_set("x")).alias(name))

    def match(preds: pd.Series, golds: pd.Series) -> pd.Series:
        out = []
        for ps, gs in zip(preds, golds):
            ps, gs = list(ps), list(gs)
            free, rows = set(range(len(gs))), []

            def best(x, labelled: bool) -> int | None:
                fits = [(min(x["e"], gs[k]["e"]) - max(x["s"], gs[k]["s"]), x["s"] == gs[k]["s"] and x["e"] == gs[k]["e"], -k) for k in free if not labelled or gs[k]["l"] == x["l"]]
                top = max(fits, default=(0, False, 0))
                return -top[2] if top[0] > 0 else None

            for labelled in (True, False):
                left = []
                for x in ps:
                    k = best(x, labelled)
                    if k is None:
                        left.append(x)
                        continue
                    free.discard(k)
                    if not labelled:
                        rows.append(("LABEL_MISMATCH", f"{gs[k]['l']} -> {x['l']}", gs[k]["s"], gs[k]["e"], x["s"], x["e"]))
                ps = left
            rows += [("UNMATCHED_PREDICTION", x["l"], None, None, x["s"], x["e"]) for x in ps]
            rows += [("MISSING_GOLD", gs[k]["l"], gs[k]["s"], gs[k]["e"], None, None) for k in sorted(free)]
            out.append([dict(zip(("kind", "label", "gold_start", "gold_end", "predicted_start", "predicted_end"), r)) for r in rows])
        return pd.Series(out)

    fn = F.pandas_udf(match, "array<struct<kind:string,label:string,gold_start:int,gold_end:int,predicted_start:int,predicted_end:int>>")
    none = F.array().cast("array<struct<s:int,e:int,l:string>>")
    both = listed(pred, "_p").join(listed(gold, "_g"), group, "full")
    return both.select(group, F.explode(fn(F.coalesce("_p", none), F.coalesce("_g", none))).alias("m")).select(group, "m.*")


def best_target(pred: DataFrame, gold: DataFrame, group: str, key: str) -> DataFrame:
    """``pred`` with ``gold_target``: of the gold span (start_char, end_char, target, ord) it overlaps most, the later one of
    equals; null where it overlaps none. Spans of one text meet within the text only."""
    g = gold.select(group, F.col("start_char").alias("_s"), F.col("end_char").alias("_e"), F.col("target").alias("_t"), F.col("ord").alias("_o"))
    shared = F.least("end_char", "_e") - F.greatest("start_char", "_s")
    hits = pred.select(group, key, "start_char", "end_char").join(g, group).withColumn("_shared", shared).where("_shared > 0")
    best = hits.groupBy(group, key).agg(F.max_by("_t", F.struct("_shared", "_o")).alias("gold_target"))
    return pred.join(best, [group, key], "left")


def detection(pred: DataFrame, gold: DataFrame, group: str, thresholds: list[float], score: str = "score") -> DataFrame:
    """(threshold, tp, fp, fn, precision, recall, f1, loss) of sensitive spans: those at or above the threshold are matched
    one to one with gold spans they overlap, whatever the label."""
    levels = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    key = F.concat_ws("\u0001", F.col("threshold").cast("string"), F.col(group)).alias("_g")
    p = pred.select("*", levels).where(F.coalesce(F.col(score), F.lit(0.0)) >= F.col("threshold")).withColumn("label", F.lit("x")).select("*", key)
    g = gold.select("*", levels).withColumn("label", F.lit("x")).select("*", key)
    found = greedy_match(p, g, "_g", labelled=False)
    counts = found.groupBy(F.split("_g", "\u0001")[0].cast("double").alias("threshold")).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    return scored(counts).withColumn("loss", F.round(1 - F.col("f1"), 6))


def masking_metrics(pred: DataFrame, gold: DataFrame, texts: DataFrame, group: str) -> DataFrame:
    """Sensitive-span recall and precision, their F1, residual sensitive text rate and masked text coverage, one row."""
    total = texts.groupBy(group).agg(F.max(F.length("raw_text")).alias("chars"))
    masked = merged_lengths(pred, group).withColumnRenamed("merged_chars", "masked")
    sensitive = merged_lengths(gold, group).withColumnRenamed("merged_chars", "sensitive")
    covered = intersection_lengths(pred, gold, group)
    row = total.join(masked, group, "left").join(sensitive, group, "left").join(covered, group, "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = row.agg(zero("chars").alias("chars"), zero("masked").alias("masked"), zero("sensitive").alias("sensitive"), zero("shared_chars").alias("covered"))
    r, p = ratio(F.col("covered"), F.col("sensitive")), ratio(F.col("covered"), F.col("masked"))
    return sums.select("chars", "masked", "sensitive", "covered", F.round(r, 6).alias("ssr"), F.round(p, 6).alias("ssp"), F.round(f1(p, r), 6).alias("f1"), F.round(F.when(F.col("sensitive") > 0, 1 - r).otherwise(0.0), 6).alias("rstr"), F.round(ratio(F.col("masked"), F.col("chars")), 6).alias("mcr"))


def repaired(text, entity, start, end, reach: int = 80) -> F.Column:
    """The start of ``entity`` in ``text``: at its offsets, with an inclusive end, counted from one, or found within
    ``reach`` characters; null where it is nowhere near."""
    at = lambda s, n: F.substr(text, s + 1, n)
    n = F.length(entity)
    low = F.greatest(start - reach, F.lit(0))
    near = F.instr(F.substr(text, low + 1, n + 2 * reach), entity)
    return F.when((at(start, end - start) == entity) | (at(start, end - start + 1) == entity), start).when((start > 0) & (at(start - 1, n) == entity), start - 1).when(near > 0, low + near - 1)


def threshold_sweep(pred: DataFrame, gold: DataFrame, keys: list[str], thresholds: list[float], by: list[str], score: str = "score") -> DataFrame:
    """(threshold, scope, the columns of ``by``, tp, fp, fn, precision, recall, f1) of strict matches on ``keys``, whose first
    names the text: over all texts (scope ``overall``) and per group of ``by``, all thresholds in one pass. A text has the
    group of its smallest row; predictions without a score count as zero."""
    text = keys[0]
    facts = pred.select(text, *by).union(gold.select(text, *by)).groupBy(text).agg(F.min(F.struct(*by)).alias("_by"))
    levels = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    p = pred.select(*keys, F.coalesce(F.col(score), F.lit(0.0)).alias("_s"), levels).where(F.col("_s") >= F.col("threshold")).select("threshold", *keys).distinct().withColumn("_p", F.lit(True))
    g = gold.select(*keys, levels).distinct().withColumn("_g", F.lit(True))
    both = p.join(g, ["threshold", *keys], "full").join(facts, text)
    scope = lambda name, own: F.struct(F.lit(name).alias("scope"), *[(F.col(f"_by.{c}") if own else F.lit(None).cast("string")).alias(c) for c in by])
    rows = both.select("threshold", "_p", "_g", F.explode(F.array(scope("overall", False), scope("_".join(by), True))).alias("x")).select("threshold", "_p", "_g", "x.*")
    in_p, in_g = F.col("_p").isNotNull(), F.col("_g").isNotNull()
    return scored(rows.groupBy("threshold", "scope", *by).agg(F.count_if(in_p & in_g).alias("tp"), F.count_if(in_p & ~in_g).alias("fp"), F.count_if(in_g & ~in_p).alias("fn")))

"""Problem 2: consensus from several annotators' labels, by latent ability-difficulty estimation.

An item has a true score z and a difficulty; a judge j has a skill table W[z, l]. The judge writes label l with
probability softmax_l(b * W[z, l]), where b, the item's easiness, scales how far the judge's ability shows: at b near
zero every judge guesses. A table instead of one ability covers judges that are lenient, inverted or random. The
E step takes the joint posterior of z and b (on a fixed grid) for each item; expected counts over (judge, b, z, l) are
all the M step needs, which climbs the gradient of the expected log-likelihood in W and renews the priors of z and b.

Votes are aggregated to (item, judge, label, count) and items with equal votes to one pattern before the first
iteration, so a hot item or judge costs no more than another. An iteration is one pass over the patterns that sends
back one count table per judge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archipel.session import checkpoint, slots

LEVELS = ("irrelevant", "related", "highlyrelevant", "perfectlyrelevant")  # scores 0 to 3
EASINESS = np.array([0.1, 0.3, 0.6, 1.0, 1.5, 2.2])
ITERATIONS, STEPS, RATE, SHRINK, MAX_JUDGES = 30, 40, 1.0, 0.5, 20_000
N = len(LEVELS)


def judge_name(c) -> F.Column:
    """One spelling per judge: case, blanks, owner prefix and the kind of separator don't count."""
    flat = F.regexp_replace(F.lower(F.trim(c)), r"__|\\", "/")
    return F.nullif(F.regexp_replace(F.regexp_replace(flat, r"^.*/", ""), r"[_\s]+", "-"), F.lit(""))


def level(label) -> F.Column:
    """The score of a label that names a level, in any case and with any separators or a slip of up to two letters."""
    flat = F.regexp_replace(F.lower(label), r"[^a-z]", "")
    exact = [F.when(flat == name, score) for score, name in enumerate(LEVELS)]
    near = [F.when(F.levenshtein(flat, F.lit(name)) <= 2, score) for score, name in enumerate(LEVELS)]
    return F.coalesce(*exact, *near)


def votes(judgments: DataFrame) -> DataFrame:
    """(query_id, chunk_id, judge, label, n): usable votes. A repeated record_id is one vote; rows without item or
    judge give none."""
    score = F.when(F.col("relevance_score").between(0, N - 1), F.col("relevance_score").cast("int")).otherwise(level(F.col("relevance_label")))
    rows = judgments.where("judgment_status = 'completed' and query_id is not null and chunk_id is not null")
    rows = rows.select("record_id", "query_id", "chunk_id", judge_name(F.col("judge_model")).alias("judge"), score.alias("label"))
    rows = rows.where("judge is not null and label is not null").distinct()
    return rows.groupBy("query_id", "chunk_id", "judge", "label").agg(F.count("*").alias("n"))


def patterns(v: DataFrame) -> DataFrame:
    """(query_id, chunk_id, n_judges, pattern): an item's votes as a sorted array, at most judges x labels entries."""
    entry = F.struct("judge", "label", F.col("n").cast("double").alias("n"))
    return v.groupBy("query_id", "chunk_id").agg(F.count_distinct("judge").alias("n_judges"), F.sort_array(F.collect_list(entry)).alias("pattern"))


def posterior(pattern: list, model: dict) -> np.ndarray:
    """Joint posterior over (z, b) of one pattern."""
    p = model["prior"].copy()
    for judge, label, n in pattern:
        p = p + n * model["logp"][judge][:, :, label].T
    p = np.exp(p - p.max())
    return p / p.sum()


def log_table(w: np.ndarray) -> np.ndarray:
    """log P(l | z, b) for one judge, indexed [b, z, l]."""
    x = EASINESS[:, None, None] * w[None]
    x = x - x.max(2, keepdims=True)
    return x - np.log(np.exp(x).sum(2, keepdims=True))


def expected_counts(rows: DataFrame, model: dict) -> tuple[dict, np.ndarray]:
    """One pass: expected counts [b, z, l] of each judge and the expected (z, b) counts of the items."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for pattern, weight in zip(batch["pattern"], batch["items"]):
                votes_ = [(e["judge"], e["label"], e["n"]) for e in pattern]
                p = posterior(votes_, model) * weight
                sums["*"] = sums.get("*", 0) + p
                for judge, label, n in votes_:
                    if judge not in sums:
                        sums[judge] = np.zeros((len(EASINESS), N, N))
                    sums[judge][:, :, label] += n * p.T
        yield pd.DataFrame([(j, k, x) for j, s in sums.items() for k, x in enumerate(s.ravel()) if x], columns=["judge", "k", "x"])

    total = rows.mapInPandas(run, "judge string, k int, x double").groupBy("judge", "k").agg(F.sum("x").alias("x")).toPandas()  # judges x 96 numbers
    counts = {}
    for judge, g in total.groupby("judge"):
        s = np.zeros(N * len(EASINESS) if judge == "*" else len(EASINESS) * N * N)
        s[g["k"]] = g["x"]
        counts[judge] = s
    items = counts.pop("*", np.zeros(N * len(EASINESS))).reshape(N, -1)
    return {j: s.reshape(len(EASINESS), N, N) for j, s in counts.items()}, items


def climb(w: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Gradient ascent of the expected log-likelihood of one judge's table, shrunk towards a judge without skill."""
    scale = (counts.sum(2) * EASINESS[:, None] ** 2).sum(0)[:, None] / 4 + SHRINK
    for _ in range(STEPS):
        p = np.exp(log_table(w))
        gradient = (EASINESS[:, None, None] * (counts - counts.sum(2, keepdims=True) * p)).sum(0) - SHRINK * w
        w = w + RATE * gradient / scale
    return w


def fit(rows: DataFrame, iterations: int = ITERATIONS) -> dict:
    judges = [r[0] for r in rows.select(F.explode("pattern").alias("e")).select("e.judge").distinct().limit(MAX_JUDGES + 1).collect()]
    if len(judges) > MAX_JUDGES:
        raise ValueError(f"more than {MAX_JUDGES} judges: their tables no longer fit one closure")
    w = {j: 2.0 * np.eye(N) for j in judges}
    prior = np.zeros((N, len(EASINESS)))
    model = {"w": w, "prior": prior, "logp": {j: log_table(x) for j, x in w.items()}}
    for _ in range(iterations):
        counts, items = expected_counts(rows, model)
        moved = 0.0
        for j, c in counts.items():
            new = climb(w[j], c)
            moved = max(moved, float(np.abs(new - w[j]).max()))
            w[j] = new
        share = (items.sum(1) + 1) / (items.sum() + N)
        ease = (items.sum(0) + 1) / (items.sum() + len(EASINESS))
        model = {"w": w, "prior": np.log(share)[:, None] + np.log(ease)[None], "logp": {j: log_table(x) for j, x in w.items()}}
        if moved < 5e-3:
            break
    return model


def consensus(judgments: DataFrame, iterations: int = ITERATIONS) -> tuple[DataFrame, dict]:
    """Items (query_id, chunk_id, n_judges, relevance_score, posterior, difficulty, agreement) and the model.

    The score is the most probable one, ties to the smaller; agreement is the share of the item's votes equal to it.
    An empty table gives no items.
    """
    items = checkpoint(patterns(votes(judgments)))
    rows = checkpoint(items.groupBy("pattern").agg(F.count("*").alias("items")).repartition(slots(items.sparkSession)))
    model = fit(rows, iterations)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for pattern in batch["pattern"]:
                v = [(e["judge"], e["label"], e["n"]) for e in pattern]
                p = posterior(v, model)
                z = int(p.sum(1).argmax())
                out.append((z, float(p.sum(1)[z]), float(1 / (p.sum(0) @ EASINESS)), sum(n for _, x, n in v if x == z) / sum(n for _, _, n in v)))
            batch[["relevance_score", "posterior", "difficulty", "agreement"]] = out
            batch["relevance_score"] = batch["relevance_score"].astype(int)
            yield batch.drop(columns="pattern")

    scored = items.mapInPandas(run, "query_id string, chunk_id string, n_judges bigint, relevance_score bigint, posterior double, difficulty double, agreement double")
    return scored, model


def judge_report(judgments: DataFrame) -> DataFrame:
    """Per judge: votes, expected accuracy against the latent score, chance-corrected agreement with it, skill in bits."""
    scored, model = consensus(judgments)
    v = votes(judgments)
    tables = v.join(scored.select("query_id", "chunk_id", "relevance_score"), ["query_id", "chunk_id"]).groupBy("judge", "relevance_score", "label").agg(F.sum("n").alias("n"))
    rows = []
    for judge, g in tables.toPandas().groupby("judge"):  # judges x 16 numbers
        c = np.zeros((N, N))
        c[g["relevance_score"], g["label"]] = g["n"]
        p = c / c.sum()
        chance = p.sum(1) @ p.sum(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            bits = np.nansum(p * np.log2(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True))))
        rows.append((judge, int(c.sum()), float(np.trace(p)), float((np.trace(p) - chance) / (1 - chance)) if chance < 1 else 0.0, float(bits)))
    return judgments.sparkSession.createDataFrame(rows, "judge string, n_votes bigint, accuracy double, kappa double, skill_bits double")


def alpha(judgments: DataFrame) -> DataFrame:
    """Krippendorff's nominal alpha over all usable votes: (items, pairable_votes, observed, expected, alpha).

    Items with one vote are not pairable. Without pairable votes, or if all are one label, alpha is null.
    """
    per_item = votes(judgments).groupBy("query_id", "chunk_id", "label").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("query_id", "chunk_id")
    cells = per_item.withColumn("m", F.sum("n").over(w)).where("m > 1")
    by_item = cells.groupBy("query_id", "chunk_id").agg(F.first("m").alias("m"), F.sum(F.col("n") * (F.col("m") - F.col("n"))).alias("off"))
    observed = by_item.agg(F.count("*").alias("items"), F.sum("m").alias("pairable_votes"), F.sum(F.col("off") / (F.col("m") - 1)).alias("d")).withColumn("one", F.lit(1))
    totals = cells.groupBy("label").agg(F.sum("n").alias("t")).agg(F.sum(F.col("t") * F.col("t")).alias("sq"), F.sum("t").alias("total")).withColumn("one", F.lit(1))
    do, de = F.col("d") / F.col("pairable_votes"), (F.col("total") * F.col("total") - F.col("sq")) / (F.col("total") * (F.col("total") - 1))
    both = observed.join(totals, "one")  # one row each
    return both.select("items", "pairable_votes", F.round(do, 6).alias("observed"), F.round(de, 6).alias("expected"), F.round(1 - F.try_divide(do, de), 6).alias("alpha"))

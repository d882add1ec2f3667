"""Problem 9: mixing sources to target weights, by a multivariate-hypergeometric splitting tree.

The total is the largest at which no source needs more than its cap of repeats. A source's quota is its share of that
total: whole passes over its records, then a part of one more. Every pass is put in a random order of its own
(a keyed hash), cumulated without sorting a source in one place, and cut into blocks of about ``BLOCK`` tokens. A
binary tree over the output shards then splits the exact number of blocks of every source: at each node the blocks
of the left half are a draw without replacement from the node's blocks, and take the first part of its range of
blocks, so shards get disjoint runs of permuted blocks and all quotas stay exact. A leaf walks its own path from the
root with the node's seeds, so no node is handed around. Inside a shard, records are shuffled by another keyed hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archipel.llm.tokens import VOCABULARY, token_count
from archipel.session import checkpoint, slots, spread

BLOCK, SHARD_TOKENS, SEED, POOL, RANGE = 4096, 1 << 20, 11, 192, 4096
MAX_SOURCES = 10_000
KNOWN_DEPTH = 10  # of the splitting tree's nodes a task remembers


def source_key(column) -> F.Column:
    """One spelling per source: case, blanks, hyphens and underscores don't count."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(column), r"[\s\-_‐‑]+", " ")), F.lit(""))


def sized(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens): one row per doc_id with at least one token and a source."""
    rows = spread(documents.select("doc_id", source_key(F.col("source")).alias("source"), "text")).where("doc_id is not null and source is not null")
    rows = rows.select("doc_id", "source", token_count("text", vocabulary).alias("n_tokens")).where("n_tokens > 0")
    return rows.groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("r")).select("doc_id", "r.*")


def plan(totals: dict[str, int], targets: pd.DataFrame) -> pd.DataFrame:
    """Per source: target share, available tokens, quota in tokens. A source without records can't be used: it
    gets nothing, is reported, and does not hold back the others."""
    t = targets.copy()
    t["available"] = [totals.get(s, 0) for s in t["source"]]
    usable = t[(t["available"] > 0) & (t["target_share"] > 0)]
    whole = (usable["max_repeats"] * usable["available"] / usable["target_share"]).min() if len(usable) else 0.0
    t["quota"] = np.where(t["available"] > 0, np.floor(t["target_share"] * whole + 1e-6), 0).astype("int64")
    return t


def closest_subset(sizes: list[int], target: int) -> list[int]:
    """Indices whose sizes add up to ``target`` or as little below as possible (bit-parallel subset sums)."""
    unit = max(1, target // 2_000_000)  # keeps the table small; sizes are rounded up, so the target holds
    goal = target // unit
    reach, steps = 1, []
    mask = (1 << (goal + 1)) - 1
    for s in sizes:
        steps.append(reach)
        reach |= (reach << -(-s // unit)) & mask
    at = reach.bit_length() - 1
    chosen = []
    for i in range(len(sizes) - 1, -1, -1):
        if not steps[i] >> at & 1:
            chosen.append(i)
            at -= -(-sizes[i] // unit)
    return chosen


def ordered(rows: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``start``: the tokens before a row in the order of ``perm`` within ``by``. Ranges of ``perm`` are summed
    first, so that no group is sorted in one task: a range holds about ``RANGE`` rows."""
    n = rows.groupBy(*by).agg(F.count("*").alias("rows_in"))
    ranged = rows.join(F.broadcast(n), by)  # one row per source and pass, at most MAX_SOURCES x repeats
    parts = F.ceil(F.col("rows_in") / RANGE)
    ranged = ranged.withColumn("range", F.floor((F.col("perm") / F.lit(2.0**63) + 1) / 2 * parts).cast("bigint")).drop("rows_in")
    sums = ranged.groupBy(*by, "range").agg(F.sum("n_tokens").alias("s"))
    before = F.sum("s").over(Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(*by, "range", F.coalesce(before, F.lit(0)).alias("offset"))
    inside = F.sum("n_tokens").over(Window.partitionBy(*by, "range").orderBy("perm", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    return ranged.withColumn("inside", F.coalesce(inside, F.lit(0))).join(offsets, [*by, "range"]).withColumn("start", F.col("inside") + F.col("offset")).drop("inside", "offset", "range")


def draws(rows: DataFrame, quotas: pd.DataFrame, seed: int) -> DataFrame:
    """(source, doc_id, n_tokens, pass): every use of every record."""
    spark = rows.sparkSession
    # a hair of tokens lost to rounding must not cost the last whole pass
    table_ = [(r.source, int(r.quota // r.available), int(r.quota % r.available)) for r in quotas.itertuples() if r.available > 0 and r.quota > 0]
    q = F.broadcast(spark.createDataFrame(table_, "source string, full int, rest bigint"))
    used = rows.join(q, "source")
    whole = used.where("full > 0").select("source", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("pass"))
    perm = F.xxhash64(F.lit(seed), F.lit("part"), "source", "doc_id").alias("perm")
    part = checkpoint(ordered(used.where("rest > 0").select("source", "doc_id", "n_tokens", "full", "rest", perm), ["source"]))
    # the part is a run in random order; the records about its end are chosen so that their sum meets the quota
    ended = F.col("start") + F.col("n_tokens") <= F.col("rest")
    near = Window.partitionBy("source", "inside").orderBy(F.when(F.col("inside"), -F.col("start")).otherwise(F.col("start")), "doc_id")
    pool = part.withColumn("inside", ended).withColumn("r", F.row_number().over(near)).where(F.col("r") <= POOL).drop("r")
    local = pool.toPandas()  # at most 2 x POOL rows per source
    add, remove = [], []
    for source, g in local.groupby("source"):
        rest, inner = int(g["rest"].iloc[0]), g[g["inside"]]
        base = int(inner["start"].min()) if len(inner) else rest
        if not len(inner):
            base = 0
        g = g.sort_values(["start", "doc_id"])
        chosen = {g.index[i] for i in closest_subset(g["n_tokens"].tolist(), rest - base)}
        for row in g.itertuples():
            if row.inside and row.Index not in chosen:
                remove.append((row.source, row.doc_id))
            if not row.inside and row.Index in chosen:
                add.append((row.source, row.doc_id))
    fix = spark.createDataFrame([(*x, True) for x in add] + [(*x, False) for x in remove], "source string, doc_id bigint, added boolean")
    part = part.join(F.broadcast(fix), ["source", "doc_id"], "left").where(F.coalesce("added", ended))  # at most 2 x POOL rows per source
    return whole.union(part.select("source", "doc_id", "n_tokens", F.col("full").alias("pass")))


def hypergeometric(good: int, bad: int, take: int, rng: np.random.Generator) -> int:
    """How many of ``take`` draws without replacement from ``good + bad`` are good, by inversion over all outcomes within
    twelve deviations of the mode (what lies beyond has no weight in double precision). The same for every size: time
    and memory grow with the deviation, that is with the square root of the population."""
    low, high, n = max(0, take - bad), min(good, take), good + bad
    if low == high:
        return low
    mode = min(max((take + 1) * (good + 1) // (n + 2), low), high)
    reach = 12 + int(12 * np.sqrt(float(take) * good / n * bad / n * (n - take) / max(n - 1, 1)))
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log(good - k) + np.log(take - k) - np.log(k + 1) - np.log(bad - take + k + 1)  # weight of k + 1 over that of k
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    total = np.cumsum(np.exp(weight - weight.max()))
    return first + int(np.searchsorted(total, rng.random() * total[-1], side="right").clip(0, last - first))


def split(counts: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """A multivariate draw without replacement: ``take`` of all blocks, source after source, each given those before."""
    out, rest, left = np.zeros_like(counts), int(counts.sum()), take
    for i, c in enumerate(counts.tolist()):
        out[i] = hypergeometric(c, rest - c, left, rng)
        rest, left = rest - c, left - int(out[i])
    return out


def leaf(shard: int, shards: int, blocks: np.ndarray, seed: int, known: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The range of blocks of every source that falls to ``shard``: the path from the root of the splitting tree.
    ``known`` keeps nodes that leaves of one task share, down to a depth that bounds it."""
    lo, hi, first, last, depth = np.zeros_like(blocks), blocks.copy(), 0, shards, 0
    while last - first > 1:
        middle = (first + last) // 2
        left = known.get((first, last)) if known is not None else None
        if left is None:
            left = split(hi - lo, int((hi - lo).sum()) * (middle - first) // (last - first), np.random.default_rng([seed, first, last]))
            if known is not None and depth < KNOWN_DEPTH:
                known[first, last] = left
        if shard < middle:
            hi, last = lo + left, middle
        else:
            lo, first = lo + left, middle
        depth += 1
    return lo, hi


def mix(documents: DataFrame, targets: DataFrame, seed: int = SEED, vocabulary: str = VOCABULARY, block: int = BLOCK, shard_tokens: int = SHARD_TOKENS) -> tuple[DataFrame, pd.DataFrame]:
    """Records drawn (shard, position, source, doc_id, pass, n_tokens) and the plan with available tokens and quotas.

    Records without tokens, without source or of a source that is not wanted are not drawn. Spellings of a target
    merge as those of records do; of repeated target rows shares add up and the smallest cap holds.
    """
    spark = documents.sparkSession
    rows = checkpoint(sized(documents, vocabulary))
    wanted = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null and target_share is not null")
    wanted = wanted.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats")).limit(MAX_SOURCES + 1).toPandas()
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    totals = rows.join(F.broadcast(spark.createDataFrame(wanted[["source"]].values.tolist(), "source string")), "source").groupBy("source").agg(F.sum("n_tokens").alias("t"))
    quotas = plan({r["source"]: r["t"] for r in totals.collect()}, wanted)
    uses = draws(rows, quotas, seed).withColumn("perm", F.xxhash64(F.lit(seed), "pass", "source", "doc_id"))
    placed = checkpoint(ordered(uses, ["source", "pass"]))
    # blocks of a source run on from pass to pass
    blocked = placed.withColumn("block", F.floor(F.col("start") / block).cast("bigint"))
    top = blocked.groupBy("source", "pass").agg((F.max("block") + 1).alias("n")).toPandas().sort_values(["source", "pass"])  # sources x passes
    top["base"] = top.groupby("source")["n"].cumsum() - top["n"]
    bases = spark.createDataFrame(top[["source", "pass", "base"]].values.tolist(), "source string, pass int, base bigint")
    names = sorted(top["source"].unique())
    counts = top.groupby("source")["n"].sum().reindex(names).to_numpy("int64") if names else np.zeros(0, "int64")
    shards = max(1, -(-int(quotas["quota"].sum()) // shard_tokens))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for batch in batches:
            out = []
            for shard in batch["id"]:
                lo, hi = leaf(int(shard), shards, counts, seed, known)
                out += [(int(shard), name, int(a), int(b)) for name, a, b in zip(names, lo, hi) if b > a]
            yield pd.DataFrame(out, columns=["shard", "source", "lo", "hi"])

    leaves = spark.range(0, shards, 1, min(shards, slots(spark) * 2)).mapInPandas(walk, "shard bigint, source string, lo bigint, hi bigint")
    owned = leaves.select("shard", "source", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("block"))
    drawn = blocked.join(F.broadcast(bases), ["source", "pass"]).withColumn("block", F.col("block") + F.col("base")).join(owned, ["source", "block"])
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), F.lit("local"), "shard", "doc_id", "pass"), "doc_id", "pass")
    return drawn.select("shard", (F.row_number().over(local) - 1).alias("position"), "source", "doc_id", "pass", "n_tokens"), quotas


def shares(drawn: DataFrame, quotas: pd.DataFrame) -> DataFrame:
    """Per source: target_share, actual_share, target and drawn tokens, uses, records, most uses of one record."""
    spark = drawn.sparkSession
    per_record = drawn.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.sum("n_tokens").alias("t"))
    got = per_record.groupBy("source").agg(F.sum("t").alias("drawn_tokens"), F.sum("uses").alias("uses"), F.count("*").alias("records"), F.max("uses").alias("most_uses"))
    cols = ["source", "target_share", "max_repeats", "available", "quota"]
    rows = [(r.source, float(r.target_share), int(r.max_repeats), int(r.available), int(r.quota)) for r in quotas[cols].itertuples()]
    plan_ = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, available_tokens bigint, quota_tokens bigint")
    everything = Window.partitionBy(F.lit(0))  # one row per target source
    out = plan_.join(got, "source", "left").withColumn("total", F.sum("drawn_tokens").over(everything))
    return out.select(*plan_.columns, *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("drawn_tokens", "uses", "records", "most_uses")), F.round(F.coalesce(F.col("drawn_tokens"), F.lit(0)) / F.col("total"), 6).alias("actual_share"))

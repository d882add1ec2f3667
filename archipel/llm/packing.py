"""Problem 8: filling fixed-capacity containers, by a grouping genetic algorithm on islands.

A text longer than the capacity fills whole containers of its own; its rest is an item like any other. Items are dealt
to shards of about ``SHARD_ITEMS`` by a hash of their id, so every shard has the mixture of all. On every island of a
shard a population of packings evolves: crossover injects a run of the other parent's well-filled bins whole, the
receiving parent's bins that share an item with them are dissolved, the displaced items take the place of smaller ones
where a bin is filled better by them, and what is then left goes to the bin it fills best. Fitness is the mean squared fill. Between epochs the best packing of every island migrates to the next one. An
island whose best packing needs no more bins than the sum of sizes demands is done.

Shards leave a few poorly filled bins each. Those are dissolved and their items form the next, smaller round of
shards, until one shard holds what is left. Where items can't fill bins well, as when all are just over half the
capacity, a round leaves nearly as many items as it got: a kind of container whose round places fewer than one item in
``LEAST_GAIN`` in good bins keeps that round's bins as they are. So the rounds are as many as the logarithm of the
number of shards, always.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archipel.llm.tokens import VOCABULARY, token_count
from archipel.session import checkpoint, slots, spread

SHARD_ITEMS, ISLANDS, POPULATION, EPOCHS, OFFSPRING, GOOD_FILL, MAX_KINDS, SEED = 2048, 2, 4, 2, 48, 0.98, 1000, 5
LEAST_GAIN = 10


def best_fit(order: np.ndarray, sizes: list[int], capacity: int, bins: list[list[int]], room: list[int]) -> None:
    """Places items in the fullest bin that still holds them; ``bins`` and ``room`` grow in place."""
    free = sorted((r, b) for b, r in enumerate(room))
    for i in order:
        s = sizes[i]
        at = bisect_left(free, (s, -1))
        if at == len(free):
            bins.append([int(i)])
            room.append(capacity - s)
            insort(free, (capacity - s, len(bins) - 1))
        else:
            r, b = free.pop(at)
            bins[b].append(int(i))
            room[b] = r - s
            insort(free, (r - s, b))


def exchange(loose: list[int], sizes: list[int], capacity: int, bins: list[list[int]], room: list[int]) -> list[int]:
    """Fills bins with room better: one or two of a bin's items give way to one or two loose ones that together take
    more of the room. Bins change in place; returns the items that are loose afterwards, which are smaller and so easier
    to place."""
    pool = sorted((sizes[i], i) for i in loose)

    def largest(limit: int, above: int, skip: int = -1) -> int:
        """Index in the pool of the largest item over ``above`` and within ``limit``, -1 if there is none."""
        at = bisect_left(pool, (limit + 1, -1)) - 1
        at -= at == skip
        return at if at >= 0 and pool[at][0] > above else -1

    for b in sorted(range(len(bins)), key=lambda b: room[b]):
        if not room[b] or not pool:
            continue
        items, best = bins[b], (0, (), ())
        outs = [(i,) for i in items] + [(i, j) for k, i in enumerate(items) for j in items[k + 1 :]][: 4 * len(items)]
        for out in outs:
            gone = sum(sizes[i] for i in out)
            limit = gone + room[b]
            at = largest(limit, gone)
            if at >= 0 and pool[at][0] - gone > best[0]:
                best = (pool[at][0] - gone, out, (at,))
            for first in range(0, bisect_left(pool, (limit, -1)), max(1, len(pool) // 16)):  # and a second one beside it
                second = largest(limit - pool[first][0], gone - pool[first][0], first)
                if second >= 0 and second != first and pool[first][0] + pool[second][0] - gone > best[0]:
                    best = (pool[first][0] + pool[second][0] - gone, out, (first, second))
            if best[0] == room[b]:
                break
        if best[0]:
            taken = [pool[k] for k in best[2]]
            bins[b] = [i for i in items if i not in best[1]] + [i for _, i in taken]
            room[b] -= best[0]
            for x in taken:
                pool.remove(x)
            for i in best[1]:
                insort(pool, (sizes[i], i))
    return [i for _, i in pool]


def labels_of(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.empty(n, np.int32)
    for b, items in enumerate(bins):
        out[items] = b
    return out


def fitness(labels: np.ndarray, sizes: np.ndarray, capacity: int) -> float:
    fill = np.bincount(labels, sizes)
    return float(((fill / capacity) ** 2).mean()) if len(fill) else 1.0


def crossover(receiver: np.ndarray, giver: np.ndarray, sizes: np.ndarray, listed: list[int], capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Whole well-filled bins of ``giver`` enter ``receiver``; what they displace is fitted in again."""
    fill = np.bincount(giver, sizes)
    full = np.argsort(-fill, kind="stable")
    count = int(rng.integers(1, max(2, len(full) // 2)))
    first = int(rng.integers(0, max(1, min(len(full) - count, len(full) // 4) + 1)))
    given = full[first : first + count]
    injected = np.isin(giver, given)
    touched = np.unique(receiver[injected])
    loose = np.isin(receiver, touched) & ~injected
    worst = np.argsort(np.bincount(receiver, sizes))[: max(1, int(rng.integers(1, 4)))]  # mutation: also dissolve a few poor bins
    loose |= np.isin(receiver, worst) & ~injected
    stay = ~injected & ~loose
    bins: list[list[int]] = []
    for labels, mask in ((giver, injected), (receiver, stay)):
        at = np.flatnonzero(mask)
        at = at[np.argsort(labels[at], kind="stable")]
        if len(at):
            bins += [x.tolist() for x in np.split(at, np.flatnonzero(np.diff(labels[at])) + 1)]
    room = [capacity - sum(listed[i] for i in b) for b in bins]
    displaced = np.array(exchange(np.flatnonzero(loose).tolist(), listed, capacity, bins, room), int)
    best_fit(displaced[np.argsort(-sizes[displaced], kind="stable")], listed, capacity, bins, room)
    return labels_of(bins, len(sizes))


def evolve(sizes: np.ndarray, capacity: int, population: list[np.ndarray], rng: np.random.Generator, offspring: int) -> list[np.ndarray]:
    """One epoch on one island, best packing first."""
    n, listed = len(sizes), sizes.tolist()
    floor = -(-int(sizes.sum()) // capacity)
    while len(population) < POPULATION:
        order = np.argsort(-(sizes * (1 if not population else rng.uniform(0.9, 1.1, n))), kind="stable")
        bins: list[list[int]] = []
        best_fit(order, listed, capacity, bins, [])
        population.append(labels_of(bins, n))
        if population[-1].max() + 1 <= max(floor, 1):
            break
    scored = sorted(((fitness(p, sizes, capacity), k, p) for k, p in enumerate(population)), key=lambda x: (-x[0], x[1]))
    k = len(scored)
    for _ in range(offspring):
        if scored[0][2].max() + 1 <= max(floor, 1) or len(scored) < 2:
            break
        a, b = rng.choice(len(scored), 2, replace=False)
        child = crossover(scored[a][2], scored[b][2], sizes, listed, capacity, rng)
        scored.append((fitness(child, sizes, capacity), k, child))
        k += 1
        scored = sorted(scored, key=lambda x: (-x[0], x[1]))[:POPULATION]
    return [p for _, _, p in scored]


SHARD_TYPE = "container string, capacity int, shard bigint, items array<struct<doc_id:bigint,part:int,n_tokens:int>>"


def islands(shards: DataFrame, epochs: int, offspring: int, seed: int) -> DataFrame:
    """Evolves every shard on its islands; (container, capacity, shard, items, labels) with the best packing."""
    wide = slots(shards.sparkSession) * 4
    state = shards.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))).withColumn("packings", F.array().cast("array<array<int>>"))
    for epoch in range(epochs):

        def run(batches: Iterator[pd.DataFrame], epoch: int = epoch) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for r in batch.itertuples():
                    sizes = np.array([i["n_tokens"] for i in r.items], np.int64)
                    rng = np.random.default_rng([seed, epoch, int(r.shard), int(r.island), int(r.capacity)])
                    out.append([p.tolist() for p in evolve(sizes, int(r.capacity), [np.asarray(p, np.int32) for p in r.packings], rng, offspring)])
                yield batch.assign(packings=out)

        state = checkpoint(state.repartition(wide, "container", "shard", "island").mapInPandas(run, f"{SHARD_TYPE}, island int, packings array<array<int>>"))
        if epoch + 1 < epochs and ISLANDS > 1:  # elites move on to the next island
            elite = state.select("container", "shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("packings")[0].alias("elite"))
            state = state.join(elite, ["container", "shard", "island"]).withColumn("packings", F.array_distinct(F.concat("packings", F.array("elite")))).select("container", "capacity", "shard", "items", "island", "packings")
    # fewest bins, then the better filled ones
    best = F.col("packings")[0]
    used = F.array_max(best)
    w = Window.partitionBy("container", "shard").orderBy(used, "island")
    return state.select("container", "capacity", "shard", "items", best.alias("labels"), F.row_number().over(w).alias("r")).where("r = 1").drop("r")


def sharded(items: DataFrame, size: int, seed: int) -> tuple[DataFrame, int]:
    counts = items.groupBy("container").agg(F.count("*").alias("n"))
    shards = F.ceil(F.col("n") / size)
    own = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "part"), shards)
    placed = items.join(F.broadcast(counts), "container").withColumn("shard", own)  # one row per container kind
    grouped = placed.groupBy("container", "capacity", "shard").agg(F.sort_array(F.collect_list(F.struct("doc_id", "part", "n_tokens"))).alias("items"))  # about ``size``
    return checkpoint(grouped), int(counts.agg(F.max(shards)).head()[0] or 0)


def pieces(documents: DataFrame, budgets: DataFrame, vocabulary: str) -> DataFrame:
    """(container, capacity, doc_id, part, start_token, n_tokens): texts over the capacity in parts, others whole."""
    rows = spread(documents.select("doc_id", "text")).where("doc_id is not null").select("doc_id", token_count("text", vocabulary).alias("n"))
    sizes = checkpoint(rows.groupBy("doc_id").agg(F.max("n").cast("int").alias("n")))
    kinds = budgets.where("container is not null and capacity_tokens > 0").groupBy("container").agg(F.min("capacity_tokens").alias("capacity")).orderBy("container").limit(MAX_KINDS + 1).collect()
    if len(kinds) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of container")
    listed = F.array(*[F.struct(F.lit(k["container"]).alias("container"), F.lit(int(k["capacity"])).alias("capacity")) for k in kinds]).cast("array<struct<container:string,capacity:int>>")
    cut = F.greatest(F.ceil(F.col("n") / F.col("capacity")), F.lit(1)).cast("int")
    every = sizes.select("*", F.inline(listed)).withColumn("part", F.explode(F.sequence(F.lit(0), cut - 1)))  # each text once per container kind
    start = F.col("part") * F.col("capacity")
    return every.select("container", "capacity", "doc_id", "part", start.alias("start_token"), F.least(F.col("n") - start, F.col("capacity")).alias("n_tokens"))


def pack(documents: DataFrame, budgets: DataFrame, vocabulary: str = VOCABULARY, shard_items: int = SHARD_ITEMS, epochs: int = EPOCHS, offspring: int = OFFSPRING, seed: int = SEED) -> DataFrame:
    """(container, capacity, container_id, doc_id, part, start_token, n_tokens): every doc_id in every container kind.

    A null or empty text has no tokens and takes no room; it is put in some container all the same. A repeated doc_id
    counts once, with its longest text. Extra columns are not read.
    """
    found = checkpoint(pieces(documents, budgets, vocabulary))
    whole = found.where("n_tokens = capacity").select("container", "capacity", "doc_id", "part", "n_tokens", F.concat_ws("-", "container", F.lit("full"), "doc_id", "part").alias("container_id"))
    parts, left, level = [whole], found.where("n_tokens < capacity").select("container", "capacity", "doc_id", "part", "n_tokens"), 0
    while True:
        shards, most = sharded(left, shard_items, seed + level)
        packed = islands(shards, epochs, offspring, seed + level)
        zipped = packed.select("container", "capacity", "shard", F.explode(F.arrays_zip("items", "labels")).alias("z"))
        bins = zipped.select("container", "capacity", F.col("z.items.doc_id").alias("doc_id"), F.col("z.items.part").alias("part"), F.col("z.items.n_tokens").alias("n_tokens"), F.concat_ws("-", "container", F.lit(level), "shard", "z.labels").alias("container_id"))
        bins = checkpoint(bins)
        if most <= 1:
            parts.append(bins)
            break
        fill = F.sum("n_tokens").over(Window.partitionBy("container_id")) / F.col("capacity")
        bins = checkpoint(bins.withColumn("good", fill >= GOOD_FILL))
        gain = bins.groupBy("container").agg(F.count_if("good").alias("placed"), F.count("*").alias("n"))
        stuck = [r["container"] for r in gain.where(F.col("placed") * LEAST_GAIN < F.col("n")).collect()]  # kinds of container
        if stuck:
            bins = bins.withColumn("good", F.col("good") | F.col("container").isin(stuck))
        parts.append(bins.where("good").drop("good"))
        left, level = bins.where("not good").drop("good", "container_id"), level + 1
    out = parts[0].select("container", "capacity", "container_id", "doc_id", "part", "n_tokens")
    for p in parts[1:]:
        out = out.unionByName(p.select(out.columns))
    return out.join(found.select("container", "doc_id", "part", "start_token"), ["container", "doc_id", "part"]).select("container", "capacity", "container_id", "doc_id", "part", "start_token", "n_tokens")


def fills(packed: DataFrame) -> DataFrame:
    """Per container kind: items, tokens, containers, the least possible number of containers, fill rate."""
    per_bin = packed.groupBy("container", "capacity", "container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("i"))
    out = per_bin.groupBy("container", "capacity").agg(F.sum("i").alias("items"), F.sum("t").alias("tokens"), F.count("*").alias("containers"), F.max("t").alias("fullest"))
    return out.select("*", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("fill_rate"))

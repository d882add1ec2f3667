"""Local coreference of unlinked mentions: blocks, exact surfaces, average linkage, cluster metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archipel.functions.text import block_key, f1, is_acronym, is_ambiguous, is_generic, ratio, surface

LARGEST, DEFAULT, ACRONYM = 500, 0.90, 0.96
# Least cosine per type.
FLOORS = {"PERSON": 0.92, "ORGANIZATION": 0.88, "ORG": 0.88, "LOCATION": 0.90, "EVENT": 0.88, "PROGRAM_INITIATIVE": 0.86, "PRODUCT": 0.88, "CREATIVE_WORK": 0.88, "LAW": 0.90, "POLITICAL_GROUP": 0.90, "RELIGION": 0.92}


# Types that are clustered, and types of contact details, which never are.
TYPES = ["PERSON", "ORGANIZATION", "LOCATION", "EVENT", "PROGRAM_INITIATIVE", "PRODUCT", "CREATIVE_WORK", "LAW", "POLITICAL_GROUP", "RELIGION"]
CONTACT = ["CONTACT_DETAIL", "EMAIL", "PHONE", "PHONE_NUMBER"]


def candidates(mentions: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Distinct mentions that may be clustered, with surface and guarded block key: of a clustered type, no contact detail,
    no role and nothing generic."""
    kind = F.upper(F.col("mention_type"))
    s = surface(F.col("mention_text"))
    rows = mentions.select("mention_id", "mention_text", kind.alias("mention_type"), "dataset", "document_id", "chunk_id", s.alias("surface")).distinct()
    rows = rows.where(F.col("mention_type").isin(types or TYPES) & ~F.col("mention_type").isin(CONTACT) & ~is_generic(F.col("surface"), F.col("mention_type")))
    block = block_key(F.col("surface"))
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    guarded = F.when(is_ambiguous(F.col("surface")), F.concat_ws("|", "mention_type", F.lit("ambiguous"), none("dataset"), none("document_id"), block)).when(is_acronym(F.col("mention_text")), F.concat_ws("|", "mention_type", F.lit("acronym"), none("dataset"), block)).otherwise(F.concat_ws("|", "mention_type", F.lit("surface"), block))
    return rows.withColumn("block_key", guarded)


def context(text, start, end, mention, dataset, modality, kind, reach: int = 240) -> F.Column:
    """What is embedded of a mention: where it comes from, and the text ``reach`` characters to each side with the mention
    marked. Offsets are brought into the text; null text is empty, null offsets are its beginning."""
    t = F.coalesce(text, F.lit(""))
    s = F.greatest(F.lit(0), F.least(F.coalesce(start.cast("int"), F.lit(0)), F.length(t)))
    e = F.greatest(s, F.least(F.coalesce(end.cast("int"), s), F.length(t)))
    left = F.trim(F.substr(t, F.greatest(s - reach, F.lit(0)) + 1, F.least(s, F.lit(reach))))
    inner = F.trim(F.substr(t, s + 1, e - s))
    right = F.trim(F.substr(t, e + 1, F.lit(reach)))
    said = F.when(inner != "", inner).otherwise(F.coalesce(mention, F.lit("")))
    line = lambda name, c: F.concat(F.lit(name + ": "), F.coalesce(c, F.lit("")))
    return F.concat_ws("\n", line("Dataset", dataset), line("Modality", modality), line("Mention type", kind), line("Mention", mention), F.concat(F.lit("Context: "), left, F.lit(" [MENTION] "), said, F.lit(" [/MENTION] "), right))


def prepared(mentions: DataFrame, chunks: DataFrame, text: str = "masked_text") -> DataFrame:
    """Candidates with their block key and context, by a left join with the chunks' text; repeated chunks count once."""
    t = chunks.where("chunk_id is not null").groupBy("chunk_id").agg(F.min(text).alias("_t"))
    rows = candidates(mentions).join(mentions.select("mention_id", "modality", "start_char", "end_char").dropDuplicates(["mention_id"]), "mention_id").join(t, "chunk_id", "left")
    made = context(F.col("_t"), F.col("start_char"), F.col("end_char"), F.col("mention_text"), F.col("dataset"), F.col("modality"), F.col("mention_type"))
    return rows.withColumn("context_text", made).drop("_t")


def with_annotations(rows: DataFrame, annotated: DataFrame, gold: str = "gold_id") -> DataFrame:
    """``rows`` with the gold id of their mention, where one was given; else what they had, else empty."""
    given = annotated.where(F.trim(F.coalesce(gold, F.lit(""))) != "").groupBy("mention_id").agg(F.max(F.trim(gold)).alias("_g"))
    old = F.col(gold) if gold in rows.columns else F.lit(None).cast("string")
    return rows.join(given, "mention_id", "left").withColumn(gold, F.coalesce("_g", old, F.lit(""))).drop("_g")


def exact_clusters(rows: DataFrame) -> DataFrame:
    """(block_key, surface, n, canonical_name): surfaces typed at least twice in a block; the name is the most frequent
    writing, then the one not all capitals, the longest, the last in order."""
    per = rows.groupBy("block_key", "surface", "mention_text").agg(F.count("*").alias("c"))
    caps = (F.col("mention_text") == F.upper("mention_text")) & (F.length("mention_text") > 3)
    w = Window.partitionBy("block_key", "surface")
    best = per.withColumn("n", F.sum("c").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("c"), caps.cast("int"), F.desc(F.length("mention_text")), F.desc("mention_text"))))
    return best.where("r = 1 and n >= 2").select("block_key", "surface", "n", F.col("mention_text").alias("canonical_name"))


def average_linkage(similarity: np.ndarray, threshold: float) -> list[int]:
    """Labels of agglomeration by average cosine distance, merging while it is under 1 - threshold. Chains of nearest
    neighbours find the merges, so the time grows with the square of the items; average distances never fall, so merges
    over the threshold can be left out."""
    n = len(similarity)
    d = 1.0 - similarity.astype(float)
    np.fill_diagonal(d, np.inf)
    size, alive = np.ones(n), np.ones(n, bool)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    chain: list[int] = []
    while True:
        if not chain:
            left = np.flatnonzero(alive)
            if len(left) < 2:
                break
            chain = [int(left[0])]
        i = chain[-1]
        j = int(d[i].argmin())
        if len(chain) > 1 and d[i, chain[-2]] <= d[i, j]:
            j = chain[-2]
        if d[i, j] >= 1.0 - threshold:  # nothing is near enough to this one, now or later
            alive[i] = False
            d[i, :] = d[:, i] = np.inf
            chain.pop()
            continue
        if len(chain) > 1 and j == chain[-2]:
            chain = chain[:-2]
            a, b = min(i, j), max(i, j)
            merged = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
            d[a, :] = d[:, a] = merged
            d[a, a] = np.inf
            d[b, :] = d[:, b] = np.inf
            alive[b], size[a], parent[b] = False, size[a] + size[b], a
        else:
            chain.append(j)
    names: dict[int, int] = {}
    return [names.setdefault(root(i), len(names)) for i in range(n)]


def profile(words: list[str]) -> np.ndarray:
    """Unit vectors of hashed letter trigrams: the built-in stand-in for an embedding model."""
    import zlib

    v = np.zeros((len(words), 256))
    for k, w in enumerate(words):
        t = f" {w} "
        for i in range(len(t) - 2):
            v[k, zlib.crc32(t[i : i + 3].encode()) % 256] += 1
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm == 0, 1, norm)


def similarity_stats(s: np.ndarray) -> tuple[float, float]:
    """Least and mean similarity of a cluster's pairs; 1 for a single one."""
    upper = s[np.triu_indices(len(s), k=1)]
    return (float(upper.min()), float(upper.mean())) if len(upper) else (1.0, 1.0)


CLUSTER = "block_key string, surface string, cluster int, status string, min_similarity double, mean_similarity double"


def clusters(rows: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """(block_key, surface, cluster, status, min_similarity, mean_similarity): surfaces of a block joined by average linkage
    and checked by their least similarity; blocks over ``LARGEST`` different surfaces are left apart as
    ``block_too_large``. With ``thresholds``, every block is clustered at each of them instead of at its type's floor, and
    the result has the column ``threshold``."""
    surfaces = rows.groupBy("block_key", "mention_type", "surface").agg(F.count("*").alias("n"), F.max(is_acronym(F.col("mention_text"))).alias("acronym"))
    # an oversized block never reaches one task: it is labelled on the JVM side
    sizes = surfaces.groupBy("block_key").agg(F.count("*").alias("m"))
    sized = surfaces.join(sizes, "block_key")
    large = sized.where(F.col("m") > LARGEST).select("block_key", "surface", F.lit(0).alias("cluster"), F.lit("block_too_large").alias("status"), F.lit(1.0).alias("min_similarity"), F.lit(1.0).alias("mean_similarity"))
    alone = sized.where("m = 1").select("block_key", "surface", F.lit(0).alias("cluster"), F.when(F.col("n") > 1, "exact_surface").otherwise("singleton").alias("status"), F.lit(1.0).alias("min_similarity"), F.lit(1.0).alias("mean_similarity"))
    open_ = sized.where((F.col("m") > 1) & (F.col("m") <= LARGEST)).select("block_key", "mention_type", "surface", "n", "acronym")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("surface").reset_index(drop=True)
        x = profile(g["surface"].tolist())
        s = x @ x.T
        floor = ACRONYM if g["acronym"].any() else FLOORS.get(g["mention_type"].iloc[0], DEFAULT)
        out = []
        for threshold in thresholds or [None]:
            least = floor if threshold is None else ACRONYM if g["acronym"].any() else threshold
            labels = np.array(average_linkage(s, least))
            status, low, mean = [""] * len(g), [1.0] * len(g), [1.0] * len(g)
            for label in np.unique(labels):
                own = np.flatnonzero(labels == label)
                lo, mid = similarity_stats(s[np.ix_(own, own)])
                for k in own:
                    low[k], mean[k] = lo, mid
                    status[k] = ("exact_surface" if g["n"][k] > 1 else "singleton") if len(own) == 1 else "clustered" if lo >= least - 1e-9 else "rejected_min_similarity"
            part = pd.DataFrame({"block_key": g["block_key"], "surface": g["surface"], "cluster": labels, "status": status, "min_similarity": low, "mean_similarity": mean})
            out.append(part if threshold is None else part.assign(threshold=threshold))
        return pd.concat(out)

    done = open_.groupBy("block_key").applyInPandas(run, CLUSTER + (", threshold double" if thresholds else ""))
    rest = alone.union(large)
    if thresholds:
        rest = rest.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return done.union(rest)


def threshold_sweep(rows: DataFrame, gold: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, tp, pred_pairs, gold_pairs, precision, recall, f1): blocks clustered anew at every threshold, pairs of
    mentions in one cluster compared with those under one gold id (mention_id, gold)."""
    c = clusters(rows, thresholds)
    joined = F.col("status").isin("clustered", "exact_surface")
    pred = c.where(joined).select("threshold", "block_key", "surface", F.concat_ws("|", "block_key", F.col("cluster").cast("string")).alias("pred"))
    labels = rows.select("mention_id", "block_key", "surface").join(gold.select("mention_id", "gold"), "mention_id")
    levels = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    both = labels.select("*", levels).join(pred, ["threshold", "block_key", "surface"], "left")
    pairs = lambda x: (x * (x - 1) / 2).cast("bigint")
    tp = both.where("pred is not null and gold is not null").groupBy("threshold", "pred", "gold").agg(F.count("*").alias("n")).groupBy("threshold").agg(F.sum(pairs(F.col("n"))).alias("tp"))
    pp = both.where("pred is not null").groupBy("threshold", "pred").agg(F.count("*").alias("n")).groupBy("threshold").agg(F.sum(pairs(F.col("n"))).alias("pred_pairs"))
    gp = both.where("gold is not null").groupBy("threshold", "gold").agg(F.count("*").alias("n")).groupBy("threshold").agg(F.sum(pairs(F.col("n"))).alias("gold_pairs"))
    row = gp.join(pp, "threshold", "left").join(tp, "threshold", "left").na.fill(0, ["tp", "pred_pairs"])
    p, r = ratio(F.col("tp"), F.col("pred_pairs")), ratio(F.col("tp"), F.col("gold_pairs"))
    return row.select("threshold", "tp", "pred_pairs", "gold_pairs", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1(p, r), 6).alias("f1"))


def cluster_id(c) -> F.Column:
    """A cluster id, null where it is one of the names for none."""
    x = F.trim(c.cast("string"))
    return F.when((x != "") & ~F.upper(x).isin("NONE", "NULL", "NIL", "UNRESOLVED"), x)


def gold_summary(rows: DataFrame, gold: str = "gold_id") -> DataFrame:
    """Records, those with and without a gold id, clusters, clusters of two or more, their pairs, and generic mentions with an
    id. Rows need mention_text and mention_type."""
    g = F.when(F.trim(F.coalesce(gold, F.lit(""))) != "", F.trim(gold))
    rows = rows.select(g.alias("g"), is_generic(surface(F.col("mention_text")), F.upper("mention_type")).alias("generic"))
    per = rows.groupBy("g").agg(F.count("*").alias("n"), F.count_if("generic").alias("generic"))
    has = F.col("g").isNotNull()
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"),
        F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).alias("assigned_mentions"),
        F.coalesce(F.sum(F.when(~has, F.col("n"))), F.lit(0)).alias("unassigned_mentions"),
        F.count_if(has).alias("gold_clusters"),
        F.count_if(has & (F.col("n") >= 2)).alias("positive_clusters"),
        F.coalesce(F.sum(F.when(has, (F.col("n") * (F.col("n") - 1) / 2).cast("bigint"))), F.lit(0)).alias("positive_pairs"),
        F.coalesce(F.sum(F.when(has, F.col("generic"))), F.lit(0)).alias("generic_assigned_mentions"),
    )


def linkable_summary(spans: DataFrame, record: str, gold: str = "gold_entity") -> DataFrame:
    """Records, mentions, linkable mentions and NIL ones of gold spans."""
    nil = F.upper(F.coalesce(gold, F.lit(""))) == "NIL"
    return spans.agg(F.count_distinct(record).alias("records"), F.count("*").alias("mentions"), F.count_if(~nil).alias("linkable"), F.count_if(nil).alias("nil"))


def contingency(labels: DataFrame) -> DataFrame:
    """(pred, gold, n) of rows with both ids."""
    return labels.where("pred is not null and gold is not null").groupBy("pred", "gold").agg(F.count("*").alias("n"))


def pairwise(labels: DataFrame) -> DataFrame:
    """Pairs in one cluster, from counts n(n-1)/2: nothing is paired up."""
    c = contingency(labels)
    pairs = lambda x: x * (x - 1) / 2
    tp = c.agg(F.sum(pairs(F.col("n"))).cast("bigint").alias("tp")).withColumn("one", F.lit(1))
    pp = c.groupBy("pred").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).cast("bigint").alias("pred_pairs")).withColumn("one", F.lit(1))
    gp = c.groupBy("gold").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).cast("bigint").alias("gold_pairs")).withColumn("one", F.lit(1))
    row = tp.join(pp, "one").join(gp, "one")
    p, r = ratio(F.col("tp"), F.col("pred_pairs")), ratio(F.col("tp"), F.col("gold_pairs"))
    return row.select("tp", "pred_pairs", "gold_pairs", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1(p, r), 6).alias("f1"))


def purity(labels: DataFrame) -> DataFrame:
    """Purity, inverse purity and the share of all mentions that have a predicted cluster, of rows (pred, gold)."""
    c = contingency(labels)
    cover = labels.agg(F.round(ratio(F.count("pred"), F.count("*")), 6).alias("coverage")).withColumn("one", F.lit(1))
    total = c.agg(F.sum("n").alias("total")).withColumn("one", F.lit(1))
    a = c.groupBy("pred").agg(F.max("n").alias("m")).agg(F.sum("m").alias("p")).withColumn("one", F.lit(1))
    b = c.groupBy("gold").agg(F.max("n").alias("m")).agg(F.sum("m").alias("i")).withColumn("one", F.lit(1))
    return total.join(a, "one").join(b, "one").join(cover, "one").select("total", F.round(ratio(F.col("p"), F.col("total")), 6).alias("purity"), F.round(ratio(F.col("i"), F.col("total")), 6).alias("inverse_purity"), "coverage")

"""Query candidates and qrels: filters, validation, deduplication, deterministic sampling and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archipel.functions.text import quality, query_form, text_stats, word_count
from archipel.session import ranked

FRAMING = r"(?i)\b(this|the) (passage|chunk|document|article|transcript|text|source|page|image|video)\b"


def with_quality(chunks: DataFrame, text: str = "masked_text") -> DataFrame:
    stats = text_stats(F.col(text))
    rows = chunks.select("*", *(c.alias(n) for n, c in stats.items()))
    marks = quality(F.col(text), *(F.col(n) for n in ("text_token_count", "text_char_count", "unique_token_count", "alpha_ratio", "punctuation_noise_ratio")))
    return rows.select("*", *(c.alias(n) for n, c in marks.items()))


def public_candidates(chunks: DataFrame, tokens: int = 45, unique: int = 20, alpha: float = 0.45, noise: float = 0.35) -> DataFrame:
    q = with_quality(chunks)
    return q.where((F.lower("access_level") == "public") & F.col("masked_text").isNotNull() & (F.trim("masked_text") != "") & (F.col("text_token_count") >= tokens) & (F.col("unique_token_count") >= unique) & (F.col("alpha_ratio") >= alpha) & (F.col("punctuation_noise_ratio") <= noise) & ~F.col("is_metadata_only_like"))


def reject_reasons(query, expected, answer, kind, difficulty, rejected) -> F.Column:
    """Every reason against a generated qrel; a model's own rejection stands alone."""
    trimmed = lambda c: F.trim(F.coalesce(c, F.lit("")))
    q, e = trimmed(query), trimmed(expected)
    reasons = F.array(
        F.when(F.length(q) < 15, "query_too_short"),
        F.when(q.rlike(FRAMING), "query_mentions_source_frame"),
        F.when(F.length(e) < 30, "expected_information_too_short"),
        F.when(word_count(e) < 5, "expected_information_not_self_contained"),
        F.when(trimmed(answer) == "", "missing_reference_answer"),
        F.when(trimmed(kind) == "", "missing_query_type"),
        F.when(trimmed(difficulty) == "", "missing_difficulty"),
    )
    return F.when(F.coalesce(rejected, F.lit(False)), F.array(F.lit("model_rejected"))).otherwise(F.filter(reasons, lambda x: x.isNotNull()))


def deduplicated(qrels: DataFrame) -> DataFrame:
    """One qrel per normal form of its query: the first by (source_chunk_id, query_id)."""
    w = Window.partitionBy(query_form(F.col("query"))).orderBy("source_chunk_id", "query_id")
    return qrels.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def dice(seed: int, *keys: str) -> F.Column:
    """A number in [0, 1) from the keys: the same on every run and every cluster."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *keys)), 1, 8), 16, 10).cast("double") / 4294967296.0


def split_dev_test(rows: DataFrame, stratum: str, key: str, fraction: float = 0.3, seed: int = 42) -> DataFrame:
    """Adds ``split``: per stratum round-half-even(n x fraction) rows are dev, at least one and at most n - 1 if n > 1."""
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("_n"))
    n = F.col("_n")
    dev = F.when(n > 1, F.greatest(F.lit(1), F.least(F.bround(n * fraction), n - 1))).otherwise(F.bround(n * fraction))
    sized = rows.join(sizes, rows[stratum].eqNullSafe(sizes[stratum])).drop(sizes[stratum])
    return ranked(sized, [stratum], dice(seed, key), key, name="_r").withColumn("split", F.when(F.col("_r") <= dev, "dev").otherwise("test")).drop("_r", "_n")


def split_by_document(rows: DataFrame, document: str, fraction: float = 0.5, seed: int = 42) -> DataFrame:
    """Adds ``split``: whole documents are dev or test, round-half-even(documents x fraction) of them dev, at least one."""
    docs = rows.select(F.coalesce(document, F.lit("")).alias("_doc")).distinct()
    dev = max(1, round(docs.count() * fraction))
    dealt = ranked(docs, [], dice(seed, "_doc"), "_doc", name="_r").select("_doc", F.when(F.col("_r") <= dev, "dev").otherwise("test").alias("split"))
    return rows.withColumn("_doc", F.coalesce(document, F.lit(""))).join(dealt, "_doc").drop("_doc")


def split_by_label(rows: DataFrame, label: str, wanted: tuple = ("train", "dev", "test")) -> dict[str, DataFrame]:
    """The table's own splits; every wanted label must be there."""
    form = F.lower(F.coalesce(label, F.lit("")))
    have = {r[0] for r in rows.select(form.alias("x")).where(F.col("x").isin(*wanted)).distinct().collect()}  # at most the wanted ones
    if missing := sorted(set(wanted) - have):
        raise ValueError(f"splits without rows: {missing}")
    return {w: rows.where(form == w) for w in wanted}


def stratified_sample(rows: DataFrame, stratum: str | list[str], key: str, size: int, seed: int = 42, reserve: int = 1) -> DataFrame:
    """``size`` x ``reserve`` rows: an even share of every stratum first (at least one), the rest filled over all in random
    order. With a reserve, spare rows for those that are turned down later."""
    strata = [stratum] if isinstance(stratum, str) else stratum
    n, wanted = rows.select(*strata).distinct().count(), size * reserve
    base = max(1, wanted // max(n, 1))
    late = ranked(rows, strata, dice(seed, key), key, name="_r").withColumn("_late", (F.col("_r") > base).cast("int")).withColumn("_d", dice(seed, key))
    return late.orderBy("_late", "_d", key).limit(wanted).drop("_late", "_d", "_r")


def quota_sample(rows: DataFrame, band: str, family: str, key: str, size: int, quotas: dict[str, float], seed: int = 42) -> DataFrame:
    """Per score band its share of ``size``, dealt evenly to the families of the band in random order."""
    share = F.coalesce(F.element_at(F.create_map(*[x for b, q in quotas.items() for x in (F.lit(b), F.lit(round(size * q)))]), F.col(band)), F.lit(0))
    turns = ranked(rows, [band, family], dice(seed, key), key, name="_turn").where(F.col("_turn") <= share)  # no family can have more
    place = F.row_number().over(Window.partitionBy(band).orderBy("_turn", family, key))  # families x share rows at most
    return turns.withColumn("_place", place).where(F.col("_place") <= share).drop("_turn", "_place")


def by_family(stats: DataFrame, family: str, score: str, key: str, size: int) -> DataFrame:
    """``size`` rows: the best of every family in even shares, then the best of all that are left."""
    per = max(1, size // max(1, stats.select(family).distinct().count()))
    best = Window.partitionBy(family).orderBy(F.desc(score), key)
    first = stats.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= per).drop("_r")  # only the best leave a partition
    rest = stats.join(first.select(key), key, "left_anti").select(*stats.columns).orderBy(F.desc(score), key).limit(size)
    every = first.withColumn("_late", F.lit(0)).union(rest.withColumn("_late", F.lit(1)))
    return every.orderBy("_late", F.when(F.col("_late") == 0, F.col(family)), F.desc(score), key).limit(size).drop("_late")


def sample_chunks(stats: DataFrame, dev: int = 500, test: int = 500, seed: int = 42) -> DataFrame:
    """Adds ``split`` to a sample of promising chunks (chunk_id, document_id, primary_family, promising_score): no document
    is in both splits, and within a split every relation family has its share."""
    split = split_by_document(stats, "document_id", 0.5, seed)
    parts = [by_family(split.where(F.col("split") == name), "primary_family", "promising_score", "chunk_id", size) for name, size in (("dev", dev), ("test", test))]
    return parts[0].union(parts[1])


def sample_groups(rows: DataFrame, group: list[str], size: int, rich: float = 0.7, least: int = 2, most: int = 8, strata: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Mentions for annotation, with ``split`` (dev, test): a share ``rich`` of ``size`` from whole repeated groups of
    ``group`` (up to ``most`` of each, larger groups first), the rest spread over the strata. Rows without a group key
    only count for the strata. Rows need ``mention_id``; a repeated row counts once."""
    rows = rows.dropDuplicates(["mention_id"])
    wanted = round(size * rich)
    keyed = rows
    for c in group:
        keyed = keyed.where(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "")
    inside = ranked(keyed, group, dice(seed, "mention_id"), "mention_id", name="_in").where(F.col("_in") <= most)
    sizes = inside.groupBy(*group).agg(F.count("*").alias("_n"), F.min("mention_id").alias("_first")).where(F.col("_n") >= least)
    order = sizes.orderBy(F.desc("_n"), dice(seed, "_first"), "_first").limit(wanted)  # each has two mentions or more
    reach = F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("_n"), dice(seed, "_first"), "_first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = order.withColumn("_before", reach).where(F.col("_before") < wanted).select(*group)
    cluster = inside.join(chosen, group, "left_semi").select(*rows.columns)
    others = rows.join(cluster.select("mention_id"), "mention_id", "left_anti").select(*rows.columns)
    background = stratified_sample(others, strata or group[:1], "mention_id", size, seed)
    every = cluster.withColumn("_late", F.lit(0)).union(background.withColumn("_late", F.lit(1)))
    taken = every.orderBy("_late", dice(seed, "mention_id"), "mention_id").limit(size).drop("_late")
    half = F.row_number().over(Window.orderBy(dice(seed + 1, "mention_id"), "mention_id"))  # ``size`` rows
    return taken.withColumn("_r", half).withColumn("split", F.when(F.col("_r") <= (size + 1) // 2, "dev").otherwise("test")).drop("_r")


def first_queries(rows: DataFrame, n: int, order: str = "line") -> DataFrame:
    """Rows of the first ``n`` different queries, in the order they appear."""
    first = rows.groupBy("query_id").agg(F.min(order).alias("_at")).orderBy("_at", "query_id").limit(n)
    return rows.join(F.broadcast(first.select("query_id")), "query_id", "left_semi") if n <= 100_000 else rows.join(first.select("query_id"), "query_id", "left_semi")


def valid_only(qrels: DataFrame) -> DataFrame:
    """Qrels that are not marked invalid; one without a mark counts as valid."""
    return qrels.where(F.coalesce("is_valid", F.lit(True))) if "is_valid" in qrels.columns else qrels


def selected(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ``ids``."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")

"""Session helpers: tables, checkpoints and spreading of narrow inputs."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Only where that is unset
    (a local test session, never a cluster) a folder of our own is made and registered."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="archipel-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and cut its lineage; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Frees the shuffle files and checkpoints that nothing refers to any more; Spark frees them when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slots(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str, per_slot: int = 2) -> DataFrame:
    """Give a costly Python stage at least as many partitions as the cluster has cores.

    Without keys ``df`` must be a plain scan: one that has fewer partitions than needed (a small table) is
    redistributed, a wide one is left as it is, without a shuffle. With keys, rows are hash-partitioned by them into a
    fixed number of partitions, which a following aggregation or distinct over them reuses.
    """
    wanted = slots(df.sparkSession) * per_slot
    if keys:
        wide = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return df.repartition(max(wanted, wide), *keys)
    return df if df.rdd.getNumPartitions() >= wanted // 2 else df.repartition(wanted)


RANGE = 4096  # rows of a group ranked by one task


def ranked(rows: DataFrame, by: list[str], place, *order, name: str = "_rank", size: int = RANGE) -> DataFrame:
    """Adds the row's number within ``by``, from one, in the order of ``place`` (a number in [0, 1)) and then ``order``.

    A group is cut into ranges of ``place`` of about ``size`` rows; rows are numbered within a range and shifted by what
    the ranges before it hold, so no group, however large, is sorted by one task. ``place`` must be spread evenly, as a
    hash is.
    """
    keys = [F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(f"_k{i}") for i, k in enumerate(by)] or [F.lit("").alias("_k0")]
    names = [f"_k{i}" for i in range(max(1, len(by)))]
    placed = rows.select("*", *keys, place.alias("_place"))
    parts = placed.groupBy(*names).agg(F.ceil(F.count("*") / size).alias("_parts"))
    ranged = placed.join(parts, names).withColumn("_range", F.floor(F.col("_place") * F.col("_parts")).cast("bigint"))
    counts = ranged.groupBy(*names, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*names).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select(*names, "_range", F.coalesce(before, F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy(*names, "_range").orderBy("_place", *order))
    out = ranged.withColumn("_inside", inside).join(shifts, [*names, "_range"]).withColumn(name, (F.col("_inside") + F.col("_shift")).cast("bigint"))
    return out.select(*rows.columns, name)

"""Checkpointed incremental work: each unit is done once, and a restart goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archipel.sources.tables import append_new


def remaining(units: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return units.join(done.select(key).distinct(), key, "left_anti")


def run_stream(spark: SparkSession, source: str, schema: str, sink: str, key: list[str], checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> int:
    """File stream through ``work`` into a Parquet table, batch by batch; a replayed batch adds nothing. Ends when the
    files there are have been read; returns the number of rows in the sink."""

    def one(batch: DataFrame, _: int) -> None:
        append_new(work(batch), sink, key)

    q = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(sink).count()


def late_counts(events: DataFrame, time: str, arrived: str, window: str = "1 day", late: str = "INTERVAL 1 DAY") -> DataFrame:
    """Events per window, and how many of them arrived late."""
    behind = F.col(arrived) > F.col(time) + F.expr(late)
    return events.groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("n"), F.count_if(behind).alias("late")).select(F.col("w.start").alias("window_start"), "n", "late")

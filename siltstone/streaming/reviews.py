"""Streams of findings and events. These are Spark's own additions: the batch operators cover all that a review needs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.state import recorded


def once_delivered(findings: DataFrame, at: str = "created_at", late: str = "7 days") -> DataFrame:
    """Findings without repeats of a finding_seq that come within `late` of each other; state older than that is dropped."""
    return findings.withWatermark(at, late).dropDuplicatesWithinWatermark(["finding_seq"])


def windowed_counts(events: DataFrame, at: str, keys: list[str], width: str, late: str) -> DataFrame:
    """start, end, keys and n of every window of `width`, final once the watermark has passed it; rows later than `late` aren't counted."""
    counts = events.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def recording(folder: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the table of what was reviewed last in versions below folder.

    Batch n reads version n - 1 and writes n, so a batch that is run again after a failure gives the same table.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.select("key", "last_sha", "run_id", "updated")
        old = spark.read.schema(new.schema).parquet(f"{folder}/v{epoch - 1}") if epoch else spark.createDataFrame([], new.schema)
        latest = new.groupBy("key").agg(F.max(F.struct("updated", "last_sha", "run_id")).alias("m")).select("key", "m.last_sha", "m.run_id", "m.updated")
        recorded(old, latest).write.mode("overwrite").parquet(f"{folder}/v{epoch}")

    return each

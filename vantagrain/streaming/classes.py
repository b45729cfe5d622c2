"""Equivalence-class sizes under Structured Streaming.

Counts are mergeable, so class sizes (and what follows from them: k-anonymity,
attacker and individual risk) can be maintained as records are released.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def class_sizes(stream: DataFrame, keys: Sequence[str], *, time_col: str | None = None, watermark: str = "1 hour", window: str | None = None) -> DataFrame:
    """(keys[, window], f): running class sizes; by tumbling windows of event
    time if ``window`` is given, with rows later than the watermark left out."""
    if window:
        rows = stream.withWatermark(time_col, watermark)
        return rows.groupBy(F.window(time_col, window), *keys).agg(F.count(F.lit(1)).alias("f"))
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("f"))


def k_level_sink(path: str):
    """A foreachBatch function that keeps the k-anonymity summary of the latest
    complete-mode batch as Parquet under ``path``; rewriting a batch is safe."""

    def write(batch: DataFrame, epoch: int) -> None:
        found = batch.agg(F.min("f").alias("k_level"), F.sum("f").alias("n_records"), F.count(F.lit(1)).alias("n_ec"), F.count_if(F.col("f") == 1).alias("n_unique"))
        found.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write

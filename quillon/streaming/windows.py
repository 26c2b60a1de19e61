"""Event-time windows of a stream: counts, means and spreads per window, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.errors import require


def windowed_summary(stream: DataFrame, time: str, value: str, window: str, watermark: str, by: list[str] | None = None, slide: str | None = None) -> DataFrame:
    """start, end, groups, n, sum, mean, std_dev, min, max. Works on batch frames too, where the watermark does nothing.
    One pass, so the spread is Spark's own; for values far from 0 use stats.descriptive on the batch."""
    require(bool(window) and bool(watermark), "a window and a watermark are needed")
    by = by or []
    x = F.col(value).cast("double")
    grouped = stream.withWatermark(time, watermark).groupBy(F.window(time, window, slide) if slide else F.window(time, window), *by)
    out = grouped.agg(F.count(x).alias("n"), F.sum(x).alias("sum"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std_dev"), F.min(x).alias("min"), F.max(x).alias("max"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "sum", "mean", "std_dev", "min", "max")


def running_fusion(stream: DataFrame, sink, k: int = 60, key: str = "key", position: str = "position", ranking: str = "ranking", by: list[str] | None = None):
    """A stream writer that fuses the rankings of each micro-batch and hands the result to sink(df, batch id)."""
    from quillon.operators.retrieval.search import reciprocal_rank_fusion

    return stream.writeStream.foreachBatch(lambda df, n: sink(reciprocal_rank_fusion(df, k, key, position, ranking, by), n))

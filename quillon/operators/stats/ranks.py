"""Midranks and ties. A value's rank is the mean of the places its ties take, from 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.errors import require
from quillon.plans.prefix import running_total


def no_nan(df: DataFrame, *columns: str) -> None:
    found = df.agg(*(F.max(F.isnan(c)).alias(c) for c in columns)).first()
    require(not any(found), "ranks are undefined for NaN")


def tie_sizes(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """value and ties (1 for a value met once), ascending."""
    by = by or []
    return df.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("value")).agg(F.count("*").alias("ties")).orderBy(*by, "value")


def tied_pairs(df: DataFrame, column: str) -> int:
    """Pairs of equal values."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).count().agg(F.coalesce(F.sum(F.expr("count * (count - 1) div 2")), F.lit(0))).first()[0]


def midranks(df: DataFrame, column: str, name: str = "midrank", by: list[str] | None = None) -> DataFrame:
    """df (rows with a value) with their midranks. Within groups, by a window; over the whole table, from running totals of
    the distinct values' counts, so that no task gets all rows."""
    rows = df.filter(F.col(column).isNotNull())
    no_nan(rows, column)
    if by:
        w = Window.partitionBy(*by)
        ties = F.count("*").over(w.partitionBy(*by, column))
        return rows.withColumn(name, F.rank().over(w.orderBy(column)) + (ties - 1) / 2)
    counts = rows.groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    ranked = running_total(counts, [F.col("_v")], F.col("_n"), "_upto").select("_v", (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))
    return rows.join(ranked, rows[column] == ranked["_v"]).drop("_v")

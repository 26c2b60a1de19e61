"""Running totals over a global order without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.iterate import settled


def running_extreme(df: DataFrame, order: list[Column], value: Column, name: str, largest: bool) -> DataFrame:
    """df with `name`, the largest (or smallest) value of all rows before and including each in that order; like
    running_total()."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pick, choose, join = (F.max, max, F.greatest) if largest else (F.min, min, F.least)
    dealt = settled(df.withColumn("_value", value).repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    tops = {r["_range"]: r["t"] for r in dealt.groupBy("_range").agg(pick("_value").alias("t")).collect()}
    before, held = {}, None
    for k in sorted(tops):
        if held is not None:
            before[k] = held
        held = tops[k] if held is None else choose(held, tops[k])
    offset = F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("_range")) if before else F.lit(None).cast("double")
    own = pick("_value").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn(name, join(own, offset)).drop("_value", "_range")


def quantiles(df: DataFrame, column: str, ps: list[float], by: list[str] | None = None, name: str = "_q") -> DataFrame:
    """The columns `by` and `name`, an array of the quantiles `ps` by linear interpolation, of each group's values that aren't
    null. From running totals of the distinct values' counts over the order of (by, value): neither a buffer nor a window
    holds a group."""
    by = by or []
    keys = [f"_k{i}" for i in range(len(by))]
    counts = df.filter(F.col(column).isNotNull()).groupBy(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    placed = running_total(counts, [*(F.col(k) for k in keys), F.col("_v")], F.col("_n"), "_upto")
    size = placed.groupBy(*keys).agg(F.min(F.col("_upto") - F.col("_n")).alias("_before"), F.sum("_n").alias("_size"))
    if keys:
        group = size.select(*(F.col(k).alias(f"{k}_") for k in keys), "_before", "_size")
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"{k}_"))
        placed = placed.join(group, on)
    else:
        r = size.first()
        placed = placed.withColumns({"_before": F.lit(r["_before"] or 0), "_size": F.lit(r["_size"] or 0)})
    high = F.col("_upto") - F.col("_before")
    low = high - F.col("_n")
    at = [(F.col("_size") - 1) * F.lit(float(p)) for p in ps]
    ends = [F.max(F.when((low <= k) & (k < high), F.col("_v"))).alias(f"_{e}{i}") for i, h in enumerate(at) for e, k in (("a", F.floor(h)), ("b", F.ceil(h)))]
    found = placed.groupBy(*keys).agg(F.first("_size").alias("_size"), *ends)
    part = [h - F.floor(h) for h in at]
    values = [F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * w for i, w in enumerate(part)]
    return found.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=True)), F.array(*values).alias(name))


def running_total(df: DataFrame, order: list[Column], value: Column, name: str, partitions: int | None = None) -> DataFrame:
    """df with `name`, the sum of value over all rows before and including each in that order. Rows are range-sorted; totals
    of the ranges, one number each, are added on the driver and each range continues from its predecessor's. Rows that
    compare equal must not matter to each other (order by a key)."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled(df.withColumn("_value", value).repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    totals = {r["_range"]: r["t"] for r in dealt.groupBy("_range").agg(F.sum("_value").alias("t")).collect()}
    before, start = {}, 0
    for k in sorted(totals):
        before[k] = start
        start += totals[k] or 0
    offset = F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("_range")) if before else F.lit(0)
    own = F.sum("_value").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn(name, own + offset).drop("_value", "_range")

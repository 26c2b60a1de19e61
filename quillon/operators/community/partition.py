"""Partitions as (node, community): numbers 0 .. k - 1 by first appearance in node order, -1 for nodes left out by a size
filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.errors import require
from quillon.plans.prefix import running_total


def canonical(df: DataFrame, label: str, node: str = "node") -> DataFrame:
    """node, community from any labels; -1 stays -1."""
    own = df.select(F.col(node).cast("long").alias("node"), F.col(label).alias("_label"))
    first = own.filter(F.coalesce(F.col("_label").cast("string"), F.lit("")) != "-1").groupBy("_label").agg(F.min("node").alias("_first"))
    numbered = running_total(first, [F.col("_first")], F.lit(1), "_n").select("_label", (F.col("_n") - 1).cast("int").alias("community"))
    return own.join(numbered, "_label", "left").select("node", F.coalesce("community", F.lit(-1)).alias("community"))


def singletons(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("node"), F.col("id").cast("int").alias("community"))


def single(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("node"), F.lit(0).alias("community"))


def count(p: DataFrame) -> int:
    return p.filter("community >= 0").agg(F.coalesce(F.max("community") + 1, F.lit(0))).first()[0]


def order(p: DataFrame) -> int:
    return p.count()


def communities(p: DataFrame) -> DataFrame:
    """community, nodes ascending."""
    return p.filter("community >= 0").groupBy("community").agg(F.sort_array(F.collect_list("node")).alias("nodes")).orderBy("community")


def community_of(p: DataFrame, node: int) -> int:
    found = p.filter(F.col("node") == node).first()
    require(found is not None, f"there is no node {node}")
    return found["community"]


def nodes_in(p: DataFrame, community: int) -> DataFrame:
    found = p.filter(F.col("community") == community).select("node").orderBy("node")
    require(community >= 0 and bool(found.take(1)), f"there is no community {community}")
    return found


def sizes(p: DataFrame) -> DataFrame:
    return p.filter("community >= 0").groupBy("community").agg(F.count("*").alias("size")).orderBy("community")


def equals(a: DataFrame, b: DataFrame) -> bool:
    """The same grouping, whatever the labels."""
    x, y = canonical(a, "community"), canonical(b, "community")
    return x.count() == y.count() and not x.exceptAll(y).take(1)


def has_unassigned(p: DataFrame) -> bool:
    return bool(p.filter("community = -1").take(1))


def without_small(p: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The partition with communities of fewer than k nodes dissolved (their nodes at -1) and renumbered; the nodes left out."""
    require(k >= 1, "a community size must be at least 1")
    n = p.groupBy("community").agg(F.count("*").alias("_n"))
    marked = p.join(n, "community").select("node", F.when(F.col("_n") >= k, F.col("community")).otherwise(-1).alias("label"))
    out = canonical(marked, "label")
    return out, out.filter("community = -1").select("node").orderBy("node")

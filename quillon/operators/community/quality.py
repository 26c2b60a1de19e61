"""Objectives of community detection and scores of partitions.

Scores take a graph and a partition (node, community); partitions with nodes left out (-1) are refused. Sums run over edges
and communities by two aggregations.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.errors import InvalidArgument, require
from quillon.operators.graph.frame import Graph


class QualityFunction(Protocol):
    """What a community search optimises. gain: of a node with weight w into a community, strength k and size n, against a
    community of strength total K and size N; two_m is the graph's total endpoint weight."""

    resolution: float

    def bound_to(self, g: Graph) -> QualityFunction: ...

    def gain(self, w: float, k: float, n: float, big_k: float, big_n: float, two_m: float) -> float: ...

    def of(self, g: Graph, p: DataFrame) -> float: ...


def _sums(g: Graph, p: DataFrame) -> DataFrame:
    """community, inside (weight, loops once), edges (their number), strength, size."""
    g.need_undirected("partition scores")
    r = p.agg(F.count("*").alias("n"), F.min("community").alias("low")).first()
    require(r["n"] == g.order(), "the partition covers another number of nodes than the graph has")
    require(r["low"] is None or r["low"] >= 0, "the partition leaves nodes out")
    own = p.select("node", "community")
    ends = g.edges.join(own.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(own.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
    inside = ends.filter("a = b").groupBy(F.col("a").alias("community")).agg(F.sum("weight").alias("inside"), F.count("*").alias("edges"))
    size = own.join(g.degrees(), "node").groupBy("community").agg(F.count("*").alias("size"), F.sum("strength").alias("strength"))
    return size.join(inside, "community", "left").na.fill({"inside": 0.0, "edges": 0})


def _checked(resolution: float) -> None:
    require(resolution >= 0 and math.isfinite(resolution), "a resolution must not be negative")


@dataclass(frozen=True)
class Modularity:
    resolution: float = 1.0

    def __post_init__(self):
        _checked(self.resolution)

    def bound_to(self, g: Graph) -> Modularity:
        return self

    def gain(self, w: float, k: float, n: float, big_k: float, big_n: float, two_m: float) -> float:
        return w - self.resolution / two_m * k * big_k if two_m else 0.0

    def threshold(self, k: float, n: float, big_k: float, big_n: float, two_m: float) -> float:
        """Weight that a part needs to the rest of its community to be well connected."""
        return self.resolution * k * big_k / two_m if two_m else 0.0

    def of(self, g: Graph, p: DataFrame) -> float:
        two_m = g.total_endpoint_weight()
        sums = _sums(g, p)
        if not two_m:
            return 0.0
        share = F.col("strength") / F.lit(two_m)
        return sums.agg(F.sum(2 * F.col("inside") / F.lit(two_m) - F.lit(self.resolution) * share * share)).first()[0] or 0.0


@dataclass(frozen=True)
class ConstantPotts:
    resolution: float = 1.0

    def __post_init__(self):
        _checked(self.resolution)

    def bound_to(self, g: Graph) -> ConstantPotts:
        return self

    def gain(self, w: float, k: float, n: float, big_k: float, big_n: float, two_m: float) -> float:
        return w - self.resolution * n * big_n

    def threshold(self, k: float, n: float, big_k: float, big_n: float, two_m: float) -> float:
        return self.resolution * n * big_n

    def of(self, g: Graph, p: DataFrame) -> float:
        n = F.col("size").cast("double")
        return _sums(g, p).agg(F.sum(F.col("inside") - F.lit(self.resolution) * n * (n - 1) / 2)).first()[0] or 0.0


def density_of(g: Graph) -> float:
    n = g.order()
    return g.total_weight() / (n * (n - 1) / 2) if n > 1 else 0.0


@dataclass(frozen=True)
class ErdosRenyiPotts:
    resolution: float = 1.0
    density: float | None = None

    def __post_init__(self):
        _checked(self.resolution)

    def bound_to(self, g: Graph) -> ErdosRenyiPotts:
        return replace(self, density=density_of(g))

    def _bound(self) -> float:
        if self.density is None:
            raise InvalidArgument("this objective must be bound to a graph first")
        return self.resolution * self.density

    def gain(self, w: float, k: float, n: float, big_k: float, big_n: float, two_m: float) -> float:
        return w - self._bound() * n * big_n

    def threshold(self, k: float, n: float, big_k: float, big_n: float, two_m: float) -> float:
        return self._bound() * n * big_n

    def of(self, g: Graph, p: DataFrame) -> float:
        return ConstantPotts(self.resolution * density_of(g)).of(g, p)


ReichardtBornholdt = Modularity


def kullback_leibler(observed: float, expected: float) -> float:
    """Of two coins, in nats; 0 * log 0 = 0; 0 where expected is not inside (0, 1)."""
    if not 0 < expected < 1:
        return 0.0
    out = observed * math.log(observed / expected) if observed > 0 else 0.0
    return out + ((1 - observed) * math.log((1 - observed) / (1 - expected)) if observed < 1 else 0.0)


def kullback_leibler_column(observed, expected):
    a = F.when(observed > 0, observed * F.log(observed / F.nullif(expected, F.lit(0.0)))).otherwise(0.0)
    b = F.when(observed < 1, (1 - observed) * F.log((1 - observed) / F.nullif(1 - expected, F.lit(0.0)))).otherwise(0.0)
    return F.when((expected > 0) & (expected < 1), a + b).otherwise(0.0)


def _pairs():
    n = F.col("size").cast("double")
    return n * (n - 1) / 2


class Surprise:
    """Edges times the divergence of the inside edges' share from the inside pairs' share; weights don't count."""

    def of(self, g: Graph, p: DataFrame) -> float:
        r = _sums(g, p).agg(F.sum("edges").alias("e"), F.sum(_pairs()).alias("pairs")).first()
        m, n = g.size(), g.order()
        whole = n * (n - 1) / 2
        if not m or not whole:
            return 0.0
        return m * kullback_leibler(r["e"] / m, r["pairs"] / whole)


class Significance:
    """Pairs of each community times the divergence of its density from the graph's; weights don't count."""

    def of(self, g: Graph, p: DataFrame) -> float:
        n = g.order()
        whole = n * (n - 1) / 2
        sums = _sums(g, p)
        if not whole:
            return 0.0
        pairs = _pairs()
        inner = F.when(pairs > 0, pairs * kullback_leibler_column(F.col("edges") / F.nullif(pairs, F.lit(0.0)), F.lit(g.size() / whole))).otherwise(0.0)
        return sums.agg(F.sum(inner)).first()[0] or 0.0

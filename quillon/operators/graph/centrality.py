"""PageRank, eigenvector, Katz and HITS. A graph that fits one task is iterated there; a larger one by supersteps, one join
and one aggregation each, with the scalars they need (dangling mass, norms, drift) taken from the same aggregates."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.errors import DidNotConverge, require
from quillon.iterate import Steps, settled
from quillon.operators.graph import kernels
from quillon.operators.graph.frame import Graph


def _scores(c: kernels.Csr, x: np.ndarray) -> dict:
    return {"node": np.arange(c.order), "score": x}


def _gathered(g: Graph, x: DataFrame, value: str, reverse: bool = False) -> DataFrame:
    """node, in: the weighted sum over arcs into each node (out of it, reversed)."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    own = x.select(F.col("node").alias(a), F.col(value).alias("_v"))
    return g.arcs.join(own, a).groupBy(F.col(b).alias("node")).agg(F.sum(F.col("_v") * F.col("weight")).alias("in"))


@dataclass(frozen=True)
class PageRank:
    damping: float = 0.85
    tolerance: float = 1e-12
    max_iterations: int = 1000

    def __post_init__(self):
        require(0 < self.damping < 1, "damping must be above 0 and below 1")
        require(self.tolerance > 0, "tolerance must be positive")
        require(self.max_iterations >= 1, "there must be an iteration")

    def of(self, g: Graph, personalisation: DataFrame | None = None) -> DataFrame:
        """node, score; sums to 1. personalisation: node, weight. Dangling nodes restart where walks restart."""
        if g.is_empty():
            return g.nodes().withColumn("score", F.lit(0.0))
        require(g.lightest is None or g.lightest >= 0, "PageRank needs weights that aren't negative")
        if personalisation is None:
            teleport = g.nodes().withColumn("t", F.lit(1.0 / g.order()))
        else:
            own = personalisation.groupBy(F.col("node").cast("long").alias("node")).agg(F.sum(F.col("weight").cast("double")).alias("w"))
            r = own.agg(F.min("w").alias("low"), F.sum("w").alias("all"), F.min("node").alias("a"), F.max("node").alias("b")).first()
            require(r["low"] is not None and r["low"] >= 0 and r["all"] > 0, "personalisation needs a positive weight and none below 0")
            require(r["a"] >= 0 and r["b"] < g.order(), "personalisation names a node outside the graph")
            teleport = g.nodes().join(own, "node", "left").select("node", (F.coalesce("w", F.lit(0.0)) / F.lit(r["all"])).alias("t"))
        if g.fits:
            if personalisation is None:
                start = np.full(g.order(), 1.0 / g.order())
            else:
                t = teleport.filter("t > 0").toArrow()
                start = np.zeros(g.order())
                start[t["node"].to_numpy()] = t["t"].to_numpy()
            return g.in_one_task(lambda c: _scores(c, kernels.pagerank(c, start, self.damping, self.tolerance, self.max_iterations)), "node long, score double")
        return self._stepwise(g, teleport)

    def _stepwise(self, g: Graph, teleport: DataFrame) -> DataFrame:
        steps = Steps(g.spark)
        total = g.arcs.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("w"))
        static = settled(teleport.join(total, "node", "left").select("node", "t", F.coalesce("w", F.lit(0.0)).alias("w")))
        shares = settled(g.arcs.join(total.select(F.col("node").alias("src"), "w"), "src").filter("w > 0").select("src", "dst", (F.col("weight") / F.col("w")).alias("share")))
        x = static.select("node", F.col("t").alias("score"), F.lit(0.0).alias("was"), "t", "w")
        loose = x.filter("w = 0").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
        for _ in range(self.max_iterations):
            into = shares.join(x.select(F.col("node").alias("src"), "score"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("share")).alias("in"))
            new = F.lit(self.damping) * (F.coalesce("in", F.lit(0.0)) + F.lit(loose) * F.col("t")) + F.lit(1 - self.damping) * F.col("t")
            x = steps.keep(x.select("node", F.col("score").alias("was"), "t", "w").join(into, "node", "left").select("node", new.alias("score"), "was", "t", "w"))
            drift, loose, whole = x.agg(F.sum(F.abs(F.col("score") - F.col("was"))), F.coalesce(F.sum(F.when(F.col("w") == 0, F.col("score"))), F.lit(0.0)), F.sum("score")).first()
            if drift < g.order() * self.tolerance:
                return x.select("node", (F.col("score") / F.lit(whole)).alias("score"))
        raise DidNotConverge(f"PageRank did not converge in {self.max_iterations} iterations")


@dataclass(frozen=True)
class Eigenvector:
    tolerance: float = 1e-12
    max_iterations: int = 10_000

    def __post_init__(self):
        require(self.tolerance > 0, "tolerance must be positive")

    def of(self, g: Graph) -> DataFrame:
        """Power iteration on A + cI, c the largest strength, so bipartite graphs settle; norm 1; uniform without edges."""
        if g.is_empty():
            return g.nodes().withColumn("score", F.lit(0.0))
        if g.fits:
            return g.in_one_task(lambda c: _scores(c, kernels.eigenvector(c, self.tolerance, self.max_iterations)), "node long, score double")
        x = g.nodes().withColumn("score", F.lit(1 / math.sqrt(g.order())))
        if not g.size():
            return x
        shift = g.degrees().agg(F.max("strength")).first()[0]
        steps = Steps(g.spark, depth=3)
        for _ in range(self.max_iterations):
            raw = steps.keep(x.join(_gathered(g, x, "score"), "node", "left").select("node", F.col("score").alias("was"), (F.coalesce("in", F.lit(0.0)) + F.lit(shift) * F.col("score")).alias("raw")))
            norm = math.sqrt(raw.agg(F.sum(F.col("raw") * F.col("raw"))).first()[0])
            x = raw.select("node", (F.col("raw") / F.lit(norm)).alias("score"))
            if raw.agg(F.sum(F.abs(F.col("raw") / F.lit(norm) - F.col("was")))).first()[0] < g.order() * self.tolerance:
                return x
        raise DidNotConverge(f"eigenvector centrality did not converge in {self.max_iterations} iterations")


def spectral_radius(g: Graph) -> float:
    """Of the weights' matrix, by shifted power iteration; the largest strength, a safe bound, where that doesn't settle."""
    if not g.size():
        return 0.0
    if g.fits:
        return g.in_one_task(lambda c: {"value": [kernels.spectral_radius(c)]}, "value double").first()[0]
    bound = g.arcs.groupBy("src").agg(F.sum(F.abs("weight")).alias("w")).agg(F.max("w")).first()[0]
    x, value, steps = g.nodes().withColumn("score", F.lit(1 / math.sqrt(g.order()))), 0.0, Steps(g.spark, depth=3)
    for _ in range(1000):
        raw = steps.keep(x.join(_gathered(g, x, "score"), "node", "left").select("node", (F.coalesce("in", F.lit(0.0)) + F.lit(bound) * F.col("score")).alias("raw")))
        norm = math.sqrt(raw.agg(F.sum(F.col("raw") * F.col("raw"))).first()[0])
        if abs(norm - value) <= 1e-12 * norm:
            return norm - bound
        x, value = raw.select("node", (F.col("raw") / F.lit(norm)).alias("score")), norm
    return bound


def critical_alpha(g: Graph) -> float:
    radius = spectral_radius(g)
    return math.inf if radius <= 0 else 1 / radius


@dataclass(frozen=True)
class Katz:
    alpha: float = 0.05
    beta: float = 1.0
    tolerance: float = 1e-12
    max_iterations: int = 10_000

    def __post_init__(self):
        require(self.alpha > 0, "alpha must be positive")

    def is_convergent(self, g: Graph) -> bool:
        return self.alpha < critical_alpha(g)

    def of(self, g: Graph) -> DataFrame:
        """x = alpha A x + beta, norm 1; an alpha that is not below 1 / spectral radius is refused."""
        if g.is_empty():
            return g.nodes().withColumn("score", F.lit(0.0))
        require(self.is_convergent(g), "alpha must be below the reciprocal of the spectral radius")
        if g.fits:
            return g.in_one_task(lambda c: _scores(c, kernels.katz(c, self.alpha, self.beta, self.tolerance, self.max_iterations)), "node long, score double")
        x, steps = g.nodes().withColumn("score", F.lit(float(self.beta))), Steps(g.spark)
        for _ in range(self.max_iterations):
            new = steps.keep(x.join(_gathered(g, x, "score"), "node", "left").select("node", F.col("score").alias("was"), (F.lit(self.alpha) * F.coalesce("in", F.lit(0.0)) + F.lit(self.beta)).alias("score")))
            drift, square = new.agg(F.sum(F.abs(F.col("score") - F.col("was"))), F.sum(F.col("score") * F.col("score"))).first()
            x = new.select("node", "score")
            if drift < g.order() * self.tolerance:
                return x.select("node", (F.col("score") / F.lit(math.sqrt(square))).alias("score"))
        raise DidNotConverge(f"Katz centrality did not converge in {self.max_iterations} iterations")


@dataclass(frozen=True)
class Hits:
    tolerance: float = 1e-14
    max_iterations: int = 5000

    def __post_init__(self):
        require(self.tolerance > 0, "tolerance must be positive")

    def of(self, g: Graph) -> DataFrame:
        """node, hub, authority, each adding up to 1; uniform without edges. Drift is measured on both."""
        if g.is_empty():
            return g.nodes().withColumns({"hub": F.lit(0.0), "authority": F.lit(0.0)})
        if g.fits:

            def kernel(c: kernels.Csr) -> dict:
                h, a = kernels.hits(c, self.tolerance, self.max_iterations)
                return {"node": np.arange(c.order), "hub": h, "authority": a}

            return g.in_one_task(kernel, "node long, hub double, authority double")
        x = g.nodes().withColumns({"hub": F.lit(1.0 / g.order()), "authority": F.lit(1.0 / g.order())})
        if not g.size():
            return x
        steps = Steps(g.spark, depth=4)
        for _ in range(self.max_iterations):
            a = steps.keep(x.join(_gathered(g, x, "hub"), "node", "left").select("node", "hub", F.col("authority").alias("old_a"), F.coalesce("in", F.lit(0.0)).alias("raw")))
            ta = a.agg(F.sum(F.abs("raw"))).first()[0] or 1.0
            a = a.withColumn("authority", F.col("raw") / F.lit(ta)).drop("raw")
            h = steps.keep(a.join(_gathered(g, a, "authority", reverse=True), "node", "left").select("node", "authority", "old_a", F.col("hub").alias("old_h"), F.coalesce("in", F.lit(0.0)).alias("raw")))
            th = h.agg(F.sum(F.abs("raw"))).first()[0] or 1.0
            full = h.withColumn("hub", F.col("raw") / F.lit(th))
            drift = full.agg(F.sum(F.abs(F.col("authority") - F.col("old_a")) + F.abs(F.col("hub") - F.col("old_h")))).first()[0]
            x = full.select("node", "hub", "authority")
            if drift < g.order() * self.tolerance:
                return x
        raise DidNotConverge(f"HITS did not converge in {self.max_iterations} iterations")

"""Hops, weighted distances, paths, and distance summaries. Ways follow the arrows; -1 where there is none."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.errors import require
from quillon.iterate import Steps, settled
from quillon.operators.graph import kernels
from quillon.operators.graph.frame import Graph
from quillon.operators.graph.twins import twins


def hops(g: Graph, source: int) -> DataFrame:
    """node, distance."""
    require(g.has_node(source), f"there is no node {source}")
    if g.fits:
        return g.in_one_task(lambda c: {"node": np.arange(c.order), "distance": kernels.bfs(c, source)}, "node long, distance long")
    steps = Steps(g.spark, depth=4)
    seen = g.spark.sql(f"SELECT {source}L AS node, 0L AS distance")
    front, d = seen, 0
    while True:
        d += 1
        new = g.arcs.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        front = steps.keep(new.withColumn("distance", F.lit(d).cast("long")))
        if not front.take(1):
            break
        seen = steps.keep(seen.unionByName(front))
    return g.nodes().join(seen, "node", "left").select("node", F.coalesce("distance", F.lit(-1)).alias("distance"))


def _relaxed(g: Graph, source: int) -> DataFrame:
    """node, distance, previous of every node with a way, by relaxation until nothing changes."""
    steps = Steps(g.spark, depth=3)
    start = g.spark.sql(f"SELECT {source}L AS node, 0D AS distance, -1L AS previous")
    best = front = start
    while True:
        offers = g.arcs.join(front.withColumnRenamed("node", "src"), "src")
        bad = offers.filter("weight < 0").limit(1)
        require(not bad.take(1), "a shortest path can't take a negative edge")
        offers = offers.groupBy(F.col("dst").alias("node")).agg(F.min(F.struct((F.col("distance") + F.col("weight")).alias("distance"), F.col("src").alias("previous"))).alias("new"))
        joined = best.join(offers, "node", "full").select(
            "node",
            F.when(F.col("new").isNull() | (F.col("distance") < F.col("new.distance")) | ((F.col("distance") == F.col("new.distance")) & (F.col("previous") <= F.col("new.previous"))), F.struct("distance", "previous")).otherwise(F.col("new")).alias("b"),
            (F.col("new").isNotNull() & (F.col("distance").isNull() | (F.col("new.distance") < F.col("distance")))).alias("changed"),
        )
        best = steps.keep(joined.select("node", "b.distance", "b.previous", "changed"))
        front = best.filter("changed").select("node", "distance")
        if not front.take(1):
            return best.select("node", "distance", "previous")
        best = best.select("node", "distance", "previous")


def _weighted(g: Graph, source: int) -> DataFrame:
    require(g.has_node(source), f"there is no node {source}")
    if g.fits:

        def kernel(c: kernels.Csr) -> dict:
            d, before = kernels.dijkstra(c, source)
            return {"node": np.arange(c.order), "distance": d, "previous": before}

        return g.in_one_task(kernel, "node long, distance double, previous long")
    found = _relaxed(g, source)
    return g.nodes().join(found, "node", "left").select("node", F.coalesce("distance", F.lit(-1.0)).alias("distance"), F.coalesce("previous", F.lit(-1)).alias("previous"))


def distances(g: Graph, source: int) -> DataFrame:
    """node, distance by weight; a negative edge on a way is refused."""
    return _weighted(g, source).select("node", "distance")


def shortest_path(g: Graph, source: int, target: int) -> list[int]:
    """Nodes from source to target, [] if there is no way; of equal ways the one over smallest predecessors. A graph that fits
    one task is followed there; in a larger one the nodes on the way are found by doubling steps, so a way of n edges takes
    log n joins."""
    require(g.has_node(target), f"there is no node {target}")
    if g.fits:
        require(g.has_node(source), f"there is no node {source}")

        def kernel(c: kernels.Csr) -> dict:
            d, before = kernels.dijkstra(c, source)
            way = [target] if d[target] >= 0 else []
            while way and way[-1] != source:
                way.append(int(before[way[-1]]))
            return {"at": np.arange(len(way)), "node": np.array(way[::-1], dtype=np.int64)}

        return [r["node"] for r in g.in_one_task(kernel, "at long, node long").orderBy("at").collect()]
    steps = Steps(g.spark, depth=3)
    found = steps.keep(_weighted(g, source))
    if found.filter((F.col("node") == target) & (F.col("distance") >= 0)).first() is None:
        return []
    jump = found.filter((F.col("previous") >= 0) & (F.col("node") != source)).select("node", F.col("previous").alias("to"))
    steps = Steps(g.spark, depth=4)
    way, span = g.spark.sql(f"SELECT {target}L AS node, 0L AS back"), 1
    while not way.filter(F.col("node") == source).take(1):
        more = way.join(jump, "node").select(F.col("to").alias("node"), (F.col("back") + span).alias("back"))
        way = steps.keep(way.unionByName(more).dropDuplicates(["node"]))
        jump = steps.keep(jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("far")), "to").select("node", F.col("far").alias("to")))
        span *= 2
    return [r["node"] for r in way.orderBy(F.desc("back")).collect()]


@dataclass(frozen=True)
class Distance:
    """eccentricity: node, eccentricity (within its component). Totals are over ordered pairs that are connected."""

    eccentricity: DataFrame
    total_distance: int
    reachable_pairs: int
    components: int
    order: int
    longest: int
    shortest: int

    def is_connected(self) -> bool:
        return self.components <= 1

    def diameter(self) -> float:
        return 0 if not self.order else self.longest if self.is_connected() else math.inf

    def radius(self) -> float:
        return 0 if not self.order else self.shortest if self.is_connected() else math.inf

    def average_shortest_path_length(self) -> float:
        if not self.is_connected():
            return math.inf
        return self.total_distance / self.reachable_pairs if self.reachable_pairs else 0.0


def _sweep(g: Graph, what: str) -> DataFrame:
    """node, ecc, total, reached, harmonic, low: one breadth-first search a class of twins over the broadcast classes."""
    found = twins(g, what)

    def one(c: kernels.Csr, sizes: np.ndarray, s: int) -> dict:
        d = kernels.bfs(c, s)
        many, ret = sizes.copy(), kernels.back(c, d, s) if sizes[s] > 1 else -1
        low = int(np.flatnonzero(d >= 0)[0])
        d[s], many[s] = ret, sizes[s] - 1
        there = d > 0
        at = np.bincount(d[there], weights=many[there]).astype(np.int64)
        hops = np.flatnonzero(at)
        alone = ret < 0 and sizes[s] > 1
        return {"ecc": int(hops.max()) if len(hops) else 0, "total": int((hops * at[hops]).sum()), "reached": int(at.sum()), "harmonic": math.fsum((at[hops] / hops).tolist()), "low": low, "alone": alone}

    stats = found.by_class(one, "ecc long, total long, reached long, harmonic double, low long, alone boolean")
    # low is a class's number; of twins that don't reach each other every one is the lowest of its own
    return found.of_nodes(stats).withColumn("low", F.struct("low", F.when(F.col("alone"), F.col("node")).otherwise(-1).alias("own"))).drop("label", "alone")


def distance(g: Graph) -> Distance:
    g.need_undirected("distance")
    found = settled(_sweep(g, "distance"))
    r = found.agg(F.sum("total").alias("t"), F.sum("reached").alias("p"), F.max("ecc").alias("hi"), F.min("ecc").alias("lo")).first()
    parts = found.select("low").distinct().count()
    return Distance(found.select("node", F.col("ecc").alias("eccentricity")), r["t"] or 0, r["p"] or 0, parts, g.order(), r["hi"] or 0, r["lo"] or 0)


def closeness(g: Graph) -> DataFrame:
    """Wasserman and Faust: (r / total) * (r / (n - 1)) over the r nodes reached; 0 for an isolated node."""
    r = F.col("reached").cast("double")
    return _sweep(g, "closeness").select("node", F.when(F.col("total") > 0, r / F.col("total") * (r / (g.order() - 1))).otherwise(0.0).alias("score"))


def harmonic(g: Graph) -> DataFrame:
    return _sweep(g, "harmonic").select("node", F.col("harmonic").alias("score"))


def _halved(g: Graph, sums: DataFrame) -> DataFrame:
    half = 1.0 if g.is_directed() else 0.5
    return sums.select("node", F.coalesce(F.col("score") * half, F.lit(0.0)).alias("score"))


def betweenness(g: Graph) -> DataFrame:
    """Brandes, not normalised, halved for undirected graphs."""
    found = twins(g, "betweenness")
    return _halved(g, found.of_nodes(found.summed(kernels.brandes)))


def weighted_betweenness(g: Graph) -> DataFrame:
    """The same with weights as distances, which must be positive."""
    require(g.lightest is None or g.lightest > 0, "weighted betweenness needs positive weights")
    return _halved(g, g.nodes().join(g.summed_by_source(kernels.brandes_weighted, "betweenness"), "node", "left"))

"""Graphs as DataFrames.

A graph has nodes 0 .. order - 1 and canonical edges (src, dst, weight): parallel edges merged, their weights added, an
undirected edge stored once with its smaller end first. A self-loop adds 2 to an undirected degree and twice its weight to
the strength; a directed degree counts outgoing edges. Null weights are 1; rows with a null end are left out.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.errors import InvalidArgument, require
from quillon.iterate import python_path, settled
from quillon.operators.graph.kernels import Csr

#: Arcs up to which a graph's algorithm may run as one task, or the graph be broadcast (24 bytes an arc).
MAX_LOCAL = 2_000_000


class Graph:
    def __init__(self, edges: DataFrame, order: int, directed: bool, local: int = MAX_LOCAL):
        require(order >= 0, "a graph's order must not be negative")
        self.order_, self.directed, self.local = order, directed, local
        self.spark: SparkSession = edges.sparkSession
        python_path(self.spark)
        weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
        raw = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), weight.alias("weight")).dropna(subset=["src", "dst"])
        ends = (F.col("src"), F.col("dst")) if directed else (F.least("src", "dst"), F.greatest("src", "dst"))
        self.edges = settled(raw.groupBy(ends[0].alias("src"), ends[1].alias("dst")).agg(F.sum("weight").alias("weight")))
        r = self.edges.agg(F.min(F.least("src", "dst")).alias("low"), F.max(F.greatest("src", "dst")).alias("high"), F.max(F.isnan("weight") | (F.abs("weight") == float("inf"))).alias("odd"), F.count("*").alias("n"), F.min("weight").alias("lightest")).first()
        require(r["low"] is None or (r["low"] >= 0 and r["high"] < order), "an edge's end lies outside the graph")
        require(not r["odd"], "an edge's weight must be finite")
        self.size_, self.lightest = r["n"], r["lightest"]

    @classmethod
    def undirected(cls, edges: DataFrame, order: int | None = None, local: int = MAX_LOCAL) -> Graph:
        return cls(edges, _order(edges) if order is None else order, False, local)

    @classmethod
    def of_directed(cls, edges: DataFrame, order: int | None = None, local: int = MAX_LOCAL) -> Graph:
        return cls(edges, _order(edges) if order is None else order, True, local)

    # accessors

    def order(self) -> int:
        return self.order_

    def size(self) -> int:
        return self.size_

    def is_empty(self) -> bool:
        return self.order_ == 0

    def is_directed(self) -> bool:
        return self.directed

    def is_weighted(self) -> bool:
        return bool(self.edges.filter("weight <> 1").take(1))

    def has_node(self, node: int) -> bool:
        return 0 <= node < self.order_

    def _node(self, node: int) -> None:
        require(self.has_node(node), f"there is no node {node}")

    def nodes(self) -> DataFrame:
        return self.spark.range(self.order_).withColumnRenamed("id", "node")

    @functools.cached_property
    def arcs(self) -> DataFrame:
        """Each way that an edge can be gone, loops once."""
        if self.directed:
            return self.edges
        both = F.array(F.struct("src", "dst", "weight"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
        return self.edges.select(F.explode(F.when(F.col("src") == F.col("dst"), F.slice(both, 1, 1)).otherwise(both)).alias("a")).select("a.*")

    @property
    def fits(self) -> bool:
        """Whether one task may hold the whole graph."""
        return 2 * self.size_ <= self.local and self.order_ <= self.local

    def degrees(self) -> DataFrame:
        """node, degree and strength of every node."""
        twice = F.when((F.col("src") == F.col("dst")) & F.lit(not self.directed), 2).otherwise(1)
        own = self.arcs.groupBy(F.col("src").alias("node")).agg(F.sum(twice).alias("degree"), F.sum(twice * F.col("weight")).alias("strength"))
        return self.nodes().join(own, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("strength", F.lit(0.0)).alias("strength"))

    def strengths(self) -> DataFrame:
        return self.degrees().select("node", "strength")

    def degree(self, node: int) -> int:
        self._node(node)
        twice = F.when((F.col("src") == F.col("dst")) & F.lit(not self.directed), 2).otherwise(1)
        return self.arcs.filter(F.col("src") == node).agg(F.coalesce(F.sum(twice), F.lit(0))).first()[0]

    def strength(self, node: int) -> float:
        self._node(node)
        twice = F.when((F.col("src") == F.col("dst")) & F.lit(not self.directed), 2).otherwise(1)
        return self.arcs.filter(F.col("src") == node).agg(F.coalesce(F.sum(twice * F.col("weight")), F.lit(0.0))).first()[0]

    def self_loops(self) -> DataFrame:
        return self.edges.filter("src = dst").select(F.col("src").alias("node"), "weight")

    def self_loop_weight(self, node: int) -> float:
        self._node(node)
        found = self.edges.filter((F.col("src") == node) & (F.col("dst") == node)).first()
        return found["weight"] if found else 0.0

    def neighbours(self, node: int) -> DataFrame:
        self._node(node)
        return self.arcs.filter(F.col("src") == node).select(F.col("dst").alias("node"), "weight").orderBy("node")

    def has_edge(self, a: int, b: int) -> bool:
        return self._edge(a, b) is not None

    def _edge(self, a: int, b: int):
        self._node(a)
        self._node(b)
        if not self.directed:
            a, b = min(a, b), max(a, b)
        return self.edges.filter((F.col("src") == a) & (F.col("dst") == b)).first()

    def edge_weight(self, a: int, b: int) -> float:
        found = self._edge(a, b)
        return found["weight"] if found else 0.0

    def edge_list(self) -> DataFrame:
        return self.edges.orderBy("src", "dst")

    @functools.cached_property
    def total_weight_(self) -> float:
        return self.edges.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]

    def total_weight(self) -> float:
        return self.total_weight_

    def total_endpoint_weight(self) -> float:
        return self.total_weight_ * (1 if self.directed else 2)

    # running over it

    def need_undirected(self, what: str) -> None:
        if self.directed:
            raise InvalidArgument(f"{what} takes undirected graphs only")

    def need_fit(self, what: str) -> None:
        require(self.fits, f"{what} broadcasts the graph and takes at most {self.local} arcs; this one has {2 * self.size_}")

    def csr(self) -> Csr:
        """The arcs as arrays, where they fit."""
        self.need_fit("csr")
        t = self.arcs.toArrow()
        return Csr(self.order_, t["src"].to_numpy(), t["dst"].to_numpy(), t["weight"].to_numpy())

    def in_one_task(self, f: Callable[[Csr], dict[str, object]], schema: str) -> DataFrame:
        """f's columns, computed where the arcs are gathered: in one task, for graphs that fit. Errors of f come out as
        themselves."""
        self.need_fit("a kernel")
        order, names = self.order_, [c.split()[0] for c in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = [b for b in batches if b.num_rows]
            src, dst, weight = (np.concatenate([b[c].to_numpy() for b in found]) for c in ("src", "dst", "weight"))
            real = src >= 0
            out = f(Csr(order, src[real], dst[real], weight[real]))
            if len(out[names[0]]):
                yield pa.RecordBatch.from_arrays([pa.array(out[n]) for n in names], names=names)

        lone = self.spark.sql("SELECT -1L AS src, -1L AS dst, 0D AS weight")  # so that there is a task without arcs too
        return settled(self.arcs.unionByName(lone).coalesce(1).mapInArrow(run, schema))

    def summed_by_source(self, f: Callable[[Csr, int], tuple[np.ndarray, np.ndarray]], what: str) -> DataFrame:
        """node and score: the sums over all sources of f's values, added into one vector a task before they are shuffled."""
        self.need_fit(what)
        held, order = self.spark.sparkContext.broadcast(self.csr()), self.order_

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g, total = held.value, np.zeros(order)
            for b in batches:
                for s in b["node"].to_pylist():
                    nodes, values = f(g, s)
                    total[nodes] += values
            some = np.flatnonzero(total)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], names=["node", "score"])

        dealt = self.nodes().repartition(max(1, min(self.order_, 4 * self.spark.sparkContext.defaultParallelism)))
        return dealt.mapInArrow(run, "node long, score double").groupBy("node").agg(F.sum("score").alias("score"))


def _order(edges: DataFrame) -> int:
    high = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
    return 0 if high is None else int(high) + 1

"""Classes of nodes that have the same neighbours: what all-source algorithms run on instead of the nodes.

Twins (no arc between them, the same arcs out and in, loops apart) are at the same distances from all others, and classes of
twins are linked wholly or not at all. A search from one member over the graph of classes therefore gives every member's
numbers, exactly; a graph without twins is its own graph of classes. Members of a class are as far from each other as the
shortest way from it back to it, and never lie inside each other's shortest ways.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.errors import require
from quillon.iterate import settled
from quillon.operators.graph.frame import Graph
from quillon.operators.graph.kernels import Csr


def _dealt(g: Graph, n: int) -> DataFrame:
    return g.spark.range(n).withColumnRenamed("id", "at").repartition(max(1, min(n, 4 * g.spark.sparkContext.defaultParallelism)))


@dataclass(frozen=True)
class Twins:
    """label: node, label (its class's smallest node). Classes are numbered by that node: first and sizes by number, csr
    their arcs without loops."""

    graph: Graph
    label: DataFrame
    first: np.ndarray
    sizes: np.ndarray
    csr: Csr

    def by_class(self, f: Callable[[Csr, np.ndarray, int], dict[str, object]], schema: str) -> DataFrame:
        """label and f's columns, one row a class, the classes broadcast."""
        held, names = self.graph.spark.sparkContext.broadcast((self.csr, self.first, self.sizes)), [c.split()[0] for c in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            csr, first, sizes = held.value
            for b in batches:
                at = b["at"].to_numpy()
                rows = [f(csr, sizes, int(s)) for s in at]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(first[at]), *(pa.array([r[n] for r in rows]) for n in names)], names=["label", *names])

        return settled(_dealt(self.graph, len(self.first)).mapInArrow(run, f"label long, {schema}"))

    def summed(self, f: Callable[[Csr, np.ndarray, int], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        """label and score: the sums over all nodes as sources of f's values, added into one vector a task before they are
        shuffled."""
        held = self.graph.spark.sparkContext.broadcast((self.csr, self.first, self.sizes))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            csr, first, sizes = held.value
            total = np.zeros(len(first))
            for b in batches:
                for s in b["at"].to_pylist():
                    found, values = f(csr, sizes, s)
                    total[found] += sizes[s] * values
            some = np.flatnonzero(total)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(first[some]), pa.array(total[some])], names=["label", "score"])

        return settled(_dealt(self.graph, len(self.first)).mapInArrow(run, "label long, score double").groupBy("label").agg(F.sum("score").alias("score")))

    def of_nodes(self, found: DataFrame) -> DataFrame:
        """node, label and found's columns, null where found has no row of its class."""
        return self.label.join(found, "label", "left")


def _marks(arcs: DataFrame, own: str, other: str) -> DataFrame:
    hashes = [F.bit_xor(F.xxhash64(F.col(other), F.lit(k))).alias(f"_{other}{k}") for k in (0, 1)]
    return arcs.groupBy(F.col(own).alias("node")).agg(F.count("*").alias(f"_{other}_n"), *hashes)


def twins(g: Graph, what: str) -> Twins:
    """Refuses graphs whose classes have more arcs than one task may hold."""
    arcs = g.arcs.filter("src <> dst").select("src", "dst")
    sides = [("src", "dst"), ("dst", "src")] if g.directed else [("src", "dst")]
    marked, by = g.nodes(), []
    for own, other in sides:
        marks = _marks(arcs, own, other)
        marked, by = marked.join(marks, "node", "left"), by + marks.columns[1:]
    marked = settled(marked.select("node", *(F.coalesce(c, F.lit(0)).alias(c) for c in by)))
    classes = marked.groupBy(*by).agg(F.min("node").alias("label"), F.count("*").alias("size"))
    label = settled(marked.join(classes, by).select("node", "label", "size"))

    def links(own: str, other: str) -> DataFrame:
        """How many of a class's members have an arc with each node."""
        return settled(arcs.join(label.withColumnRenamed("node", own), own).groupBy("label", other).agg(F.count("*").alias("n"), F.first("size").alias("size")))

    # hashes only propose: a class stays if all of its members have each of the neighbours that one has
    found = [links(*side) for side in sides]
    torn = [f.filter("n <> size").select("label") for f in found]
    torn = torn[0] if len(torn) == 1 else torn[0].union(torn[1])
    if torn.take(1):
        torn = torn.distinct().withColumn("torn", F.lit(True))
        label = settled(label.join(torn, "label", "left").select("node", F.when(F.col("torn"), F.col("node")).otherwise(F.col("label")).alias("label"), F.when(F.col("torn"), F.lit(1)).otherwise(F.col("size")).alias("size")))
        found = [links(*sides[0])]
    ends = settled(found[0].select(F.col("label").alias("src"), F.col("dst").alias("node")).join(label.select("node", F.col("label").alias("dst")), "node").select("src", "dst").distinct())
    firsts = label.filter("node = label").select("label", "size")
    n, m = firsts.count(), ends.count()
    require(n <= g.local and m <= g.local, f"{what} broadcasts the graph and takes at most {g.local} arcs between classes of nodes with the same neighbours; this one has {n} classes and {m} arcs")
    held, arrow = firsts.orderBy("label").toArrow(), ends.toArrow()
    first = held["label"].to_numpy()
    src, dst = (np.searchsorted(first, arrow[c].to_numpy()) for c in ("src", "dst"))
    return Twins(g, label.select("node", "label"), first, held["size"].to_numpy(), Csr(n, src, dst, np.ones(m)))

"""Community detection: Leiden and label propagation.

Communities never span connected components, and an objective needs from the rest of the graph only constants (the total
weight, the density). Each component is therefore searched in a task of its own, with a seed made from the given one and the
component's smallest node; results depend neither on partitioning nor on the other components. A component must fit a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.errors import require
from quillon.iterate import settled
from quillon.operators.community import search
from quillon.operators.community.partition import canonical
from quillon.operators.community.quality import ConstantPotts, ErdosRenyiPotts, Modularity
from quillon.operators.graph.connectivity import component_labels
from quillon.operators.graph.frame import Graph


def _by_component(g: Graph, f: Callable, schema: str, initial: DataFrame | None = None) -> DataFrame:
    """f(nodes, src, dst, weight, initial) over components with an edge, one after another from sorted partitions, so that a
    task holds one component; src and dst are places in nodes. f gives rows."""
    label = settled(component_labels(g))
    edges = g.edges.join(label.select(F.col("node").alias("src"), F.col("label").alias("c")), "src").select("c", "src", "dst", "weight")
    if initial is not None:  # starting communities come along as rows without an end
        own = initial.join(label, "node").select(F.col("label").alias("c"), F.col("node").alias("src"), F.lit(-1).cast("long").alias("dst"), F.col("community").cast("double").alias("weight"))
        edges = edges.unionByName(own)
    names, kinds = [c.split()[0] for c in schema.split(", ")], g.spark.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        at, out = None, []

        def search_one() -> list[tuple]:
            src, dst, weight = (np.concatenate(x) for x in zip(*held, strict=True))
            given = dst < 0
            start = dict(zip(src[given].tolist(), weight[given].tolist(), strict=True))
            src, dst, weight = src[~given], dst[~given], weight[~given]
            if not len(src):
                return []
            nodes = np.unique(np.concatenate((src, dst)))
            return f(nodes, np.searchsorted(nodes, src), np.searchsorted(nodes, dst), weight, [int(start[u]) for u in nodes.tolist()] if start else None)

        for b in batches:
            c, src, dst, weight = (x.to_numpy() for x in b.columns)
            cuts = [0, *(np.flatnonzero(c[1:] != c[:-1]) + 1).tolist(), len(c)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi == lo:
                    continue
                if held and c[lo] != at:
                    out += search_one()
                    held.clear()
                at = c[lo]
                held.append((src[lo:hi], dst[lo:hi], weight[lo:hi]))
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=kinds)
                    out = []
        if held:
            out += search_one()
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=kinds)

    parts = int(g.spark.conf.get("spark.sql.shuffle.partitions"))
    return settled(edges.repartition(parts, "c").sortWithinPartitions("c", "src", "dst").mapInArrow(run, schema))


def _seed(seed: int, first: int) -> int:
    return zlib.crc32(f"{seed}:{first}".encode())


def _labelled(nodes: np.ndarray, member: list[int], more: int) -> list[tuple]:
    """(node, smallest node of its community) and empty columns."""
    low: dict[int, int] = {}
    for u, c in zip(nodes.tolist(), member, strict=True):
        low.setdefault(c, u)
    return [(u, low[c], *[None] * more) for u, c in zip(nodes.tolist(), member, strict=True)]


@dataclass(frozen=True)
class Leiden:
    objective: object = field(default_factory=Modularity)
    seed: int = 0
    randomness: float = 0.01
    max_iterations: int = 32
    iterations: int = 2
    #: Independent starts, of which the best counts.
    starts: int = 3

    def __post_init__(self):
        require(self.randomness > 0, "randomness must be positive")
        require(self.max_iterations >= 1 and self.iterations >= 1 and self.starts >= 1, "there must be an iteration")

    @classmethod
    def modularity(cls, resolution: float = 1.0, seed: int = 0) -> Leiden:
        return cls(Modularity(resolution), seed)

    @classmethod
    def constant_potts(cls, resolution: float = 1.0, seed: int = 0) -> Leiden:
        return cls(ConstantPotts(resolution), seed)

    @classmethod
    def erdos_renyi_potts(cls, resolution: float = 1.0, seed: int = 0) -> Leiden:
        return cls(ErdosRenyiPotts(resolution), seed)

    @classmethod
    def reichardt_bornholdt(cls, resolution: float = 1.0, seed: int = 0) -> Leiden:
        return cls(Modularity(resolution), seed)

    def _search(self, g: Graph, initial: DataFrame | None, passes: int, starts: int = 1) -> DataFrame:
        g.need_undirected("Leiden community detection")
        require(g.lightest is None or g.lightest >= 0, "community detection needs weights that aren't negative")
        objective, two_m, opts = self.objective.bound_to(g), g.total_endpoint_weight(), self
        if initial is not None:
            require(initial.count() == g.order(), "the starting partition covers another number of nodes than the graph has")

        def f(nodes, src, dst, weight, start) -> list[tuple]:
            first = int(nodes[0])
            member, trace = search.leiden(len(nodes), src, dst, weight, objective, two_m, _seed(opts.seed, first), opts.randomness, opts.max_iterations, passes, start, starts)
            return _labelled(nodes, member, 4) + [(first, None, *t) for t in trace]

        return _by_component(g, f, "node long, label long, level long, nodes long, communities long, refined long", initial)

    def partition(self, g: Graph) -> DataFrame:
        """node, community."""
        return self._partition(g, self._search(g, None, self.iterations, self.starts))

    def partition_with_trace(self, g: Graph, initial: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """One pass, from `initial` (node, community) if given; and, per component and level, how many nodes there were,
        communities after moving and parts after refinement."""
        found = self._search(g, initial, 1)
        trace = found.filter("level is not null").select(F.col("node").alias("component"), "level", "nodes", "communities", "refined").orderBy("component", "level")
        return self._partition(g, found), trace

    def _partition(self, g: Graph, found: DataFrame) -> DataFrame:
        own = g.nodes().join(found.filter("label is not null").select("node", "label"), "node", "left")
        return canonical(own.select("node", F.coalesce("label", "node").alias("label")), "label")


@dataclass(frozen=True)
class LabelPropagation:
    seed: int = 0
    max_iterations: int = 100

    def __post_init__(self):
        require(self.max_iterations >= 1, "there must be an iteration")

    def partition(self, g: Graph) -> DataFrame:
        g.need_undirected("label propagation")
        opts = self

        def f(nodes, src, dst, weight, start) -> list[tuple]:
            return _labelled(nodes, search.propagate(len(nodes), src, dst, weight, _seed(opts.seed, int(nodes[0])), opts.max_iterations), 0)

        found = _by_component(g, f, "node long, label long")
        return canonical(g.nodes().join(found, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "label")

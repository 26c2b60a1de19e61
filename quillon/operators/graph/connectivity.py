"""Components, strong components, bridges and articulation points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.errors import require
from quillon.iterate import Steps
from quillon.operators.community.partition import canonical
from quillon.operators.graph import kernels
from quillon.operators.graph.frame import Graph


def labels_of(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """node, label: the smallest node of the component, arcs (src, dst) going both ways. Each step takes the smallest label
    of the neighbours and then that label's own label, so a step halves the way at least."""
    spark = nodes.sparkSession
    steps = Steps(spark)
    label = nodes.select("node", F.col("node").alias("label"))
    while True:
        near = arcs.join(label.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("near"))
        lower = label.join(near, "node", "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        up = label.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = steps.keep(lower.join(up, "label").select("node", "was", F.least("label", "up").alias("label")))
        if not new.filter("label <> was").take(1):
            return new.select("node", "label")
        label = new.select("node", "label")


def _both_ways(g: Graph) -> DataFrame:
    arcs = g.edges.select("src", "dst")
    return arcs.unionByName(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def component_labels(g: Graph) -> DataFrame:
    """node, label (the smallest node); arrows are ignored."""
    if g.fits:
        return g.in_one_task(lambda c: {"node": np.arange(c.order), "label": kernels.components(c)}, "node long, label long")
    return labels_of(g.nodes(), _both_ways(g))


def components(g: Graph) -> DataFrame:
    """node, community: canonical numbers of the (weak) components."""
    return canonical(component_labels(g), "label")


def is_connected(g: Graph) -> bool:
    return g.is_empty() or component_labels(g).agg(F.max("label")).first()[0] == 0


def induces_connected_subgraph(g: Graph, nodes: DataFrame) -> bool:
    """Whether the nodes (column node) are connected by edges among themselves; one node or none is."""
    own = nodes.select(F.col("node").cast("long").alias("node")).distinct()
    bad = own.filter((F.col("node") < 0) | (F.col("node") >= g.order())).limit(1)
    require(not bad.take(1), "a node lies outside the graph")
    inside = _both_ways(g).join(own.withColumnRenamed("node", "src"), "src", "left_semi").join(own.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return labels_of(own, inside).select("label").distinct().count() <= 1


def _peeled(nodes: DataFrame, arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes left, arcs left) without nodes that lack incoming or outgoing arcs, again and again."""
    steps = Steps(nodes.sparkSession, depth=4)
    while True:
        both = arcs.select(F.col("src").alias("node")).intersect(arcs.select(F.col("dst").alias("node")))
        left = steps.keep(nodes.join(both, "node", "left_semi"))
        before, after = nodes.count(), left.count()
        ends = left.select("node")
        arcs = steps.keep(arcs.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi"))
        nodes = left
        if before == after:
            return nodes, arcs


def strong_labels(g: Graph) -> DataFrame:
    """node, label: the smallest node of the strong component. Without a fit: peel nodes without cycles, colour forwards with
    the smallest node that reaches, and take back from each colour what reaches its root; the rest goes round again."""
    if not g.is_directed():
        return component_labels(g)
    if g.fits:
        return g.in_one_task(lambda c: {"node": np.arange(c.order), "label": kernels.strong_components(c)}, "node long, label long")
    nodes, arcs = g.nodes(), g.edges.filter("src <> dst").select("src", "dst")
    done = None
    while True:
        nodes, arcs = _peeled(nodes, arcs)
        if not nodes.take(1):
            break
        colour, steps = nodes.select("node", F.col("node").alias("c")), Steps(g.spark)
        while True:
            near = arcs.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("n"))
            new = steps.keep(colour.join(near, "node", "left").select("node", F.col("c").alias("was"), F.least("c", F.coalesce("n", "c")).alias("c")))
            colour = new.select("node", "c")
            if not new.filter("c <> was").take(1):
                break
        ends = colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), colour.select(F.col("node").alias("dst"), F.col("c").alias("cd"))
        inside = Steps(g.spark).keep(arcs.join(ends[0], "src").join(ends[1], "dst").filter("cs = cd").select("src", "dst", F.col("cs").alias("c")))
        steps = Steps(g.spark, depth=3)
        found = front = steps.keep(colour.filter("node = c"))
        while True:
            back = inside.join(front.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "c").distinct()
            front = steps.keep(back.join(found, "node", "left_anti"))
            if not front.take(1):
                break
            found = steps.keep(found.unionByName(front))
        own = Steps(g.spark).keep(found.select("node", F.col("c").alias("label")))
        done = own if done is None else done.unionByName(own)
        steps = Steps(g.spark, depth=2)
        nodes = steps.keep(nodes.join(own, "node", "left_anti"))
        arcs = steps.keep(arcs.join(own.select(F.col("node").alias("src")), "src", "left_anti").join(own.select(F.col("node").alias("dst")), "dst", "left_anti"))
    if done is None:
        return g.nodes().select("node", F.col("node").alias("label"))
    return g.nodes().join(done, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def strongly_connected_components(g: Graph) -> DataFrame:
    return canonical(strong_labels(g), "label")


def is_strongly_connected(g: Graph) -> bool:
    return g.is_empty() or strong_labels(g).select("label").distinct().count() == 1


def is_acyclic(g: Graph) -> bool:
    """No strong component of two nodes and no loop with a weight other than 0."""
    if g.self_loops().filter("weight <> 0").take(1):
        return False
    return not strong_labels(g).groupBy("label").count().filter("count > 1").take(1)


def bridges(g: Graph) -> DataFrame:
    """src, dst (smaller first) of the edges whose loss disconnects. One task: low links are depth-first."""
    g.need_undirected("bridges")

    def kernel(c: kernels.Csr) -> dict:
        found, _ = kernels.fragile(c)
        return {"src": [a for a, _ in found], "dst": [b for _, b in found]}

    return g.in_one_task(kernel, "src long, dst long").orderBy("src", "dst")


def articulation_points(g: Graph) -> DataFrame:
    g.need_undirected("articulationPoints")
    return g.in_one_task(lambda c: {"node": kernels.fragile(c)[1]}, "node long").orderBy("node")

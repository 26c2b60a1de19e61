"""Triangles and clustering, cores, degree assortativity, link prediction, spanning forests. Undirected graphs only."""

from __future__ import annotations

import enum

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.errors import InvalidArgument, require
from quillon.iterate import Steps, settled
from quillon.operators.graph import kernels
from quillon.operators.graph.frame import Graph
from quillon.operators.stats.correlation import pearson

# clustering


def triangles(g: Graph) -> DataFrame:
    """node, triangles. Edges point from the end of smaller (degree, id), so that a hub has few outgoing ones; wedges are
    joined at their source and closed by a third edge. Loops and weights don't count."""
    g.need_undirected("triangles")
    plain = g.edges.filter("src <> dst").select("src", "dst")
    both = plain.unionByName(plain.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    degree = both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d"))
    a, b = (degree.select(F.col("node").alias(c), F.struct("d", "node").alias(f"k_{c}")) for c in ("src", "dst"))
    oriented = settled(plain.join(a, "src").join(b, "dst").select(F.least("k_src", "k_dst").alias("lo"), F.greatest("k_src", "k_dst").alias("hi")).select(F.col("lo.node").alias("u"), F.col("hi.node").alias("v"), F.col("hi").alias("key")))
    left = oriented.select("u", "v", "key")
    right = oriented.select("u", F.col("v").alias("w"), F.col("key").alias("key_w"))
    wedges = left.join(right, "u").filter("key < key_w").select("u", "v", "w")
    closed = wedges.join(oriented.select(F.col("u").alias("v"), F.col("v").alias("w")), ["v", "w"])
    counts = closed.select(F.explode(F.array("u", "v", "w")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    return g.nodes().join(counts, "node", "left").select("node", F.coalesce("triangles", F.lit(0)).alias("triangles"))


def triangle_count(g: Graph) -> int:
    return (triangles(g).agg(F.sum("triangles")).first()[0] or 0) // 3


def _simple_degrees(g: Graph) -> DataFrame:
    own = g.arcs.filter("src <> dst").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d"))
    return g.nodes().join(own, "node", "left").select("node", F.coalesce("d", F.lit(0)).alias("d"))


def clustering(g: Graph) -> DataFrame:
    """node, coefficient: 2T / (d (d - 1)), 0 below two neighbours."""
    both = triangles(g).join(_simple_degrees(g), "node")
    return both.select("node", F.when(F.col("d") > 1, 2.0 * F.col("triangles") / F.nullif(F.col("d") * (F.col("d") - 1), F.lit(0))).otherwise(0.0).alias("coefficient"))


def average_clustering(g: Graph) -> float:
    return clustering(g).agg(F.avg("coefficient")).first()[0] or 0.0


def transitivity(g: Graph) -> float:
    n = triangles(g).agg(F.sum("triangles")).first()[0] or 0
    wedges = _simple_degrees(g).agg(F.sum(F.expr("d * (d - 1) div 2"))).first()[0] or 0
    return n / wedges if wedges else 0.0


# cores


def core_numbers(g: Graph) -> DataFrame:
    """node, core. Without a fit: the h-index of the neighbours' numbers, from degrees down, until nothing changes."""
    g.need_undirected("core numbers")
    if g.fits:
        return g.in_one_task(lambda c: {"node": np.arange(c.order), "core": kernels.core_numbers(c)}, "node long, core long")
    arcs = settled(g.arcs.filter("src <> dst").select("src", "dst"))
    core, steps = _simple_degrees(g).withColumnRenamed("d", "core"), Steps(g.spark)
    while True:
        held = arcs.join(core.select(F.col("node").alias("src"), F.col("core").alias("c")), "src").groupBy("dst", "c").agg(F.count("*").alias("n"))
        # counts per value stay small; h = the largest c with at least c neighbours of c or more
        found = held.groupBy(F.col("dst").alias("node")).agg(F.sort_array(F.collect_list(F.struct("c", "n")), False).alias("cs"))
        h = F.aggregate("cs", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("h")), lambda s, x: F.struct((s["seen"] + x["n"]).alias("seen"), F.greatest(s["h"], F.least(x["c"], s["seen"] + x["n"])).alias("h")))
        new = steps.keep(core.join(found.select("node", h["h"].alias("h")), "node", "left").select("node", F.col("core").alias("was"), F.least("core", F.coalesce("h", F.lit(0))).alias("core")))
        core = new.select("node", "core")
        if not new.filter("core <> was").take(1):
            return core


def degeneracy(g: Graph) -> int:
    return core_numbers(g).agg(F.max("core")).first()[0] or 0


def nodes_in_core(g: Graph, k: int) -> DataFrame:
    require(k >= 0, "a core's number must not be negative")
    return core_numbers(g).filter(F.col("core") >= k).select("node").orderBy("node")


# assortativity


def degree_assortativity(g: Graph) -> float:
    """Pearson over both orientations of each edge that isn't a loop, of degrees that do count loops."""
    g.need_undirected("assortativity")
    degree = settled(g.degrees().select("node", "degree"))
    ends = g.arcs.filter("src <> dst").join(degree.select(F.col("node").alias("src"), F.col("degree").alias("a")), "src").join(degree.select(F.col("node").alias("dst"), F.col("degree").alias("b")), "dst")
    return pearson(settled(ends.select("a", "b")), "a", "b")


# link prediction


class LinkMeasure(enum.Enum):
    COMMON_NEIGHBOURS = "common_neighbours"
    JACCARD = "jaccard"
    ADAMIC_ADAR = "adamic_adar"
    RESOURCE_ALLOCATION = "resource_allocation"
    PREFERENTIAL_ATTACHMENT = "preferential_attachment"


def link_scores(g: Graph, pairs: DataFrame) -> DataFrame:
    """a, b and the five measures of each pair, linked or not. Shared neighbours come from an equi-join."""
    g.need_undirected("link prediction")
    degree = g.degrees().select("node", "degree")
    stored = g.arcs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("stored"))
    info = settled(degree.join(stored, "node", "left").select("node", "degree", F.coalesce("stored", F.lit(0)).alias("stored")))
    pairs = pairs.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct()
    left = pairs.join(g.arcs.select(F.col("src").alias("a"), F.col("dst").alias("z")), "a")
    shared = left.join(g.arcs.select(F.col("src").alias("b"), F.col("dst").alias("z")), ["b", "z"]).join(info.select(F.col("node").alias("z"), F.col("degree").alias("dz")), "z")
    log = F.log(F.col("dz").cast("double"))
    sums = shared.groupBy("a", "b").agg(F.count("*").alias("cn"), F.sum(F.when(log > 0, 1 / F.nullif(log, F.lit(0.0)))).alias("aa"), F.sum(1.0 / F.nullif(F.col("dz"), F.lit(0))).alias("ra"))
    ends = pairs.join(info.select(F.col("node").alias("a"), F.col("degree").alias("da"), F.col("stored").alias("sa")), "a").join(info.select(F.col("node").alias("b"), F.col("degree").alias("db"), F.col("stored").alias("sb")), "b")
    cn = F.coalesce("cn", F.lit(0))
    union = F.col("sa") + F.col("sb") - cn
    return ends.join(sums, ["a", "b"], "left").select(
        "a", "b", cn.alias("common_neighbours"), F.when(union > 0, cn / F.nullif(union, F.lit(0))).otherwise(0.0).alias("jaccard"), F.coalesce("aa", F.lit(0.0)).alias("adamic_adar"), F.coalesce("ra", F.lit(0.0)).alias("resource_allocation"), (F.col("da") * F.col("db")).alias("preferential_attachment"),
    )


def link_score(g: Graph, a: int, b: int, measure: LinkMeasure) -> float:
    require(g.has_node(a) and g.has_node(b), "there is no such node")
    return float(link_scores(g, g.spark.sql(f"SELECT {a}L AS a, {b}L AS b")).first()[measure.value])


def rank_links(g: Graph, node: int, measure: LinkMeasure, limit: int | None = None) -> DataFrame:
    """node, score: nodes that aren't neighbours, best first, ties by node, scores above 0. Two hops away, but for
    preferential attachment, which scores all."""
    require(g.has_node(node), f"there is no node {node}")
    require(limit is None or limit >= 1, "limit must be at least 1")
    g.need_undirected("link prediction")
    near = g.arcs.filter(F.col("src") == node).select(F.col("dst").alias("b"))
    if measure is LinkMeasure.PREFERENTIAL_ATTACHMENT:
        pool = g.nodes().select(F.col("node").alias("b"))
    else:
        pool = g.arcs.join(near.select(F.col("b").alias("src")), "src").select(F.col("dst").alias("b")).distinct()
    pool = pool.filter(F.col("b") != node).join(near, "b", "left_anti")
    scored = link_scores(g, pool.select(F.lit(node).alias("a"), "b")).select(F.col("b").alias("node"), F.col(measure.value).cast("double").alias("score"))
    out = scored.filter("score > 0").orderBy(F.desc("score"), "node")
    return out if limit is None else out.limit(limit)


# spanning forests


def _forest(g: Graph, sign: int) -> DataFrame:
    """src, dst, weight of the forest that the order (sign * weight, src, dst) makes unique. Without a fit: Boruvka rounds,
    each component taking its first edge in that order."""
    g.need_undirected("spanning forests")
    if g.fits:

        def kernel(c: kernels.Csr) -> dict:
            s, d, w = kernels.forest(c, sign)
            return {"src": s, "dst": d, "weight": w}

        return g.in_one_task(kernel, "src long, dst long, weight double")
    from quillon.operators.graph.connectivity import labels_of

    edges, steps = g.edges.filter("src <> dst"), Steps(g.spark, depth=4)
    label, picked = g.nodes().select("node", F.col("node").alias("label")), None
    while True:
        across = edges.join(label.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(label.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst").filter("a <> b")
        edge = F.struct((F.lit(sign) * F.col("weight")).alias("k"), "src", "dst", "weight", "a", "b")
        first = across.select(F.explode(F.array("a", "b")).alias("c"), edge.alias("e")).groupBy("c").agg(F.min("e").alias("e")).select("e.src", "e.dst", "e.weight", "e.a", "e.b").distinct()
        new = Steps(g.spark).keep(first)
        if not new.take(1):
            return picked if picked is not None else edges.limit(0)
        own = new.select("src", "dst", "weight")
        picked = own if picked is None else picked.unionByName(own)
        arcs = new.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(new.select(F.col("b").alias("src"), F.col("a").alias("dst")))
        up = labels_of(label.select(F.col("label").alias("node")).distinct(), arcs)
        label = steps.keep(label.join(up.select(F.col("node").alias("label"), F.col("label").alias("new")), "label").select("node", F.col("new").alias("label")))


def minimum_spanning_forest(g: Graph) -> DataFrame:
    return _forest(g, 1)


def maximum_spanning_forest(g: Graph) -> DataFrame:
    return _forest(g, -1)


def forest_graph(g: Graph, dearest: bool = False) -> Graph:
    return Graph.undirected(_forest(g, -1 if dearest else 1), g.order(), g.local)


def forest_weight(g: Graph, dearest: bool = False) -> float:
    return _forest(g, -1 if dearest else 1).agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]


def measure_named(name: str) -> LinkMeasure:
    try:
        return LinkMeasure(name)
    except ValueError:
        raise InvalidArgument(f"no link measure {name!r}") from None

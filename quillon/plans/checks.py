"""Queries of the operators that plans.queries doesn't reach (accessors, flags, fitted models, superstep forms, invariants),
each next to the SQL that gives its rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import columns as fc
from quillon.functions.sums import compensated_sum, exact_product
from quillon.iterate import settled
from quillon.operators.community import detect, partition, quality
from quillon.operators.graph import centrality, connectivity, paths, structure
from quillon.operators.graph.frame import Graph
from quillon.operators.stats import regression, tests
from quillon.operators.stats.descriptive import Descriptive, Precision
from quillon.plans.oracle import _ARCS, _CO, _ONE_STEP, _POOL, _TRADE, _VISITS, ORACLE, _powers
from quillon.plans.queries import _by_part, _given, _r, _row, _t, _visit_names, _visits, co, query, trade
from quillon.sources.interop import LabelledGraph

# graphs


@query
def graph_edges(spark, d):
    """The edges of the co-order graph, as the graph holds them, by part."""
    g, names = co(spark, d)
    ends = [names.select(F.col("node").alias(c), F.col("part").alias(f"{c}_part")) for c in ("src", "dst")]
    return g.edge_list().join(ends[0], "src").join(ends[1], "dst").select(F.least("src_part", "dst_part").alias("src"), F.greatest("src_part", "dst_part").alias("dst"), "weight")


@query
def graph_flags(spark, d):
    """G3, G4."""
    g, t = co(spark, d)[0], trade(spark, d)
    empty = Graph.undirected(t.edges.limit(0))
    return _row(spark, co_directed=int(g.is_directed()), trade_directed=int(t.is_directed()), co_weighted=int(g.is_weighted()), co_empty=int(g.is_empty()), none_empty=int(empty.is_empty()), none_weighted=int(empty.is_weighted()), first=int(t.has_node(0)), last=int(t.has_node(24)), beyond=int(t.has_node(25)))


ORACLE["graph_flags"] = f"WITH {_CO} SELECT CAST(0 AS BIGINT) AS co_directed, CAST(1 AS BIGINT) AS trade_directed, CAST(count(*) FILTER (weight <> 1) > 0 AS BIGINT) AS co_weighted, CAST(count(*) = 0 AS BIGINT) AS co_empty, CAST(1 AS BIGINT) AS none_empty, CAST(0 AS BIGINT) AS none_weighted, CAST(1 AS BIGINT) AS first, CAST(1 AS BIGINT) AS last, CAST(0 AS BIGINT) AS beyond FROM co"


@query
def graph_nodes(spark, d):
    """G5."""
    g, names = co(spark, d)
    return g.nodes().join(names, "node").select("part")


ORACLE["graph_nodes"] = f"WITH {_ARCS} SELECT part FROM nodes"


@query
def edge_lookup(spark, d):
    """Single edges of trade, and of its undirected form."""
    t = trade(spark, d)
    u = Graph.undirected(t.edges, 25)
    return _row(spark, there=t.edge_weight(0, 1), back=t.edge_weight(1, 0), both=u.edge_weight(1, 0), loop=u.self_loop_weight(3), has=int(t.has_edge(0, 1)), degree=t.degree(0), strength=u.strength(3))


ORACLE["edge_lookup"] = f"""WITH {_TRADE}, w AS (SELECT src, dst, weight FROM trade) SELECT coalesce((SELECT weight FROM w WHERE src = 0 AND dst = 1), 0.0) AS there, coalesce((SELECT weight FROM w WHERE src = 1 AND dst = 0), 0.0) AS back,
  coalesce((SELECT sum(weight) FROM w WHERE src + dst = 1), 0.0) AS both, coalesce((SELECT weight FROM w WHERE src = 3 AND dst = 3), 0.0) AS loop, CAST((SELECT count(*) FROM w WHERE src = 0 AND dst = 1) AS BIGINT) AS has,
  (SELECT count(*) FROM w WHERE src = 0) AS degree, (SELECT sum(weight) FROM w WHERE src = 3) + (SELECT sum(weight) FROM w WHERE dst = 3) AS strength"""


@query
def csr_rows(spark, d):
    """Nodes with their places in the compressed rows of trade."""
    c = trade(spark, d).csr()
    return spark.createDataFrame([(i, int(c.offsets[i]), int(c.offsets[i + 1]), float(c.weight[c.offsets[i] : c.offsets[i + 1]].sum())) for i in range(c.order)], "node long, low long, high long, weight double")


ORACLE["csr_rows"] = f"WITH {_TRADE}, n AS (SELECT node, count(weight) AS k, coalesce(sum(weight), 0.0) AS weight FROM nation_nodes LEFT JOIN trade ON src = node GROUP BY 1) SELECT node, CAST(sum(k) OVER (ORDER BY node) - k AS BIGINT) AS low, CAST(sum(k) OVER (ORDER BY node) AS BIGINT) AS high, weight FROM n"


def _nations(spark, d):
    """Trade by the nations' names, from their adjacency."""
    t = trade(spark, d).edges
    names = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("key"), "n_name")
    rows = t.join(names.select(F.col("key").alias("dst"), F.col("n_name").alias("to")), "dst").groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct("to", "weight"))).alias("neighbours"))
    return LabelledGraph.from_adjacency(names.join(rows, names["key"] == rows["src"]).select(F.col("n_name").alias("name"), "neighbours", F.col("key").alias("at")), directed=True, ordinal="at")


@query
def adjacency_graph(spark, d):
    """Edges by name."""
    g = _nations(spark, d)
    out = g.named(g.graph.edges.withColumnRenamed("src", "node")).withColumnRenamed("name", "origin").withColumnRenamed("dst", "node")
    return g.named(out).select("origin", F.col("name").alias("target"), "weight")


ORACLE["adjacency_graph"] = f"WITH {_TRADE} SELECT a.n_name AS origin, b.n_name AS target, weight FROM trade JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst"


@query
def named_communities(spark, d):
    """Names by community, the community being the number modulo 3."""
    g = _nations(spark, d)
    p = partition.canonical(g.graph.nodes().withColumn("label", F.col("node") % 3), "label")
    return g.membership(p).select("name", F.col("community").cast("long").alias("community"))


ORACLE["named_communities"] = f"WITH {_TRADE} SELECT n_name AS name, CAST(n_nationkey % 3 AS BIGINT) AS community FROM nation WHERE n_nationkey IN (SELECT src FROM trade)"


@query
def mixed_graph(spark, d):
    """Trade above the diagonal directed, the rest in both directions."""
    t = trade(spark, d).edges
    name = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    g = LabelledGraph.from_mixed(t.select(name("src").alias("src"), name("dst").alias("dst"), "weight", (F.col("src") < F.col("dst")).alias("directed")))
    return g.graph.edges


ORACLE["mixed_graph"] = f"WITH {_TRADE}, e AS (SELECT src, dst, weight FROM trade UNION ALL SELECT dst, src, weight FROM trade WHERE src > dst), n AS (SELECT DISTINCT src AS k FROM e UNION SELECT dst FROM e), i AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS id FROM n) SELECT a.id AS src, b.id AS dst, sum(weight) AS weight FROM e JOIN i a ON a.k = src JOIN i b ON b.k = dst GROUP BY 1, 2"


# partitions


@query
def partition_basics(spark, d):
    """P1, P3 to P5."""
    p = settled(partition.canonical(_given(spark, d), "community"))
    g = co(spark, d)[0]
    again = p.select("node", (6 - F.col("community")).alias("community"))
    one, all_ = partition.single(spark, g.order()), partition.singletons(spark, g.order())
    return _row(spark, communities=partition.count(p), nodes=partition.order(p), own=int(partition.community_of(p, 0)), largest=partition.sizes(p).agg(F.max("size")).first()[0], first=partition.nodes_in(p, 0).count(), sets=partition.communities(p).count(),
                same=int(partition.equals(p, again)), other=int(partition.equals(p, one)), left_out=int(partition.has_unassigned(p)), one=partition.count(one), each=partition.count(all_))


ORACLE["partition_basics"] = f"WITH {_ARCS}, c AS (SELECT part % 7 AS c, count(*) AS n, min(part) AS low FROM nodes GROUP BY 1) SELECT count(*) AS communities, CAST(sum(n) AS BIGINT) AS nodes, CAST(0 AS BIGINT) AS own, max(n) AS largest, arg_min(n, low) AS first, count(*) AS sets, CAST(1 AS BIGINT) AS same, CAST(0 AS BIGINT) AS other, CAST(0 AS BIGINT) AS left_out, CAST(1 AS BIGINT) AS one, CAST(sum(n) AS BIGINT) AS each FROM c"


# paths and connectivity


@query
def shortest_path(spark, d):
    """The weight of the path found between nations 0 and 24, edge by edge, and its ends."""
    t = trade(spark, d)
    way = paths.shortest_path(t, 0, 24)
    return _row(spark, start=way[0], stop=way[-1], weight=float(sum(t.edge_weight(a, b) for a, b in zip(way, way[1:]))), repeated=len(way) - len(set(way)))


ORACLE["shortest_path"] = ORACLE["weighted_distance"].replace("SELECT n.node, coalesce(min(d), -1) AS distance FROM nation_nodes n LEFT JOIN way w ON w.node = n.node GROUP BY 1", "SELECT CAST(0 AS BIGINT) AS start, CAST(24 AS BIGINT) AS stop, min(d) AS weight, CAST(0 AS BIGINT) AS repeated FROM way WHERE node = 24")


@query
def path_length(spark, d):
    """Averages and flags."""
    x, t, v = paths.distance(_visits(spark, d)), trade(spark, d), _visits(spark, d)
    users = settled(_visit_names(spark, d).filter("name like 'u%'").select("node"))
    chain = Graph.of_directed(t.edges.filter("src < dst"), 25)
    return _row(spark, average=round(x.average_shortest_path_length(), 9), connected=int(x.is_connected()), users_connected=int(connectivity.induces_connected_subgraph(v, users)), all_connected=int(connectivity.induces_connected_subgraph(v, v.nodes())),
                strong=int(connectivity.is_strongly_connected(t)), acyclic=int(connectivity.is_acyclic(t)), chain_acyclic=int(connectivity.is_acyclic(chain)))


ORACLE["path_length"] = f"""WITH RECURSIVE {_VISITS}, {_TRADE}, reach AS (SELECT node AS a, node AS b FROM nation_nodes UNION SELECT a, dst FROM reach JOIN trade ON src = b)
  SELECT CASE WHEN (SELECT count(*) FROM dist) < pow((SELECT count(*) FROM who), 2) THEN CAST('inf' AS DOUBLE) ELSE round(sum(d) / count(*) FILTER (d > 0), 9) END AS average, CAST(count(*) = pow((SELECT count(*) FROM who), 2) AS BIGINT) AS connected,
  CAST(0 AS BIGINT) AS users_connected, CAST(count(*) = pow((SELECT count(*) FROM who), 2) AS BIGINT) AS all_connected, CAST((SELECT count(*) FROM reach) = 625 AS BIGINT) AS strong,
  CAST((SELECT count(*) FROM reach r JOIN trade ON r.b = src AND dst = r.a) = 0 AS BIGINT) AS acyclic, CAST(1 AS BIGINT) AS chain_acyclic FROM dist"""


_FOREST = f"""{_ARCS}, low AS (SELECT 0 AS i, part, part AS l FROM nodes UNION ALL SELECT i + 1, part, min(l) FROM (SELECT i, part, l FROM low UNION ALL SELECT i, dst, l FROM low JOIN arcs ON src = part) WHERE i < 60 GROUP BY 1, 2),
  label AS (SELECT part, l FROM low WHERE i = 60), deep AS (SELECT DISTINCT l AS part, 0 AS d FROM label UNION SELECT dst, d + 1 FROM deep JOIN arcs ON src = part WHERE d < 60),
  depth AS (SELECT part, min(d) AS d FROM deep GROUP BY 1), up AS (SELECT x.part, min(y.part) AS parent FROM depth x JOIN arcs ON src = x.part JOIN depth y ON y.part = dst AND y.d = x.d - 1 GROUP BY 1),
  climb AS (SELECT src AS x, dst AS y, CAST(NULL AS BIGINT) AS moved FROM co WHERE NOT EXISTS (SELECT 1 FROM up WHERE (up.part = src AND parent = dst) OR (up.part = dst AND parent = src))
    UNION SELECT CASE WHEN a.d >= b.d THEN u.parent ELSE x END, CASE WHEN a.d >= b.d THEN y ELSE v.parent END, CASE WHEN a.d >= b.d THEN x ELSE y END FROM climb JOIN depth a ON a.part = x JOIN depth b ON b.part = y LEFT JOIN up u ON u.part = x LEFT JOIN up v ON v.part = y WHERE x <> y)"""
ORACLE["bridges"] = f"WITH RECURSIVE {_FOREST} SELECT least(part, parent) AS part_a, greatest(part, parent) AS part_b FROM up WHERE part NOT IN (SELECT moved FROM climb WHERE moved IS NOT NULL)"
ORACLE["articulation_points"] = f"""WITH RECURSIVE {_FOREST}, size AS (SELECT l, count(*) AS n FROM label GROUP BY 1), cut AS (SELECT part, l FROM label JOIN deg USING (part) WHERE d > 1),
  walk AS (SELECT cut.part AS v, min(dst) AS spot FROM cut JOIN arcs ON src = part GROUP BY 1 UNION SELECT v, dst FROM walk JOIN arcs ON src = spot WHERE dst <> v)
  SELECT cut.part FROM cut JOIN size USING (l) JOIN (SELECT v, count(*) AS k FROM walk GROUP BY 1) w ON w.v = cut.part WHERE k < n - 1"""
_LEVELS = """, cuts AS (SELECT DISTINCT weight AS w FROM co), lev AS (SELECT 0 AS i, w, part, part AS l FROM nodes, cuts UNION ALL
  SELECT i + 1, w, part, min(l) FROM (SELECT i, w, part, l FROM lev UNION ALL SELECT i, w, dst, l FROM lev JOIN arcs ON src = part AND weight {op} w) WHERE i < 60 GROUP BY 1, 2, 3),
  n AS (SELECT w, (SELECT count(*) FROM nodes) - count(DISTINCT l) AS k FROM lev WHERE i = 60 GROUP BY 1)"""


def _forest(op: str, order: str) -> str:
    return f"WITH RECURSIVE {_ARCS}{_LEVELS.format(op=op)}, s AS (SELECT w, k - coalesce(lag(k) OVER (ORDER BY w {order}), 0) AS k FROM n) SELECT CAST(sum(k) AS BIGINT) AS e, CAST(sum(k * w) AS DOUBLE) AS t FROM s"


ORACLE["spanning_forest"] = f"SELECT a.e AS edges, a.t AS least, b.t AS most, b.e AS edges_most FROM ({_forest('<=', '')}) a, ({_forest('>=', 'DESC')}) b"


@query
def forest_graph(spark, d):
    """A forest as a graph, its weight and components."""
    f = structure.forest_graph(co(spark, d)[0])
    return _row(spark, n_nodes=f.order(), n_edges=f.size(), weight=f.total_weight(), own=structure.forest_weight(co(spark, d)[0]))


ORACLE["forest_graph"] = f"SELECT (WITH {_ARCS} SELECT count(*) FROM nodes) AS n_nodes, a.e AS n_edges, a.t AS weight, a.t AS own FROM ({_forest('<=', '')}) a"

_CORES = f"""{_ARCS}, core AS (SELECT 0 AS i, part, d AS c FROM deg UNION ALL
  SELECT i + 1, part, max(least(c, k)) FROM (SELECT i, src AS part, c, row_number() OVER (PARTITION BY src ORDER BY c DESC) AS k FROM core JOIN arcs ON dst = part WHERE i < 40) GROUP BY 1, 2)"""
ORACLE["kcore"] = f"WITH RECURSIVE {_CORES} SELECT part, c AS core FROM core WHERE i = 40"


@query
def degeneracy(spark, d):
    """S7."""
    g = co(spark, d)[0]
    k = structure.degeneracy(g)
    return _row(spark, degeneracy=int(k), innermost=structure.nodes_in_core(g, k).count(), second=structure.nodes_in_core(g, 2).count())


ORACLE["degeneracy"] = f"WITH RECURSIVE {_CORES}, c AS (SELECT part, c FROM core WHERE i = 40) SELECT CAST(max(c) AS BIGINT) AS degeneracy, (SELECT count(*) FROM c WHERE c = (SELECT max(c) FROM c)) AS innermost, count(*) FILTER (c >= 2) AS second FROM c"


@query
def spectral_radius(spark, d):
    """Z9 of trade."""
    r = centrality.spectral_radius(trade(spark, d))
    return _row(spark, radius=round(r, 4), alpha=round(centrality.critical_alpha(trade(spark, d)), 9))


ORACLE["spectral_radius"] = _powers(_ONE_STEP.format(value="(coalesce(s.y, 0) + big.c * b.x) / (2 * big.c)"), "1", 200) + ", r AS (SELECT max(c) * (2 * sqrt(sum(x * x) FILTER (i = 200)) / sqrt(sum(x * x) FILTER (i = 199)) - 1) AS r FROM it, big WHERE i >= 199) SELECT round(r, 4) AS radius, round(1 / r, 9) AS alpha FROM r"


@query
def betweenness_visits(spark, d):
    """Z3 over users and event types."""
    return paths.betweenness(_visits(spark, d)).join(_visit_names(spark, d), "node").select("name", _r("score", 6).alias("score"))


ORACLE["betweenness_visits"] = f"""WITH RECURSIVE {_VISITS}, way AS (SELECT name AS s, name AS t, 0 AS k, CAST(1 AS DOUBLE) AS n FROM who UNION ALL
  SELECT s, t, k, sum(n) FROM (SELECT way.s, ways.b AS t, k + 1 AS k, n FROM way JOIN ways ON ways.a = way.t JOIN dist ON dist.s = way.s AND dist.t = ways.b AND dist.d = k + 1) GROUP BY 1, 2, 3)
  SELECT who.name, round(coalesce(sum(x.n * y.n / z.n), 0.0) / 2, 6) AS score FROM who LEFT JOIN (way x JOIN way y ON x.t = y.s JOIN way z ON z.s = x.s AND z.t = y.t AND z.k = x.k + y.k) ON who.name = x.t AND x.k > 0 AND y.k > 0 GROUP BY 1"""
ORACLE["weighted_betweenness"] = f"""WITH RECURSIVE {_TRADE}, far AS (SELECT 0 AS i, node AS s, node AS t, 0.0::DOUBLE AS d FROM nation_nodes UNION ALL
  SELECT i + 1, s, t, min(d) FROM (SELECT i, s, t, d FROM far UNION ALL SELECT i, s, dst, d + weight FROM far JOIN trade ON src = t) WHERE i < 25 GROUP BY 1, 2, 3),
  dist AS (SELECT s, t, d FROM far WHERE i = 25), way AS (SELECT node AS s, node AS t FROM nation_nodes UNION ALL SELECT way.s, dst FROM way JOIN trade ON src = way.t AND src <> dst JOIN dist a ON a.s = way.s AND a.t = way.t JOIN dist b ON b.s = way.s AND b.t = dst WHERE b.d = a.d + weight),
  n AS (SELECT w.s, w.t, CAST(count(*) AS DOUBLE) AS n, any_value(d) AS d FROM way w JOIN dist USING (s, t) GROUP BY 1, 2)
  SELECT node, round(coalesce(sum(x.n * y.n / z.n), 0.0), 6) AS score FROM nation_nodes LEFT JOIN (n x JOIN n y ON x.t = y.s JOIN n z ON z.s = x.s AND z.t = y.t AND z.d = x.d + y.d) ON node = x.t AND x.s <> x.t AND y.s <> y.t GROUP BY 1"""


def _stepwise(spark, d) -> Graph:
    """The co-order graph as one too large for one task: every algorithm runs by supersteps."""
    g = co(spark, d)[0]
    return Graph.undirected(g.edges, g.order(), local=0)


@query
def pagerank_steps(spark, d):
    """Z1 by supersteps."""
    return _by_part(spark, d, centrality.PageRank().of(_stepwise(spark, d))).select("part", _r("score", 8).alias("score"))


@query
def components_steps(spark, d):
    """C7 by supersteps."""
    names = co(spark, d)[1]
    label = connectivity.component_labels(_stepwise(spark, d))
    return label.join(names, "node").join(names.select(F.col("node").alias("label"), F.col("part").alias("component")), "label").select("part", "component")


@query
def hops_steps(spark, d):
    """C1 by supersteps."""
    return _by_part(spark, d, paths.hops(_stepwise(spark, d), 0)).select("part", "distance")


@query
def kcore_steps(spark, d):
    """S6 by supersteps."""
    return _by_part(spark, d, structure.core_numbers(_stepwise(spark, d))).select("part", F.col("core").cast("long").alias("core"))


@query
def forest_steps(spark, d):
    """S11 by supersteps."""
    r = structure.minimum_spanning_forest(_stepwise(spark, d)).agg(F.count("*").alias("n"), F.sum("weight").alias("w")).first()
    return _row(spark, edges=r["n"], least=r["w"])


ORACLE["pagerank_steps"] = ORACLE["pagerank_parts"]
ORACLE["components_steps"] = ORACLE["components"]
ORACLE["hops_steps"] = ORACLE["bfs_hops"]
ORACLE["kcore_steps"] = ORACLE["kcore"]
ORACLE["forest_steps"] = f"SELECT e AS edges, t AS least FROM ({_forest('<=', '')})"


@query
def community_invariants(spark, d):
    """What holds of every result of Leiden and of label propagation: all nodes are placed, Leiden's communities
    are connected and score at least the components, single nodes and the label propagation's."""
    g, names = co(spark, d)
    p, lp = settled(detect.Leiden.modularity().partition(g)), settled(detect.LabelPropagation().partition(g))
    traced, trace = detect.Leiden.modularity().partition_with_trace(g)
    inside = g.edges.join(p.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(p.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst").filter("a = b").select("src", "dst", "weight")
    pieces = connectivity.component_labels(Graph.undirected(inside, g.order())).select("label").distinct().count()
    whole = connectivity.component_labels(g).withColumnRenamed("label", "community")
    q = quality.Modularity().bound_to(g)
    least = max(q.of(g, x) for x in (whole, partition.singletons(spark, g.order()), lp))
    return _row(spark, placed=p.filter("community >= 0").count(), spread=lp.filter("community >= 0").count(), broken=pieces - partition.count(p), better=int(q.of(g, p) >= least - 1e-12), traced=traced.count(), passes=int(trace.count() > 0))


ORACLE["community_invariants"] = f"WITH {_ARCS} SELECT count(*) AS placed, count(*) AS spread, CAST(0 AS BIGINT) AS broken, CAST(1 AS BIGINT) AS better, count(*) AS traced, CAST(1 AS BIGINT) AS passes FROM nodes"


# statistics

_ERF = "(SELECT 2 / sqrt(pi()) * sum(CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END * exp((2 * i + 1) * ln({x}) - lgamma(i + 1)) / (2 * i + 1)) FROM range(0, 90) t(i))"


def _t_tail(t: str, df: str) -> str:
    """Both tails of Student's t by its finite series."""
    theta = f"atan({t} / sqrt({df}))"
    even = f"1 - sin({theta}) * (SELECT sum(exp(lgamma(k + 0.5) - lgamma(k + 1.0) + 2 * k * ln(cos({theta})))) / sqrt(pi()) FROM range(0, CAST({df} // 2 AS BIGINT)) r(k))"
    odd = f"1 - 2 / pi() * ({theta} + sin({theta}) * cos({theta}) * (SELECT coalesce(sum(exp(lgamma(k + 1.0) - lgamma(k + 1.5) + 2 * k * ln(cos({theta})))), 0) * sqrt(pi()) / 2 FROM range(0, CAST(({df} - 1) // 2 AS BIGINT)) r(k)))"
    return f"CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END"


@query
def population_moments(spark, d):
    """T1 in both precisions, T1e."""
    x = Descriptive(_t(spark, d, "orders"), "o_totalprice")
    y = x.with_precision(Precision.FAST)
    return _row(spark, variance=round(x.population_variance(), 1), std_dev=round(x.population_std_dev(), 6), fast=round(y.population_variance(), 1), fast_mean=round(y.mean(), 5), fast_sd=round(y.std_dev(), 6))


ORACLE["population_moments"] = "SELECT round(var_pop(o_totalprice), 1) AS variance, round(stddev_pop(o_totalprice), 6) AS std_dev, round(var_pop(o_totalprice), 1) AS fast, round(avg(o_totalprice), 5) AS fast_mean, round(stddev_samp(o_totalprice), 6) AS fast_sd FROM orders"


@query
def t_tests_p(spark, d):
    """The p-value, and both tails beyond the interval's half width."""
    s = tests.t_student(_t(spark, d, "customer"), "c_mktsegment", "c_acctbal", "BUILDING", "MACHINERY")
    low, high = s.confidence_interval()
    half = tests.TTest((high - low) / 2 / s.standard_error, s.degrees_of_freedom, 0.0, 1.0)
    return _row(spark, p=round(s.p_value(), 8), middle=round((low + high) / 2, 6), beyond=round(half.p_value(), 9))


ORACLE["t_tests_p"] = f"""WITH {_POOL}, m AS (SELECT g, count(*) AS n, avg(v) AS m, var_samp(v) AS s FROM pool GROUP BY 1), x AS (SELECT a.m - b.m AS diff, a.n + b.n - 2 AS df, sqrt(((a.n - 1) * a.s + (b.n - 1) * b.s) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)) AS se FROM m a, m b WHERE a.g = 'BUILDING' AND b.g = 'MACHINERY'),
  y AS (SELECT diff, df, abs(diff / se) AS t FROM x) SELECT round({_t_tail('t', 'df')}, 8) AS p, round(diff, 6) AS middle, 0.05::DOUBLE AS beyond FROM y"""


@query
def mann_whitney_p(spark, d):
    """T17, two-sided."""
    m = tests.mann_whitney(_t(spark, d, "customer"), "c_mktsegment", "c_acctbal", "BUILDING", "MACHINERY")
    return _row(spark, p=round(m.p_value(), 6))


ORACLE["mann_whitney_p"] = f"SELECT round(1 - {_ERF.format(x='y.x')}, 6) AS p FROM (SELECT z / sqrt(2.0::DOUBLE) AS x FROM ({{mw}})) y"


def _by_nation(spark, d):
    c = _t(spark, d, "customer").groupBy(F.col("c_nationkey").cast("double").alias("k")).agg(F.count("*").cast("double").alias("x"), F.avg("c_acctbal").alias("y"))
    return settled(c.select("k", "x", F.round("y", 4).alias("y")))


@query
def fit_inference(spark, d):
    """A fit over the nations (balance on number of customers); intervals by the tails beyond their half widths."""
    f = regression.least_squares(_by_nation(spark, d), ["x"], "y")
    tail = lambda low, high, se: round(tests.TTest((high - low) / 2 / se, f.df, 0.0, 1.0).p_value(), 9)
    (a, b), (c, e), (g, h) = f.confidence_interval(1), f.mean_response_interval([60.0]), f.prediction_interval([60.0], 0.9)
    mean_half = (e - c) / 2 / f._t(0.95)
    return _row(spark, predicted=round(f.predict([60.0]), 6), t=round(f.t_statistic(1), 7), p=round(f.p_value(1), 8), f=round(f.f_statistic(), 7), overall=round(f.overall_p_value(), 8), slope_tail=tail(a, b, f.standard_errors[1]),
                middle=round((c + e) / 2, 6), mean_se=round(mean_half, 6), new_se=round((h - g) / 2 / f._t(0.9), 6), sd=round(f.residual_sd, 6))


_FIT = """c AS (SELECT CAST(count(*) AS DOUBLE) AS x, round(avg(c_acctbal), 4) AS y FROM customer GROUP BY c_nationkey), s AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy FROM c),
  f AS (SELECT *, sxy / sxx AS b, my - sxy / sxx * mx AS a, n - 2 AS df, (syy - sxy * sxy / sxx) / (n - 2) AS v FROM s), g AS (SELECT *, b / sqrt(v / sxx) AS t, a + 60 * b AS mid, v * (1.0 / n + pow(60 - mx, 2) / sxx) AS mv FROM f)"""
ORACLE["fit_inference"] = f"WITH {_FIT} SELECT round(mid, 6) AS predicted, round(t, 7) AS t, round({_t_tail('abs(t)', 'df')}, 8) AS p, round(t * t, 7) AS f, round({_t_tail('abs(t)', 'df')}, 8) AS overall, 0.05::DOUBLE AS slope_tail, round(mid, 6) AS middle, round(sqrt(mv), 6) AS mean_se, round(sqrt(mv + v), 6) AS new_se, round(sqrt(v), 6) AS sd FROM g"


@query
def fit_several(spark, d):
    """Price on three columns, and on quantity and its square."""
    lines = _t(spark, d, "lineitem")
    f, g = regression.least_squares(lines, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"), regression.polynomial(lines, "l_quantity", "l_extendedprice", 2)
    return _row(spark, **{f"b{i}": round(b, 3) for i, b in enumerate(f.coefficients)}, **{f"c{i}": round(b, 4) for i, b in enumerate(g.coefficients)}, r_squared=round(g.r_squared, 8))


def _det(m: list[list[str]]) -> str:
    a, b, c = m
    return f"({a[0]} * ({b[1]} * {c[2]} - {b[2]} * {c[1]}) - {a[1]} * ({b[0]} * {c[2]} - {b[2]} * {c[0]}) + {a[2]} * ({b[0]} * {c[1]} - {b[1]} * {c[0]}))"


def _several() -> str:
    names, y = ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"
    sums = ", ".join([f"covar_pop({a}, {b}) AS s{i}{j}" for i, a in enumerate(names) for j, b in enumerate(names)] + [f"covar_pop({a}, {y}) AS t{i}" for i, a in enumerate(names)] + [f"avg({a}) AS m{i}" for i, a in enumerate(names)] + [f"avg({y}) AS my"])
    full = [[f"s{i}{j}" for j in range(3)] for i in range(3)]
    solved = ", ".join(f"{_det([[f't{i}' if j == k else full[i][j] for j in range(3)] for i in range(3)])} / {_det(full)} AS b{k + 1}" for k in range(3))
    square = "q AS (SELECT covar_pop(x, x) AS a, covar_pop(x, x * x) AS b, covar_pop(x * x, x * x) AS c, covar_pop(x, y) AS p, covar_pop(x * x, y) AS q, avg(x) AS mx, avg(x * x) AS mz, avg(y) AS my, var_pop(y) AS vy FROM (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem)), w AS (SELECT *, (p * c - q * b) / (a * c - b * b) AS c1, (a * q - b * p) / (a * c - b * b) AS c2 FROM q)"
    return f"""WITH s AS (SELECT {sums} FROM lineitem), f AS (SELECT *, {solved} FROM s), {square}
  SELECT round(f.my - f.b1 * m0 - f.b2 * m1 - f.b3 * m2, 3) AS b0, round(b1, 3) AS b1, round(b2, 3) AS b2, round(b3, 3) AS b3, round(w.my - c1 * mx - c2 * mz, 4) AS c0, round(c1, 4) AS c1, round(c2, 4) AS c2, round((c1 * p + c2 * q) / vy, 8) AS r_squared FROM f, w"""


ORACLE["fit_several"] = _several()


@query
def normal_and_erf(spark, d):
    """D1, D7 of columns, N1, N3."""
    x = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    v = (F.col("k").cast("double") + 1) / 10
    high, low = exact_product(0.1, 0.1)
    return x.select("k", _r(fc.erf(v), 10).alias("erf"), _r(fc.erfc(v), 10).alias("erfc"), _r(fc.cumulative("normal", v * F.sqrt(F.lit(2.0))), 10).alias("phi"), _r(fc.quantile("normal", fc.cumulative("normal", v)), 8).alias("back"),
                    F.lit(round(compensated_sum([1e16, 1.0, -1e16]), 1)).alias("total"), F.lit(high == 0.1 * 0.1 and low != 0).alias("split"))


ORACLE["normal_and_erf"] = f"WITH n AS (SELECT CAST(n_nationkey AS BIGINT) AS k, (n_nationkey + 1) / 10.0::DOUBLE AS x FROM nation), e AS (SELECT k, x, {_ERF.format(x='x')} AS e FROM n) SELECT k, round(e, 10) AS erf, round(1 - e, 10) AS erfc, round((1 + e) / 2, 10) AS phi, round(x, 8) AS back, 1.0::DOUBLE AS total, true AS split FROM e"


@query
def gamma_and_beta(spark, d):
    """D8 to D10 at closed forms: P(1, x), Q(2, x), I_x(1, b), I_x(a, 1)."""
    x = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    v, u = (F.col("k").cast("double") + 1) / 4, (F.col("k").cast("double") + 1) / 26
    one, two, three = F.lit(1.0), F.lit(2.0), F.lit(3.0)
    return x.select("k", _r(fc.regularized_gamma_p(one, v), 10).alias("p"), _r(fc.regularized_gamma_q(two, v), 10).alias("q"), _r(fc.regularized_beta(u, one, three), 10).alias("left"), _r(fc.regularized_beta(u, three, one), 10).alias("right"))


ORACLE["gamma_and_beta"] = "WITH n AS (SELECT CAST(n_nationkey AS BIGINT) AS k, (n_nationkey + 1) / 4.0::DOUBLE AS v, (n_nationkey + 1) / 26.0::DOUBLE AS u FROM nation) SELECT k, round(1 - exp(-v), 10) AS p, round(exp(-v) * (1 + v), 10) AS q, round(1 - pow(1 - u, 3), 10) AS left, round(pow(u, 3), 10) AS right FROM n"


def _mmr() -> str:
    """Five rounds, each the best of all vectors that were not picked before."""
    ctes = ["v AS (SELECT vec_id AS key, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)", "q AS (SELECT key AS query, x FROM v WHERE key % 20 = 0)", "s AS (SELECT query, key, v.x AS x, list_cosine_similarity(q.x, v.x) AS sim, 0.0::DOUBLE AS red FROM q, v)"]
    for k in range(1, 6):
        last = "s" if k == 1 else f"s{k - 1}"
        red = "0.0" if k == 1 else "red"
        ctes.append(f"b{k} AS (SELECT query, key, x FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY 0.7::DOUBLE * sim - 0.3::DOUBLE * {red} DESC, key) AS r FROM {last}) WHERE r = 1)")
        worst = f"greatest(0.0, list_cosine_similarity(a.x, b{k}.x))" if k == 1 else f"greatest(red, list_cosine_similarity(a.x, b{k}.x))"
        ctes.append(f"s{k} AS (SELECT a.query, a.key, a.x, sim, {worst} AS red FROM {last} a JOIN b{k} ON a.query = b{k}.query WHERE a.key <> b{k}.key)")
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(f"SELECT query, key, {k} AS rank FROM b{k}" for k in range(1, 6))


ORACLE["mmr"] = _mmr()
ORACLE["mann_whitney_p"] = ORACLE["mann_whitney_p"].replace("{mw}", ORACLE["mann_whitney"])

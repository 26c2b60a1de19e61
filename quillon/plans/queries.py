"""The queries of the driver's contract over the test tables, each with the SQL that gives its rows (plans.oracle).

Graphs: co (parts ordered together in two orders or more, weighted, nodes numbered by rank of the part's key), trade
(customers' nation to suppliers' nation, directed), visits (users and event types, bipartite).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.iterate import python_path, settled
from quillon.operators.community import agreement, detect, partition, quality
from quillon.operators.graph import centrality, connectivity, paths, structure
from quillon.operators.graph.frame import Graph
from quillon.operators.retrieval import search, similarity
from quillon.operators.stats import correlation, ranks, regression, tests
from quillon.operators.stats.descriptive import Descriptive, describe
from quillon.sources.interop import LabelledGraph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        python_path(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _row(spark: SparkSession, **values) -> DataFrame:
    """One row of numbers."""
    cells = ", ".join(f"CAST({'NULL' if v is None else repr(v) + ('D' if isinstance(v, float) else 'L')} AS {'DOUBLE' if isinstance(v, float) else 'BIGINT'}) AS {k}" for k, v in values.items())
    return spark.sql(f"SELECT {cells}")


def _r(c, n: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


#: Rows of lineitem in a task of co_edges(), each of which gives about two pairs of parts.
LINES_A_TASK = 200_000


def co_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, weight over part keys: distinct (order, part) joined on the order.

    Tasks are counted in rows: keys pack well and pairs are many more bytes than what they come from, so tasks merged by the
    bytes they read would grow far beyond them. Nearly all pairs occur once, so they are counted after the exchange only."""
    table = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    tasks = max(spark.sparkContext.defaultParallelism, -(-table.count() // LINES_A_TASK))
    lines = table.repartition(tasks, "l_orderkey").distinct()
    other = lines.select("l_orderkey", F.col("l_partkey").alias("other"))
    pairs = lines.join(other.hint("merge"), "l_orderkey").filter("l_partkey < other").select(F.col("l_partkey").alias("src"), F.col("other").alias("dst"))
    return pairs.repartition(tasks, "src", "dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")).filter("weight >= 2")


_graphs: dict[tuple, tuple] = {}


def co(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame]:
    """The co-order graph over the parts in it, and (node, name)."""
    key = (spark.sparkContext.applicationId, sf_dir, "co")
    if key not in _graphs:
        edges = settled(co_edges(spark, sf_dir))
        ends = edges.select(F.lpad(F.col("src").cast("string"), 12, "0").alias("src"), F.lpad(F.col("dst").cast("string"), 12, "0").alias("dst"), "weight")
        named = LabelledGraph.from_edges(ends)
        names = settled(named.index.names.select(F.col("id").alias("node"), F.col("name").cast("long").alias("part")))
        _graphs[key] = named.graph, names
    return _graphs[key]


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    key = (spark.sparkContext.applicationId, sf_dir, "trade")
    if key not in _graphs:
        lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
        orders = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        customer = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("src"))
        supplier = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("dst"))
        flows = lines.join(orders, "l_orderkey").join(customer, "o_custkey").join(supplier, "l_suppkey").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
        _graphs[key] = (Graph.of_directed(flows, 25),)
    return _graphs[key][0]


def _by_part(spark: SparkSession, sf_dir: str, scores: DataFrame) -> DataFrame:
    return scores.join(co(spark, sf_dir)[1], "node").drop("node")


# graphs


@query
def degree_strength(spark, d):
    """G6, G7."""
    return _by_part(spark, d, co(spark, d)[0].degrees()).select("part", "degree", "strength")


@query
def directed_edges(spark, d):
    """G2."""
    return trade(spark, d).edges


@query
def directed_degrees(spark, d):
    return trade(spark, d).degrees().select("node", "degree", "strength")


@query
def self_loops(spark, d):
    """G8."""
    return trade(spark, d).self_loops()


@query
def graph_totals(spark, d):
    """G3, G12."""
    g, t = co(spark, d)[0], trade(spark, d)
    return _row(spark, n_nodes=g.order(), n_edges=g.size(), total=g.total_weight(), endpoints=g.total_endpoint_weight(), arcs=t.size(), flow=t.total_endpoint_weight())


@query
def neighbours(spark, d):
    """G9 of the lowest part."""
    g, names = co(spark, d)
    return g.neighbours(0).join(names, "node").select("part", "weight")


@query
def node_index(spark, d):
    """Event types numbered by first appearance."""
    from quillon.sources.interop import NodeIndex

    return NodeIndex.of(_t(spark, d, "events"), "event_type", "event_id").names


@query
def matrix_graph(spark, d):
    """The trade matrix, upper triangle."""
    t = trade(spark, d).edges.select("src", "dst", "weight")
    rows = t.groupBy(F.col("src").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("dst", "weight"))).alias("m"))
    full = spark.range(25).select(F.col("id").alias("row")).join(rows, "row", "left").select("row", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long")), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("values"))
    return LabelledGraph.from_matrix(settled(full)).graph.edges


@query
def components(spark, d):
    """The smallest part of each part's component."""
    g, names = co(spark, d)
    label = connectivity.component_labels(g)
    return label.join(names, "node").join(names.select(F.col("node").alias("label"), F.col("part").alias("component")), "label").select("part", "component")


@query
def bfs_hops(spark, d):
    """C1 from the lowest part."""
    return _by_part(spark, d, paths.hops(co(spark, d)[0], 0)).select("part", "distance")


@query
def weighted_distance(spark, d):
    """C2 from nation 0, over trade."""
    return paths.distances(trade(spark, d), 0).select("node", "distance")


@query
def strong_components(spark, d):
    """C9 over the strongest ties: arcs of at least the mean weight."""
    t = trade(spark, d)
    mean = t.total_weight() / max(1, t.size())
    g = Graph.of_directed(t.edges.filter(F.col("weight") >= mean), 25)
    return connectivity.strong_labels(g)


@query
def bridges(spark, d):
    """C11."""
    g, names = co(spark, d)
    found = connectivity.bridges(g)
    return found.join(names.select(F.col("node").alias("src"), F.col("part").alias("part_a")), "src").join(names.select(F.col("node").alias("dst"), F.col("part").alias("part_b")), "dst").select("part_a", "part_b")


@query
def articulation_points(spark, d):
    """C12."""
    return _by_part(spark, d, connectivity.articulation_points(co(spark, d)[0])).select("part")


@query
def distance_summary(spark, d):
    """C4 to C6 over users and event types."""
    x = paths.distance(_visits(spark, d))
    return _row(spark, total=x.total_distance, pairs=x.reachable_pairs, components=x.components, diameter=float(x.diameter()), radius=float(x.radius()))


def _visits(spark, d) -> Graph:
    key = (spark.sparkContext.applicationId, d, "visits")
    if key not in _graphs:
        e = _t(spark, d, "events").filter("user_id is not null and event_type is not null")
        ends = e.select(F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 12, "0")).alias("src"), F.concat(F.lit("e"), "event_type").alias("dst"), F.lit(1.0).alias("weight"))
        _graphs[key] = (LabelledGraph.from_edges(ends),)
    return _graphs[key][0].graph


def _visit_names(spark, d) -> DataFrame:
    _visits(spark, d)
    return _graphs[(spark.sparkContext.applicationId, d, "visits")][0].index.names.select(F.col("id").alias("node"), "name")


@query
def closeness(spark, d):
    """Z5 over users and event types."""
    return paths.closeness(_visits(spark, d)).join(_visit_names(spark, d), "node").select("name", _r("score", 8).alias("score"))


@query
def harmonic(spark, d):
    """Z6 over users and event types."""
    return paths.harmonic(_visits(spark, d)).join(_visit_names(spark, d), "node").select("name", _r("score", 6).alias("score"))


@query
def betweenness(spark, d):
    """Z3."""
    return _by_part(spark, d, paths.betweenness(co(spark, d)[0])).select("part", _r("score", 6).alias("score"))


@query
def weighted_betweenness(spark, d):
    """Z4."""
    return paths.weighted_betweenness(trade(spark, d)).select("node", _r("score", 6).alias("score"))


@query
def pagerank(spark, d):
    """Z1 over trade."""
    return centrality.PageRank().of(trade(spark, d)).select("node", _r("score", 9).alias("score"))


@query
def personalised_pagerank(spark, d):
    """Z2 restarting at nations 0 and 1."""
    restart = spark.sql("SELECT 0L AS node, 1D AS weight UNION ALL SELECT 1L, 3D")
    return centrality.PageRank().of(trade(spark, d), restart).select("node", _r("score", 9).alias("score"))


@query
def pagerank_parts(spark, d):
    """Z1 over parts ordered together."""
    return _by_part(spark, d, centrality.PageRank().of(co(spark, d)[0])).select("part", _r("score", 8).alias("score"))


@query
def hits(spark, d):
    """Z10 over trade."""
    return centrality.Hits().of(trade(spark, d)).select("node", _r("hub", 8).alias("hub"), _r("authority", 8).alias("authority"))


@query
def eigenvector(spark, d):
    """Z7 over trade."""
    return centrality.Eigenvector().of(trade(spark, d)).select("node", _r("score", 8).alias("score"))


@query
def katz(spark, d):
    """Z8, Z9 over trade, alpha half of one over the largest outgoing strength, which bounds the spectral radius."""
    t = trade(spark, d)
    return centrality.Katz(alpha=0.5 / t.strengths().agg(F.max("strength")).first()[0]).of(t).select("node", _r("score", 8).alias("score"))


@query
def triangles(spark, d):
    """S1."""
    return _by_part(spark, d, structure.triangles(co(spark, d)[0])).select("part", "triangles")


@query
def clustering(spark, d):
    """S3."""
    return _by_part(spark, d, structure.clustering(co(spark, d)[0])).select("part", _r("coefficient", 8).alias("coefficient"))


@query
def transitivity(spark, d):
    """S2, S4, S5."""
    g = co(spark, d)[0]
    return _row(spark, triangles=structure.triangle_count(g), average=round(structure.average_clustering(g), 8), transitivity=round(structure.transitivity(g), 8))


@query
def kcore(spark, d):
    """S6, S7."""
    return _by_part(spark, d, structure.core_numbers(co(spark, d)[0])).select("part", "core")


@query
def assortativity(spark, d):
    """S8."""
    return _row(spark, r=round(structure.degree_assortativity(co(spark, d)[0]), 8))


@query
def link_scores(spark, d):
    """S9a to S9e of all linked pairs."""
    g, names = co(spark, d)
    scores = structure.link_scores(g, g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    named = scores.join(names.select(F.col("node").alias("a"), F.col("part").alias("part_a")), "a").join(names.select(F.col("node").alias("b"), F.col("part").alias("part_b")), "b")
    return named.select("part_a", "part_b", "common_neighbours", _r("jaccard", 8).alias("jaccard"), _r("adamic_adar", 8).alias("adamic_adar"), _r("resource_allocation", 8).alias("resource_allocation"), "preferential_attachment")


@query
def link_rank(spark, d):
    """S10 for the lowest part, its best 20."""
    g, names = co(spark, d)
    return structure.rank_links(g, 0, structure.LinkMeasure.RESOURCE_ALLOCATION, 20).join(names, "node").select("part", _r("score", 8).alias("score"))


@query
def spanning_forest(spark, d):
    """S11, S12."""
    g = co(spark, d)[0]
    least, most = structure.minimum_spanning_forest(g), structure.maximum_spanning_forest(g)
    a, b = (x.agg(F.count("*").alias("n"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w")).first() for x in (least, most))
    return _row(spark, edges=a["n"], least=a["w"], most=b["w"], edges_most=b["n"])


# communities


def _given(spark, d) -> DataFrame:
    """A partition of the co-order graph: the part's key modulo 7."""
    return co(spark, d)[1].select("node", (F.col("part") % 7).cast("int").alias("community"))


@query
def modularity(spark, d):
    """M6."""
    return _row(spark, q=round(quality.Modularity().of(co(spark, d)[0], _given(spark, d)), 8), q2=round(quality.Modularity(0.5).of(co(spark, d)[0], _given(spark, d)), 8))


@query
def potts(spark, d):
    """M7, M8."""
    g, p = co(spark, d)[0], _given(spark, d)
    return _row(spark, cpm=round(quality.ConstantPotts(0.1).of(g, p), 6), rber=round(quality.ErdosRenyiPotts().of(g, p), 6), density=round(quality.density_of(g), 8))


@query
def surprise_significance(spark, d):
    """M9 to M11."""
    g, p = co(spark, d)[0], _given(spark, d)
    return _row(spark, surprise=round(quality.Surprise().of(g, p), 6), significance=round(quality.Significance().of(g, p), 6))


@query
def leiden(spark, d):
    """M1 to M4."""
    return _by_part(spark, d, detect.Leiden().partition(co(spark, d)[0])).select("part", "community")


@query
def label_propagation(spark, d):
    """M5."""
    return _by_part(spark, d, detect.LabelPropagation().partition(co(spark, d)[0])).select("part", "community")


def _pair(spark, d) -> tuple[DataFrame, DataFrame]:
    o = _t(spark, d, "orders").filter("o_orderstatus is not null and o_orderpriority is not null").select(F.col("o_orderkey").alias("node"), "o_orderstatus", "o_orderpriority")
    code = lambda c: F.pmod(F.xxhash64(c), F.lit(1_000_003)).cast("int")
    return o.select("node", code("o_orderstatus").alias("community")), o.select("node", code("o_orderpriority").alias("community"))


@query
def partition_agreement(spark, d):
    """M13 to M15 of orders by status and by priority."""
    a, b = _pair(spark, d)
    return _row(spark, nmi=round(agreement.normalised_mutual_information(a, b), 8), ari=round(agreement.adjusted_rand_index(a, b), 8), vi=round(agreement.variation_of_information(a, b), 8))


@query
def partition_canonical(spark, d):
    """customers' segments numbered by first appearance."""
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("node"), "c_mktsegment").filter("c_mktsegment is not null")
    return partition.canonical(c, "c_mktsegment")


@query
def partition_filter(spark, d):
    """nations' communities of customers with fewer than 50 dissolved."""
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").cast("int").alias("label"))
    return partition.without_small(partition.canonical(c, "label"), 50)[0]


# statistics


@query
def describe_prices(spark, d):
    """T1 a to k by return flag."""
    out = describe(_t(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", "n", _r("sum", 2).alias("sum"), _r("mean", 6).alias("mean"), "min", "max", _r("variance", 2).alias("variance"), _r("std_dev", 5).alias("std_dev"), _r("standard_error", 6).alias("standard_error"), _r("skewness", 6).alias("skewness"), _r("kurtosis", 6).alias("kurtosis"), _r("q1", 4).alias("q1"), _r("median", 4).alias("median"), _r("q3", 4).alias("q3"))


@query
def descriptive(spark, d):
    """T1 in extended precision."""
    x = Descriptive(_t(spark, d, "orders"), "o_totalprice")
    return _row(spark, n=x.count(), sum=round(x.sum(), 2), mean=round(x.mean(), 5), variance=round(x.variance(), 1), skewness=round(x.skewness(), 7), kurtosis=round(x.kurtosis(), 7), cv=round(x.coefficient_of_variation(), 8), range=round(x.range(), 4), iqr=round(x.iqr(), 4))


@query
def autocorrelation(spark, d):
    """T1h of event values by event_id."""
    x = Descriptive(_t(spark, d, "events"), "value", "event_id")
    return _row(spark, lag1=round(x.autocorrelation(), 9), lag3=round(x.autocorrelation(3), 9))


@query
def midranks(spark, d):
    """T2 of orders' prices."""
    return ranks.midranks(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", "midrank")


@query
def tie_sizes(spark, d):
    """T3."""
    return ranks.tie_sizes(_t(spark, d, "lineitem"), "l_quantity").select("value", "ties")


@query
def tied_pairs(spark, d):
    """T4."""
    return _row(spark, pairs=ranks.tied_pairs(_t(spark, d, "lineitem"), "l_quantity"))


@query
def pearson(spark, d):
    """T5."""
    return _row(spark, r=round(correlation.pearson(_t(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), 9))


@query
def spearman(spark, d):
    """T6."""
    return _row(spark, r=round(correlation.spearman(_t(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), 9))


@query
def kendall(spark, d):
    """T7 of customers' nation and balance."""
    return _row(spark, tau=round(correlation.kendall(_t(spark, d, "customer"), "c_nationkey", "c_acctbal"), 9))


@query
def correlation_matrix(spark, d):
    """T8."""
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    m = correlation.matrix(_t(spark, d, "lineitem"), names)
    return _row(spark, **{f"r{i}{j}": round(m[i][j], 8) for i in range(4) for j in range(i)})


@query
def anova(spark, d):
    """T9 to T11."""
    a = tests.anova(_t(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")
    return _row(spark, f=round(a.f, 8), between_df=a.between_df, within_df=a.within_df, r_squared=round(a.r_squared, 10), p=round(a.p_value(), 8))


@query
def kruskal_wallis(spark, d):
    """T18, T19."""
    k = tests.kruskal_wallis(_t(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")
    return _row(spark, h=round(k.statistic, 6), df=k.degrees_of_freedom, p=round(k.p_value(), 7))


@query
def chi_squared(spark, d):
    """T12, T13."""
    x = tests.chi_squared(_t(spark, d, "lineitem"), "l_returnflag", "l_linestatus")
    return _row(spark, statistic=round(x.statistic, 6), df=x.degrees_of_freedom, p=round(x.p_value(), 8))


@query
def t_tests(spark, d):
    """T14."""
    c = _t(spark, d, "customer")
    w, s = (f(c, "c_mktsegment", "c_acctbal", "BUILDING", "MACHINERY") for f in (tests.t_welch, tests.t_student))
    return _row(spark, welch=round(w.statistic, 8), welch_df=round(w.degrees_of_freedom, 6), student=round(s.statistic, 8), student_df=int(s.degrees_of_freedom))


@query
def mann_whitney(spark, d):
    """T16."""
    m = tests.mann_whitney(_t(spark, d, "customer"), "c_mktsegment", "c_acctbal", "BUILDING", "MACHINERY")
    return _row(spark, u=m.statistic, z=round(m.z, 8))


def _family(spark, d) -> DataFrame:
    """A p-value a nation: the share of its customers with a balance at or above theirs, from ranks."""
    c = _t(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("nation")).agg(F.avg("c_acctbal").alias("m"))
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    return c.select("nation", (F.pow(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("m", "nation")) / (n + 1), F.lit(2.0)) * 0.2).alias("p"))


@query
def multiple_testing(spark, d):
    """T20, T21."""
    p = settled(_family(spark, d))
    out = p
    for m in tests.Adjustment:
        own = tests.adjust(p, "p", m).select("nation", _r("adjusted", 9).alias(m.value.replace("-", "_")))
        out = out.join(own, "nation")
    rejected = tests.rejected(p, "p", tests.Adjustment.BENJAMINI_HOCHBERG).select("nation", "rejected")
    return out.join(rejected, "nation").select("nation", "bonferroni", "holm", "benjamini_hochberg", "rejected")


@query
def ols_simple(spark, d):
    """T22, T24, T28 of price on quantity."""
    f = regression.least_squares(_t(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice")
    return _row(spark, intercept=round(f.coefficients[0], 4), slope=round(f.coefficients[1], 5), r_squared=round(f.r_squared, 9), n=f.n)


@query
def ols_multiple(spark, d):
    """T22 of price on three columns, with standard errors; no SQL for several columns."""
    f = regression.least_squares(_t(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return _row(spark, **{f"b{i}": b for i, b in enumerate(f.coefficients)}, **{f"se{i}": s for i, s in enumerate(f.standard_errors)}, f=f.f_statistic(), p=f.overall_p_value())


@query
def polynomial_fit(spark, d):
    """T23 of price on quantity, degree 2."""
    f = regression.polynomial(_t(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 2)
    return _row(spark, **{f"b{i}": b for i, b in enumerate(f.coefficients)}, sd=f.residual_sd)


@query
def distributions(spark, d):
    """D1 to D10 of columns, at values with closed forms: chi-squared with 2 degrees of freedom, F with 2 and 10, t with 1."""
    from quillon.functions import columns as c

    x = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    v = F.col("k").cast("double") / 5
    return x.select("k", _r(c.survival("chi2", v, F.lit(2.0)), 9).alias("chi2"), _r(c.survival("f", v, F.lit(2.0), F.lit(10.0)), 9).alias("f"), _r(c.cumulative("t", v, F.lit(1.0)), 9).alias("t"), _r(c.upper_quantile("chi2", 1 / (F.col("k") + 2), F.lit(2.0)), 8).alias("q"), _r(c.log_gamma(F.col("k") + 1), 8).alias("lg"))


# retrieval


@query
def similarities(spark, d):
    """R1, R2 of each vector with vector 0."""
    e = _t(spark, d, "embeddings").select("vec_id", "embedding")
    zero = F.broadcast(e.filter("vec_id = 0").limit(1).select(F.col("embedding").alias("q"), F.lit(True).alias("one")))
    pairs = e.withColumn("one", F.lit(True)).join(zero, "one")
    a, b = F.col("embedding"), F.col("q")
    return pairs.select("vec_id", _r(similarity.cosine(a, b), 8).alias("cosine"), _r(similarity.dot(a, b), 6).alias("dot"), _r(similarity.euclidean(a, b), 6).alias("euclidean"))


@query
def set_jaccard(spark, d):
    """R3 of the words of consecutive benchmark items."""
    b = _t(spark, d, "benchmark").select("item_id", F.split("text", " ").alias("ws"))
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("ws").alias("other"))
    return b.join(nxt, "item_id").select("item_id", _r(similarity.jaccard(F.col("ws"), F.col("other")), 9).alias("jaccard"))


def _vectors(spark, d) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("vector"))


@query
def knn_cosine(spark, d):
    """The 5 nearest of every vector whose id is divisible by 20, among all."""
    v = _vectors(spark, d)
    return search.nearest(v.filter("key % 20 = 0"), v, 5).select("query", "key", _r("similarity", 7).alias("similarity"), "rank")


@query
def mmr(spark, d):
    """R5 over all vectors. A query's first pick is itself here: at a weight of a half all others would tie then."""
    v = _vectors(spark, d)
    return search.marginal_relevance_of_all(v.filter("key % 20 = 0"), v, 5, 0.7)


@query
def rrf(spark, d):
    """R6 of two rankings of the parts, by price and by key."""
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("key"), "p_retailprice")
    place = lambda first: F.struct(first.alias("a"), F.col("key").alias("b")).alias("position")
    both = p.select("key", F.lit("price").alias("ranking"), place(-F.col("p_retailprice"))).unionByName(p.select("key", F.lit("key").alias("ranking"), place(F.col("key").cast("double"))))
    return search.reciprocal_rank_fusion(both).select("key", _r("score", 12).alias("score"))

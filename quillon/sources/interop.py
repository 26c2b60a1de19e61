"""Named graphs: node names against numbers, graphs from edge lists, adjacency, matrices and mixed-direction edge rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.errors import InvalidArgument, require
from quillon.iterate import settled
from quillon.operators.graph.frame import Graph
from quillon.plans.prefix import running_total


class NodeIndex:
    """names: (name, id), ids from 0 by first appearance."""

    def __init__(self, names: DataFrame):
        self.names = names

    @classmethod
    def of(cls, df: DataFrame, name: str = "name", ordinal: str = "ordinal") -> NodeIndex:
        first = df.filter(F.col(name).isNotNull()).groupBy(F.col(name).cast("string").alias("name")).agg(F.min(ordinal).alias("_at"))
        numbered = running_total(first, [F.col("_at"), F.col("name")], F.lit(1), "_n")
        return cls(settled(numbered.select("name", (F.col("_n") - 1).cast("long").alias("id"))))

    def add(self, df: DataFrame, name: str = "name", ordinal: str = "ordinal") -> NodeIndex:
        """With names not known yet numbered on; known ones keep their numbers."""
        new = df.select(F.col(name).cast("string").alias("name"), F.col(ordinal).alias("ordinal")).join(self.names, "name", "left_anti")
        more = NodeIndex.of(new).names.withColumn("id", F.col("id") + self.count())
        return NodeIndex(settled(self.names.unionByName(more)))

    def has(self, name: object) -> bool:
        return bool(self.names.filter(F.col("name") == str(name)).take(1))

    def node_for(self, name: object) -> int:
        found = self.names.filter(F.col("name") == str(name)).first()
        require(found is not None, f"there is no node named {name!r}")
        return found["id"]

    def identifier_for(self, node: int) -> str:
        found = self.names.filter(F.col("id") == node).first()
        require(found is not None, f"there is no node {node}")
        return found["name"]

    def count(self) -> int:
        return self.names.count()

    def identifiers(self) -> DataFrame:
        return self.names.orderBy("id").select("name")

    def label(self, partition: DataFrame) -> DataFrame:
        """name, community."""
        return partition.join(self.names.withColumnRenamed("id", "node"), "node").select("name", "community")


class LabelledGraph:
    def __init__(self, graph: Graph, index: NodeIndex):
        require(graph.order() == index.count(), "the graph and its index have different numbers of nodes")
        self.graph, self.index = graph, index

    @classmethod
    def from_edges(cls, edges: DataFrame, nodes: DataFrame | None = None, directed: bool = False, ordinal: str | None = None, src: str = "src", dst: str = "dst", weight: str = "weight") -> LabelledGraph:
        """edges of names; `nodes` (name, ordinal) are numbered before them. Names are numbered by first appearance in the
        order of `ordinal`, or without one in the order of the names."""
        w = F.col(weight).cast("double") if weight in edges.columns else F.lit(None).cast("double")
        at = F.col(ordinal).cast("long") if ordinal else F.lit(0).cast("long")
        own = edges.select(F.col(src).cast("string").alias("a"), F.col(dst).cast("string").alias("b"), w.alias("weight"), at.alias("at"))
        ends = own.select(F.col("a").alias("name"), F.struct(F.lit(1).alias("late"), F.col("at"), F.lit(0).alias("end")).alias("ordinal")).unionByName(
            own.select(F.col("b").alias("name"), F.struct(F.lit(1).alias("late"), F.col("at"), F.lit(1 if ordinal else 0).alias("end")).alias("ordinal"))
        )
        if nodes is not None:
            place = F.col("ordinal").cast("long") if "ordinal" in nodes.columns else F.lit(0).cast("long")
            ends = nodes.select(F.col("name").cast("string").alias("name"), F.struct(F.lit(0).alias("late"), place.alias("at"), F.lit(0).alias("end")).alias("ordinal")).unionByName(ends)
        index = NodeIndex.of(ends)
        a, b = (index.names.select(F.col("name").alias(c), F.col("id").alias(i)) for c, i in (("a", "src"), ("b", "dst")))
        numbered = own.join(a, "a").join(b, "b").select("src", "dst", "weight")
        n = index.count()
        return cls(Graph.of_directed(numbered, n) if directed else Graph.undirected(numbered, n), index)

    @classmethod
    def from_adjacency(cls, adjacency: DataFrame, directed: bool = False, ordinal: str | None = None) -> LabelledGraph:
        """adjacency: (name, neighbours), neighbours an array of names or a map from names to weights."""
        kind = adjacency.schema["neighbours"].dataType.typeName()
        at = [F.col(ordinal)] if ordinal else []
        if kind == "map":
            edges = adjacency.select("name", *at, F.explode("neighbours").alias("dst", "weight"))
        elif kind == "array":
            edges = adjacency.select("name", *at, F.explode("neighbours").alias("dst")).withColumn("weight", F.lit(1.0))
        else:
            raise InvalidArgument("neighbours must be an array or a map")
        nodes = adjacency.select("name", *([F.col(ordinal).alias("ordinal")] if ordinal else []))
        return cls.from_edges(edges.withColumnRenamed("name", "src"), nodes, directed, ordinal)

    @classmethod
    def from_matrix(cls, matrix: DataFrame, directed: bool = False, labels: list[str] | None = None) -> LabelledGraph:
        """matrix: (row, values), one row a node, 0 for no edge; undirected reads the upper triangle with the diagonal."""
        r = matrix.agg(F.count("*").alias("n"), F.countDistinct("row").alias("d"), F.min("row").alias("low"), F.max("row").alias("high"), F.min(F.size("values")).alias("a"), F.max(F.size("values")).alias("b")).first()
        n = r["n"]
        require(not n or (r["d"] == n and r["low"] == 0 and r["high"] == n - 1), "a matrix's rows must be numbered from 0")
        require(not n or (r["a"] == n and r["b"] == n), "a matrix must be square")
        require(labels is None or (len(labels) == n and len(set(labels)) == n), "labels must be as many as rows, all different")
        cells = matrix.select(F.col("row").cast("long").alias("src"), F.posexplode("values").alias("dst", "weight")).select("src", F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("weight")).filter("weight <> 0")
        edges = cells if directed else cells.filter("dst >= src")
        spark = matrix.sparkSession
        names = spark.range(n).select(F.col("id").cast("string").alias("name"), "id") if labels is None else spark.createDataFrame(list(zip(labels, range(n), strict=True)) or [], "name string, id long")
        return cls(Graph.of_directed(edges, n) if directed else Graph.undirected(edges, n), NodeIndex(names))

    @classmethod
    def from_mixed(cls, edges: DataFrame, nodes: DataFrame | None = None, ordinal: str | None = None) -> LabelledGraph:
        """edges: (src, dst, weight, directed). One directed edge makes the graph directed; undirected edges then go both
        ways, loops once. A null weight is 1."""
        mixed = bool(edges.filter("directed").take(1))
        if mixed:
            turn = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
            keep = [c for c in edges.columns if c not in ("src", "dst")]
            edges = edges.select(*keep, F.explode(F.when(F.col("directed") | (F.col("src") == F.col("dst")), F.slice(turn, 1, 1)).otherwise(turn)).alias("e")).select(*keep, "e.src", "e.dst")
        return cls.from_edges(edges, nodes, mixed, ordinal)

    def node(self, name: object) -> int:
        return self.index.node_for(name)

    def identifier(self, node: int) -> str:
        return self.index.identifier_for(node)

    def membership(self, partition: DataFrame) -> DataFrame:
        return self.index.label(partition)

    def communities(self, partition: DataFrame) -> DataFrame:
        """community, names in node order."""
        named = partition.filter("community >= 0").join(self.index.names.withColumnRenamed("id", "node"), "node")
        return named.groupBy("community").agg(F.transform(F.sort_array(F.collect_list(F.struct("node", "name"))), lambda x: x["name"]).alias("names")).orderBy("community")

    def named(self, scores: DataFrame) -> DataFrame:
        """A frame by node, by name."""
        return scores.join(self.index.names.withColumnRenamed("id", "node"), "node").drop("node")


def read_edges(spark: SparkSession, path: str, form: str = "parquet", **options) -> DataFrame:
    """src, dst, weight from a file of edges, only those columns."""
    df = spark.read.format(form).options(**options).load(path)
    return df.select(*(c for c in ("src", "dst", "weight") if c in df.columns))

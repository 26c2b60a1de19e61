"""Shared helpers: text access, work tables in the cluster's shared folder, and order-preserving row keys."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Rows in an Arrow batch: whole texts travel in them, so far fewer than Spark's 10,000.
BATCH_ROWS = 512

_tables: list[str] = []


def tune(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that carry whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a folder of our own only where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillon-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/quillon-work/{name}-{uuid.uuid4().hex}"
    _tables.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, computes the plan once and survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def work_tables() -> list[str]:
    return list(_tables)


def drop_tables(spark: SparkSession, paths: Iterable[str]) -> None:
    _delete(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), list(paths))


def _delete(jvm, conf, paths: list[str]) -> None:
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        if path in _tables:
            _tables.remove(path)


@atexit.register
def _drop_all() -> None:
    """Through the JVM, which outlives a stopped session."""
    context = SparkContext._active_spark_context
    jvm = context._jvm if context is not None else (SparkContext._gateway.jvm if SparkContext._gateway else None)
    if jvm is None or not _tables:
        return
    try:
        conf = context._jsc.hadoopConfiguration() if context is not None else jvm.org.apache.hadoop.conf.Configuration()
        _delete(jvm, conf, list(_tables))
    except Exception:  # noqa: BLE001  the JVM may have gone first
        pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def python_path(spark: SparkSession) -> None:
    """Let Python workers import this package when it is run from a checkout that isn't on their path."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH") or "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH") or os.environ.get("PYTHONPATH")) if x)


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The batches' rows as tuples, converted in small slices so that long texts aren't all held twice."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


class Out:
    """Collects rows and gives record batches of bounded size."""

    def __init__(self, schema: pa.Schema, rows: int = 2048, size: int = 8 << 20):
        self.schema, self.most, self.size = schema, rows, size
        self.cols: list[list] = [[] for _ in schema]
        self.bytes = 0

    def add(self, *values) -> bool:
        """True when flush() is due."""
        for c, v in zip(self.cols, values, strict=True):
            c.append(v)
            if isinstance(v, (bytes, str)):
                self.bytes += len(v)
        return len(self.cols[0]) >= self.most or self.bytes >= self.size

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.cols, self.schema, strict=True)], schema=self.schema)
            self.cols, self.bytes = [[] for _ in self.schema], 0


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free(name: str, *frames: DataFrame) -> str:
    """`name`, lengthened until none of the frames has such a column (Spark's names ignore case by default)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def mapped(df: DataFrame, run, columns: int | None = None) -> DataFrame:
    """df.mapInArrow(run) with the first `columns` columns (all) as the result, whose names may hold dots: inside they are
    c0, c1 and so on."""
    fields = df.schema.fields[:columns]
    flat = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return flat.mapInArrow(run, StructType([StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(fields)])).toDF(*(f.name for f in fields))


def set_aside(names: list[str], own: Iterable[str]) -> list[str]:
    """Names for columns of the input beside result columns `own`: one that clashes is lengthened by "_" until it is free."""
    taken = {x.lower() for x in (*own, *names)}
    clash, out = {x.lower() for x in own}, []
    for c in names:
        if c.lower() in clash:
            while c.lower() in taken:
                c += "_"
            taken.add(c.lower())
        out.append(c)
    return out


def with_key(docs: DataFrame, text: str = "text", key: str = "_key") -> DataFrame:
    return keyed(docs, text, key)[0]


def keyed(docs: DataFrame, text: str = "text", key: str = "_key") -> tuple[DataFrame, bool]:
    """docs with a unique-or-equal, never null, order-preserving long key, in a column `key` that docs hasn't (see free());
    and whether that is doc_id itself.

    Usually that is doc_id itself. Only where doc_ids are null or repeated (one look at that column decides), keys are
    numbered over the distinct (doc_id, text): null ids first, equal ids by the text's SHA-256. Rows equal in both share
    a key.
    """
    if key != free(key, docs):
        raise ValueError(f"there is a column {key} already")
    ids = docs.select("doc_id")
    odd = ids.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").limit(1)
    if not odd.take(1):
        return docs.withColumn(key, F.col("doc_id").cast("long")), True
    digest, same, name, number = (free(c, docs) for c in ("_mark", "_same", "_id", "_number"))
    mark = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    numbered = written(
        docs.select("doc_id", mark.alias(digest)).distinct().sort("doc_id", digest).withColumn(number, F.monotonically_increasing_id()),
        "keys",
    ).withColumnRenamed("doc_id", name)
    marked = docs.withColumn(digest, mark)
    found = marked.join(numbered.withColumnRenamed(digest, same), F.col("doc_id").eqNullSafe(F.col(name)) & (F.col(digest) == F.col(same)))
    return found.select(*(col(c) for c in docs.columns), F.col(number).alias(key)), False

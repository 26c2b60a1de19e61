"""Materialised steps of iterative algorithms, in the cluster's shared folder."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from quillon import errors


_kept: list[str] = []


def _delete(jvm, conf, path: str) -> None:
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


@atexit.register
def _delete_all() -> None:
    """Through the JVM, which outlives a stopped session."""
    context = SparkContext._active_spark_context
    jvm = context._jvm if context is not None else (SparkContext._gateway.jvm if SparkContext._gateway else None)
    if jvm is None:
        return
    try:
        conf = context._jsc.hadoopConfiguration() if context is not None else jvm.org.apache.hadoop.conf.Configuration()
        for path in _kept:
            _delete(jvm, conf, path)
    except Exception:  # noqa: BLE001  the JVM may have gone first
        pass


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found and held.isDefined():
        found = held.get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillon-steps-")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def python_path(spark: SparkSession) -> None:
    """Let Python workers import this package from a checkout that isn't on their path."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH") or os.environ.get("PYTHONPATH") or ""
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept as a table: the lineage is cut and lost executors cost no recomputation. Errors of this
    library that a kernel raised come out as themselves."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon-steps/{uuid.uuid4().hex}"
    _kept.append(path)
    try:
        df.write.parquet(path)
    except PySparkException as e:
        for line in reversed(str(e).splitlines()):
            if m := re.match(r"\s*quillon\.errors\.(\w+): (.*)", line):
                raise getattr(errors, m[1])(m[2]) from None
        raise
    return spark.read.schema(df.schema).parquet(path)


class Steps:
    """Tables of an iteration: keeps the last `depth` and deletes older ones."""

    def __init__(self, spark: SparkSession, depth: int = 2):
        self.spark, self.depth, self.paths = spark, depth, []

    def keep(self, df: DataFrame, files: int | None = None) -> DataFrame:
        path = f"{shared_dir(self.spark)}/quillon-steps/{uuid.uuid4().hex}"
        (df.coalesce(files) if files else df).write.parquet(path)
        self.paths.append(path)
        _kept.append(path)
        while len(self.paths) > self.depth:
            _kept.remove(self.paths[0])
            _delete(self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration(), self.paths.pop(0))
        return self.spark.read.schema(df.schema).parquet(path)

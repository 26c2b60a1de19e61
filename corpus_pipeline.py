"""A corpus pipeline: quality rules, toxicity, near-duplicates, repeated substrings, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of documents. Stages work on
all that their predecessor kept. Work tables of a stage go when the next begins, since its input has been written by then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import minhash, packing, quality, suffix, toxicity
from quillon.llm.common import drop_tables, python_path, table, tune, work_path, work_tables

_before: list[str] = []


def _stage(f: Callable) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        python_path(tune(spark))
        drop_tables(spark, [p for p in _before if p in work_tables()])
        _before.clear()
        known = set(work_tables())
        out = f(spark, docs, sf_dir)
        _before.extend(p for p in work_tables() if p not in known)
        return out

    run.__doc__ = f.__doc__
    return run


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the distances from their language's histograms reject go."""
    return quality.filtered(docs)


@_stage
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among those kept so far, calls toxic go."""
    opts = toxicity.Options()
    return toxicity.filtered(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), opts), opts.threshold)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays, that with the smallest doc_id."""
    return minhash.deduplicated(docs)


@_stage
def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 100 bytes that occur earlier go from the texts."""
    return suffix.deduplicated(docs)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens along the space-filling curve."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality_rules), ("toxicity", toxic), ("near-duplicates", near_duplicates), ("substrings", repeated_substrings), ("packing", pack)]

#: A classifier is fitted and token ids are made on the way.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = work_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, chat, fingerprint, minhash, packing, quality, suffix, toxicity, urlfilter, warc
from quillon.llm.common import python_path

_QUERIES = [
    warc.op1_warc,
    chat.op2_chat_formatting,
    toxicity.op3_toxicity,
    suffix.op4_suffix_array,
    urlfilter.op5_url_filters,
    fingerprint.op6_document_fingerprints,
    quality.op7_quality_rules,
    packing.op8_packing,
    bpe.op9_bpe_encode_decode,
    minhash.op10_minhash,
]


def _ready(f: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        python_path(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _ready(f) for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.OP1_SQL, "op2_chat_formatting": chat.OP2_SQL, "op5_url_filters": urlfilter.OP5_SQL, "op10_minhash": minhash.OP10_SQL}

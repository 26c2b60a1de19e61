"""Document fingerprints: a canonical exact digest.

A text is canonical after NFKC, case folding and folding each run of white space to one space (none at the ends). Its
fingerprint is the 128-bit xxh3 of the canonical UTF-8 bytes. Documents whose fingerprints are equal are compared byte by
byte with their group's first document; one that differs (a hash collision) gets its fingerprint lengthened by the SHA-256
of its bytes, so equal fingerprints mean equal canonical texts. Likeness is 1 for equal canonical bytes, else 0.

The edited text needs each document's successor. Texts are shuffled once, compressed: dealt to ranges of doc_id, whose first
document goes to the range before it as well. Of the members of equal-fingerprint groups the canonical bytes, compressed,
are carried on and joined with copies of the group's first, one for each GROUP members, so that a huge group is dealt to
many tasks. Where the ranges begin, one number a range, is all that goes to the driver, and is broadcast.

Defined results: a null text is empty; the fingerprint of an empty text is that of no bytes; null doc_ids come first, equal
doc_ids are ordered by a hash of the text; the last document's successor is the first, which may be itself; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import Out, rows, shuffle_partitions, table, written


#: Characters of text in a range of doc_ids, at least where there are more of them than Spark's shuffle partitions take.
RANGE_CHARS = 1 << 25
#: Members of a group that are compared with one copy of its first document.
GROUP = 512


def canonical(text: str | None) -> bytes:
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def fingerprint(text: str | None) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text))


def fingerprints(docs: DataFrame, digest: Callable[[bytes], str] = xxhash.xxh3_128_hexdigest) -> DataFrame:
    """doc_id, the fingerprint before any comparison of bytes, and the text's length in characters."""
    schema = pa.schema([pa.field("doc_id", pa.int64()), pa.field("fingerprint", pa.string()), pa.field("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(schema)
        for doc_id, text in rows(batches):
            if out.add(doc_id, digest(canonical(text)), len(text or "")):
                yield from out.flush()
        yield from out.flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string, size long")


def edit(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _splitters(ids: DataFrame, n: int) -> np.ndarray:
    """Existing doc_ids that begin ranges of about equal numbers of rows: the first of each range of a range partitioning, of
    which one number a range goes to the driver."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = min((pc.min(b.column(0)).as_py() for b in batches if b.num_rows), default=None)
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array([low], pa.int64())], names=["doc_id"])

    found = ids.filter("doc_id is not null").select("doc_id").repartitionByRange(n, "doc_id").mapInArrow(first, "doc_id long").toArrow()["doc_id"]
    return np.unique(np.array(found.to_pylist(), dtype=np.int64))[1:]


def _blocks(doc_ids: pa.Array, at: np.ndarray) -> np.ndarray:
    """The range of each doc_id; null ones belong to the first."""
    known = doc_ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
    return np.searchsorted(at, known, side="right")


_DEALT = pa.schema([("block", pa.int32()), ("ahead", pa.bool_()), ("doc_id", pa.int64()), ("kind", pa.int32()), ("tie", pa.int64()), ("packed", pa.binary())])
_DEALT_DDL = "block int, ahead boolean, doc_id long, kind int, tie long, packed binary"


def _texts(docs: DataFrame, at, low: int | None, nulls: bool) -> DataFrame:
    """Each text, compressed (to less than Spark's own codec leaves of it), in its range; the first of a range also as a look
    ahead in the range before it, the first of all in the last. tie orders rows with one doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, out, last = zstandard.ZstdCompressor(level=3), Out(_DEALT), len(at.value)
        begins = set(at.value.tolist())
        for b in batches:
            blocks = _blocks(b.column(0), at.value).tolist()
            for block, (doc_id, tie, text) in zip(blocks, rows(iter([b])), strict=True):
                packed = press.compress((text or "").encode("utf-8", "surrogatepass"))
                due = out.add(block, False, doc_id, 1, tie, packed)
                if doc_id is None if nulls else doc_id == low:
                    due = out.add(last, True, doc_id, 1, tie, packed)
                elif doc_id in begins:
                    due = out.add(block - 1, True, doc_id, 1, tie, packed)
                if due:
                    yield from out.flush()
        yield from out.flush()

    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), "text").mapInArrow(run, _DEALT_DDL)


def _marks(found: DataFrame, at) -> DataFrame:
    """doc_ids of members of a group, with the group's size as tie, in their ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(_blocks(b.column(0), at.value), pa.int32()), pa.array([False] * n), b.column(0), pa.array([0] * n, pa.int32()), b.column(1), pa.nulls(n, pa.binary())], schema=_DEALT)

    return found.select("doc_id", "n").mapInArrow(run, _DEALT_DDL)


def _members(shared: DataFrame) -> DataFrame:
    """doc_id and n of the rows whose fingerprint n > 1 rows have. Fingerprints of more than a thousandth of all rows (at
    most 1,000 of them) are broadcast, so that no task gets one of them whole."""
    groups = written(shared.groupBy("fingerprint").agg(F.sum("count").alias("n")).filter("n > 1"), "groups")
    limit = max(1000, (shared.agg(F.sum("count")).first()[0] or 0) // 1000)
    hot, cold = F.broadcast(groups.filter(F.col("n") > limit)), groups.filter(F.col("n") <= limit)
    rest = shared.join(hot, "fingerprint", "left_anti").join(cold, "fingerprint")
    return shared.join(hot, "fingerprint").select("doc_id", "n").unionByName(rest.select("doc_id", "n"))


def compared(docs: DataFrame, digest: Callable[[bytes], str] = xxhash.xxh3_128_hexdigest) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. An edited text's
    fingerprint, which nothing is grouped by, is never lengthened."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = written(fingerprints(docs, digest).groupBy("fingerprint", "doc_id").agg(F.count("*").alias("count"), F.sum("size").alias("size")), "fingerprints")
    ends = shared.agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("null"), F.sum("size").alias("size")).first()
    splitters = _splitters(shared, max(2 * shuffle_partitions(spark), (ends["size"] or 0) // RANGE_CHARS))
    at = spark.sparkContext.broadcast(splitters)
    sent = _texts(docs, at, ends["low"], bool(ends["null"])).unionByName(_marks(_members(shared), at))
    dealt = sent.repartitionById(len(splitters) + 1, "block").sortWithinPartitions("block", "ahead", F.col("doc_id").asc_nulls_first(), "kind", "tie").select("block", "ahead", "doc_id", "kind", "tie", "packed")
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("canonical", pa.binary()), ("n", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, press = Out(schema), zstandard.ZstdCompressor(level=3)
        expand = zstandard.ZstdDecompressor()
        held, marked = None, (object(), 0)
        for blk, is_ahead, doc_id, kind, tie, packed in rows(batches):
            if kind == 0:
                marked = doc_id, tie
                continue
            if held is None and is_ahead:
                continue  # a later look ahead of the same range
            text = expand.decompress(packed).decode("utf-8", "surrogatepass")
            own_bytes = canonical(text)
            if held is not None:
                _, old_id, old, old_bytes, old_marked = held
                changed = edit(old, text)
                edited_bytes = canonical(changed)
                if out.add(
                    old_id, len(old), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), digest(old_bytes), digest(edited_bytes),
                    float(old_bytes == edited_bytes), float(old_bytes == own_bytes), press.compress(old_bytes) if old_marked else None, old_marked,
                ):
                    yield from out.flush()
            held = None if is_ahead else (blk, doc_id, text, own_bytes, marked[1] if doc_id == marked[0] else None)
        yield from out.flush()

    found = written(dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, canonical binary, n long"), "fingerprints")
    parts = F.ceil(F.col("n") / GROUP).cast("int")
    members = found.filter("canonical is not null").select("doc_id", "fingerprint", "canonical", "n", F.pmod(F.xxhash64("doc_id"), parts).cast("int").alias("part"))
    leaders = members.groupBy("fingerprint").agg(F.min(F.struct("doc_id", "canonical")).alias("leader"), F.max("n").alias("n")).select("fingerprint", "leader", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    # equal bytes compress to equal bytes, and different ones to different ones
    collided = members.join(leaders, ["fingerprint", "part"]).filter(F.col("canonical") != F.col("leader.canonical")).select("doc_id", "fingerprint", F.sha2("canonical", 256).alias("_more")).distinct()
    return found.drop("canonical", "n").join(collided, ["doc_id", "fingerprint"], "left").withColumn("fingerprint", F.concat_ws("-", "fingerprint", "_more")).drop("_more")


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and the smallest doc_id of the same canonical text."""
    found = compared(docs).select("doc_id", "fingerprint")
    first = found.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
    return found.join(first, "fingerprint").select("doc_id", "fingerprint", "first_id")


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents").select("doc_id", "text"))

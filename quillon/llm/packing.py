"""Packing by a space-filling curve.

Each document's token ids are hashed into a vector of counts, its direction is projected to four dimensions, and the
Hilbert index of that point orders the documents: neighbours on the curve have similar texts. Documents are range-sorted by
(Hilbert key, hash of doc_id); equal texts, however many, have equal keys and are spread over ranges by the hash. Each range
is packed along the curve: sequences of exactly `size` tokens are cut from the concatenated documents, and the rest of a
range, less than one sequence, is cut into lengths that are powers of two, so there is no padding at all.

Texts are tokenised once; the ids, compressed, are a table in the shared folder from which the range sort reads.

Defined results: null and empty texts have only the closing id 0; rows repeated in full are packed each on their own; null
doc_ids are kept; extra columns are not read; an empty table gives no pieces. Very long texts are tokenised whole.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.bpe import byte_letters
from quillon.llm.common import Out, rows, shuffle_partitions, table, written

SIZE, DIMS, BITS, BUCKETS = 1024, 4, 15, 1024
#: Ids in a range of the curve, at least where there are more of them than Spark's shuffle partitions take: about 40 MB.
RANGE_IDS = 20_000_000

#: White space as the splitting pattern's \s has it; Python's own class holds four control characters more.
_WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LONG = re.compile(_WHITE + "{1000,}")


class ByteEncoder:
    """Token ids of a byte-level BPE, as little-endian 16-bit or 32-bit integers.

    Strings of special tokens are cut out first. A very long run of white space, which the splitting pattern's engine can't
    match, is cut as the pattern would cut it: all of the run, but for its last character if more text follows, is one piece.
    """

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_letters())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.engine = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.type = "<u2" if max([*ranks.values(), *self.special.values()]) < 1 << 16 else "<u4"
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _section(self, text: str) -> Iterator[np.ndarray]:
        at = 0
        for m in _LONG.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            yield self.engine.encode_to_numpy(text[at : m.start()], disallowed_special=())
            yield np.array(self.engine._encode_single_piece(text[m.start() : end]))
            at = end
        yield self.engine.encode_to_numpy(text[at:], disallowed_special=())

    def encode(self, text: str | None) -> bytes:
        found: list[np.ndarray] = []
        for i, part in enumerate(self.cuts.split(text or "") if self.cuts else [text or ""]):
            if i % 2:
                found.append(np.array([self.special[part]]))
            elif part:
                found.extend(self._section(part))
        return b"".join(x.astype(self.type).tobytes() for x in found)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


_PROJECTION = np.random.default_rng(20240607).standard_normal((BUCKETS, DIMS))


def point(ids: np.ndarray) -> np.ndarray:
    """The document's place in the unit cube, in steps of 2**-BITS."""
    spread = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(22)
    v = np.sqrt(np.bincount(spread, minlength=BUCKETS))
    y = v @ _PROJECTION / max(1e-12, float(np.linalg.norm(v)))
    unit = 1 / (1 + np.exp(-1.702 * np.clip(y, -20, 20)))  # near the normal distribution function
    return np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert indices of points (n by dims, integers below 2**bits), by Skilling's transform over all points at once."""
    x = points.T.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[-1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b) & 1
    return key


def tokenised(docs: DataFrame, path: str, closing: int = 0) -> DataFrame:
    """doc_id, key (Hilbert), n_ids and ids (compressed) of every document, the closing id included."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, press = encoder(path), zstandard.ZstdCompressor(level=1)
        end = np.array([closing], dtype=coder.type).tobytes()
        names, raws, places = [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if names:
                keys = hilbert(np.array(places))
                width = np.dtype(coder.type).itemsize
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(keys, pa.int64()), pa.array([len(r) // width for r in raws], pa.int64()), pa.array([press.compress(r) for r in raws], pa.binary())], schema=schema)

        held = 0
        for doc_id, text in rows(batches):
            raw = coder.encode(text) + end
            names.append(doc_id)
            raws.append(raw)
            places.append(point(np.frombuffer(raw, dtype=coder.type)))
            held += len(raw)
            if len(names) >= 1024 or held >= 8 << 20:
                yield from flush()
                names, raws, places, held = [], [], [], 0
        yield from flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, key long, n_ids long, ids binary")


class Packer:
    """Cuts a stream of documents into sequences; gives (doc_id, start, length, crc32, doc_tokens, sequence, offset)."""

    def __init__(self, size: int, first: int):
        self.size, self.sequence = size, first
        self.held: list[tuple] = []  # of the sequence being filled: doc_id, start, ids, doc_tokens
        self.fill = 0

    def _sequence(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, total in pieces:
            yield doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.sequence, offset
            offset += len(ids)
        self.sequence += 1

    def add(self, doc_id: object, ids: np.ndarray) -> Iterator[tuple]:
        at = 0
        while at < len(ids):
            n = min(self.size - self.fill, len(ids) - at)
            self.held.append((doc_id, at, ids[at : at + n], len(ids)))
            at += n
            self.fill += n
            if self.fill == self.size:
                yield from self._sequence(self.held)
                self.held, self.fill = [], 0

    def close(self) -> Iterator[tuple]:
        """The rest, in sequences whose lengths are powers of two."""
        while self.fill:
            want = 1 << (self.fill.bit_length() - 1)
            self.fill -= want
            own = []
            while want:
                doc_id, start, ids, total = self.held.pop(0)
                own.append((doc_id, start, ids[:want], total))
                if len(ids) > want:
                    self.held.insert(0, (doc_id, start + want, ids[want:], total))
                want -= min(want, len(ids))
            yield from self._sequence(own)


def packed(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    coded = written(tokenised(docs, path), "tokens")
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, expand, out = encoder(path).type, zstandard.ZstdDecompressor(), Out(schema, rows=8192)
        packer = Packer(size, TaskContext.get().partitionId() << 40)
        for doc_id, raw in rows(batches):
            for piece in packer.add(doc_id, np.frombuffer(expand.decompress(raw), dtype=kind)):
                if out.add(*piece):
                    yield from out.flush()
        for piece in packer.close():
            if out.add(*piece):
                yield from out.flush()
        yield from out.flush()

    total = coded.agg(F.sum("n_ids")).first()[0] or 0
    ranges = max(shuffle_partitions(spark), total // RANGE_IDS)
    order = coded.withColumn("salt", F.xxhash64("doc_id")).repartitionByRange(ranges, "key", "salt").sortWithinPartitions("key", "salt", "doc_id", "ids")
    return order.select("doc_id", "ids").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

1. A pass over the texts makes each document's set of word shingles (64-bit hashes), its size, a 128-bit digest of the set
   and a one-permutation signature: one hash orders all shingles, its high bits choose a bin, a bin keeps its smallest. An
   empty bin takes the value of the first non-empty one in a random order of its own (optimal densification).
2. Documents with equal sets are one class, of which the first stands for all.
3. Bands of the signature are bucket keys. Each bucket has one centre, the member that lies in the most populous buckets
   overall, and candidate pairs are the edges of the star around it: as many as members, not pairs of members.
4. Candidates are confirmed on full shingle sets, members streaming past their centre; a centre with many members is salted.
5. A star can miss a link between two members of a bucket of which one isn't linked to the centre. In buckets whose members
   are still in different components, once per distinct membership, all members outside the bucket's largest component are
   therefore compared with all members, skipping pairs already connected: the exact way for what the stars leave. A bucket of
   more than BLOCK members is dealt in pairs of blocks, so that no task holds more than two blocks of it.
6. Components by label propagation with pointer jumping.

With r = 5 rows and b = 40 bands, a pair at the threshold 0.85 shares no bucket with probability 7e-11, at 0.8 1e-7.

Defined results: null or empty texts, or texts without words, have the empty set and are linked with nothing; texts of
fewer words than a shingle are one shingle; rows repeated in full are linked; rows with null or repeated doc_ids are told
apart by their text (common.with_key), and a null doc_id is smaller than any other; extra columns, whatever their names,
pass through deduplicated() and aren't read otherwise; very long texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import Out, col, free, rows, shared_dir, shuffle_partitions, table, with_key, written

CACHE_WORDS = 150_000
#: Members that stream past one copy of a centre.
STAR = 512
#: Members of an open bucket that are compared in one group.
BLOCK = 256


@dataclass(frozen=True)
class Options:
    words: int = 5
    percent: int = 80
    rows: int = 5
    bands: int = 40


_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of texts; keeps the hashes of words it has met."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        found = (text or "").encode("utf-8", "surrogatepass").lower().split()
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        hashes = [known.get(w) for w in found]
        if None in hashes:
            for i, w in enumerate(found):
                if hashes[i] is None:
                    h = known.get(w)
                    if h is None:
                        h = known[w] = xxhash.xxh3_64_intdigest(w)
                    hashes[i] = h
        h = np.array(hashes, dtype=np.uint64)
        if not len(h):
            return h
        n = min(self.words, len(h))
        x = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            x = (x * _MUL) ^ h[i : len(h) - n + 1 + i]
            x = _mix(x + np.uint64(1))
        return np.unique(x)


class Signer:
    """Band keys of shingle sets."""

    def __init__(self, opts: Options):
        self.rows, self.bands = opts.rows, opts.bands
        self.bins = opts.rows * opts.bands
        rng = np.random.default_rng(7)
        self.probes = np.stack([rng.permutation(self.bins) for _ in range(self.bins)], axis=1)  # column j: where bin j looks
        self.salt = _mix(np.arange(1, opts.bands + 1, dtype=np.uint64) * _MUL)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        at = ((shingles >> np.uint64(32)) * np.uint64(self.bins)) >> np.uint64(32)  # rises with the hash
        first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        out, filled = np.zeros(self.bins, dtype=np.uint64), np.zeros(self.bins, dtype=bool)
        where = at[first].astype(np.int64)
        out[where], filled[where] = shingles[first], True
        empty = np.flatnonzero(~filled)
        if len(empty):
            probes = self.probes[:, empty]
            out[empty] = out[probes[np.argmax(filled[probes], axis=0), np.arange(len(empty))]]
        return out

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        s = self.signature(shingles).reshape(self.bands, self.rows)
        x = self.salt.copy()
        for i in range(self.rows):
            x = _mix((x * _MUL) ^ s[:, i])
        return x.view(np.int64)


def signed(docs: DataFrame, opts: Options) -> DataFrame:
    """_key, n_shingles, digest (null for empty sets) and bands."""
    schema = pa.schema([("_key", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer, out = Shingler(opts.words), Signer(opts), Out(schema)
        for key, text in rows(batches):
            s = shingler(text)
            due = out.add(key, len(s), xxhash.xxh3_128_digest(s.tobytes()), signer.keys(s)) if len(s) else out.add(key, 0, None, None)
            if due:
                yield from out.flush()
        yield from out.flush()

    return docs.select("_key", "text").mapInArrow(run, "_key long, n_shingles long, digest binary, bands array<long>")


def similar(a: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which others have 100 * intersection >= percent * union with a."""
    sizes = np.array([len(o) for o in others], dtype=np.int64)
    flat = np.concatenate(others)
    spot = np.minimum(np.searchsorted(a, flat), len(a) - 1)
    common = np.add.reduceat((a[spot] == flat).astype(np.int64), np.concatenate(([0], np.cumsum(sizes)[:-1])))
    return 100 * common >= percent * (len(a) + sizes - common)


def _stars(buckets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows of shared buckets, and (centre, member): the star of every bucket, each edge once; edges whose sets' sizes alone
    are too different to be similar are left out."""
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    shared = written(buckets.join(sizes, "bucket"), "buckets")
    weight = shared.groupBy("rep").agg(F.sum("n").alias("weight"))
    centres = shared.join(weight, "rep").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("rep")).alias("rep"), "size")).alias("c")).select("bucket", (-F.col("c.rep")).alias("centre"), F.col("c.size").alias("centre_size"))
    near = 100 * F.least("size", "centre_size") >= percent * F.greatest("size", "centre_size")
    return shared, shared.join(centres, "bucket").filter((F.col("rep") != F.col("centre")) & near).select("centre", F.col("rep").alias("member")).distinct()


def _confirmed(edges: DataFrame, docs: DataFrame, opts: Options) -> DataFrame:
    """The edges whose full sets are similar, as (a, b)."""
    spark = edges.sparkSession
    edges = written(edges, "edges")
    parts = edges.groupBy("centre").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    member = edges.join(parts, "centre").select(F.col("member").alias("_key"), "centre", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"))
    centre = parts.select(F.col("centre").alias("_key"), "centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    sent = docs.select("_key", "text").join(member.unionByName(centre).hint("shuffle_hash"), "_key")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, out = Shingler(opts.words), Out(schema)
        at, middle = None, None
        held: list[tuple[int, np.ndarray]] = []

        def test() -> Iterator[pa.RecordBatch]:
            if held:
                for (key, _), ok in zip(held, similar(middle, [s for _, s in held], opts.percent), strict=True):
                    if ok and out.add(at[0], key):
                        yield from out.flush()
                held.clear()

        for centre, part, role, key, text in rows(batches):
            if (centre, part) != at:
                yield from test()
                at, middle = (centre, part), None
            if role == 0:
                middle = shingler(text)
            elif middle is not None and len(s := shingler(text)):
                held.append((key, s))
                if len(held) >= 64:
                    yield from test()
        yield from test()
        yield from out.flush()

    dealt = sent.repartition(shuffle_partitions(spark), "centre", "part").sortWithinPartitions("centre", "part", "role", "_key").select("centre", "part", "role", "_key", "text")
    return written(dealt.mapInArrow(run, "a long, b long").distinct(), "links")


def _rest(shared: DataFrame, labels: DataFrame, docs: DataFrame, opts: Options) -> DataFrame | None:
    """Links inside buckets whose members are in different components, each distinct membership once."""
    spark = shared.sparkSession
    named = shared.select("bucket", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    parts = named.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("mark"))
    open_ = (
        parts.groupBy("bucket")
        .agg(F.count("*").alias("labels"), F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("main"), F.sum("mark").alias("mark"))
        .filter("labels > 1")
        .groupBy("n", "mark")
        .agg(F.min(F.struct("bucket", "main")).alias("b"))
        .select("b.bucket", "n", F.col("b.main.n").alias("n_main"), F.col("b.main.label").alias("main"))
    )
    left = written(named.join(open_, "bucket").select("bucket", "rep", "label", F.explode(_slots()).alias("s")).select("bucket", "rep", "label", "s.*"), "rest")
    if not left.take(1):
        return None
    sent = docs.select("_key", "text").join(left.withColumnRenamed("rep", "_key").hint("shuffle_hash"), "_key")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, out = Shingler(opts.words), Out(schema)
        at: object = None
        keys: list[int] = []
        labels: list[int] = []
        sides: list[int] = []
        sets: list[np.ndarray] = []

        def compare(cross: bool) -> Iterator[pa.RecordBatch]:
            label, side, sizes = np.array(labels), np.array(sides), np.array([len(s) for s in sets])
            for i in range(len(keys) - 1):
                apart = (label[i + 1 :] != label[i]) & (100 * np.minimum(sizes[i + 1 :], sizes[i]) >= opts.percent * np.maximum(sizes[i + 1 :], sizes[i]))
                other = i + 1 + np.flatnonzero(apart & (side[i + 1 :] != side[i]) if cross else apart)
                for lo in range(0, len(other), 256):
                    some = other[lo : lo + 256]
                    for j in some[similar(sets[i], [sets[j] for j in some], opts.percent)]:
                        label[label == label[j]] = label[i]
                        if out.add(keys[i], keys[j]):
                            yield from out.flush()

        for bucket, i, j, kind, side, key, label, text in rows(batches):
            if (bucket, i, j, kind) != at:
                if keys:
                    yield from compare(at[3] == 1 or (at[3] == 0 and at[1] != at[2]))
                at, keys, labels, sides, sets = (bucket, i, j, kind), [], [], [], []
            if not keys or keys[-1] != key:
                keys.append(key)
                labels.append(label)
                sides.append(side)
                sets.append(shingler(text))
        if keys:
            yield from compare(at[3] == 1 or (at[3] == 0 and at[1] != at[2]))
        yield from out.flush()

    group = ("bucket", "i", "j", "kind")
    dealt = sent.repartition(shuffle_partitions(spark), *group).sortWithinPartitions(*group, "_key").select(*group, "side", "_key", "label", "text")
    return written(dealt.mapInArrow(run, "a long, b long").distinct(), "links")


def _slots():
    """The groups (i, j, kind) that a member of an open bucket goes to, and its side there. kind 2: the whole bucket; 0: blocks
    i <= j of the members outside the main component; 1: block i of those against block j of the main component. Groups
    of two blocks compare members of different sides."""
    minor, p, q = F.col("label") != F.col("main"), F.ceil((F.col("n") - F.col("n_main")) / BLOCK).cast("int"), F.ceil(F.col("n_main") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.when(minor, p).otherwise(q)).cast("int")

    def slot(i, j, kind: int, side):
        return F.struct(i.alias("i"), j.alias("j"), F.lit(kind).alias("kind"), side.alias("side"))

    zero, one = F.lit(0), F.lit(1)
    inside = F.transform(F.sequence(zero, p - 1), lambda x: slot(F.least(x, own), F.greatest(x, own), 0, F.when(x < own, one).otherwise(zero)))
    across = F.transform(F.sequence(zero, q - 1), lambda x: slot(own, x, 1, zero))
    main = F.transform(F.sequence(zero, p - 1), lambda x: slot(x, own, 1, one))
    return F.when(F.col("n") <= BLOCK, F.array(slot(zero, zero, 2, zero))).when(minor, F.concat(inside, across)).otherwise(main)


def components(links: DataFrame) -> DataFrame:
    """node and label, the smallest node it is connected with, for every node that has a link (a, b)."""
    edges = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "edges")
    labels = written(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")).withColumnRenamed("u", "node"), "labels")
    while True:
        near = edges.join(labels, edges["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["u"]).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("at"), F.col("label").alias("above"))
        new = written(lower.join(up, lower["label"] == up["at"], "left").select("node", "was", F.least("label", F.coalesce("above", "label")).alias("label")), "labels")
        if not new.filter("label <> was").take(1):
            return new.select("node", "label")
        labels = new.select("node", "label")


def classified(docs: DataFrame, opts: Options = Options()) -> DataFrame:
    """_key, n_shingles and component (the smallest _key reachable) of every row of docs, which has _key and text."""
    shared_dir(docs.sparkSession)
    marks = written(signed(docs, opts), "signatures")
    reps = marks.filter("digest is not null").groupBy("digest").agg(F.min("_key").alias("rep"), F.count("*").alias("n"))
    bands = marks.select(F.col("_key").alias("rep"), "bands", F.col("n_shingles").alias("size")).join(reps.select("rep"), "rep", "left_semi").dropDuplicates(["rep"])
    shared, edges = _stars(bands.select("rep", "size", F.explode("bands").alias("bucket")), opts.percent)
    links = _confirmed(edges, docs, opts)
    labels = components(links)
    more = _rest(shared, labels, docs, opts)
    if more is not None and more.take(1):
        labels = components(links.unionByName(more))
    named = written(reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "n", F.coalesce("label", "rep").alias("component")), "classes")
    # sets that more than a thousandth of all rows have, at most 1,000 of them, are broadcast: no task gets all their rows
    limit = max(1000, (named.agg(F.sum("n")).first()[0] or 0) // 1000)
    hot, own = F.broadcast(named.filter(F.col("n") > limit).drop("n")), marks.filter("digest is not null").select("_key", "n_shingles", "digest")
    cold = own.join(hot, "digest", "left_anti").join(named.filter(F.col("n") <= limit).drop("n"), "digest")
    full = own.join(hot, "digest").unionByName(cold).select("_key", "n_shingles", "component")
    return full.unionByName(marks.filter("digest is null").select("_key", "n_shingles", F.col("_key").alias("component")))


def deduplicated(docs: DataFrame, opts: Options = Options()) -> DataFrame:
    """docs with one row of each component: the one with the smallest key; of rows repeated in full, one."""
    key = free("_key", docs)
    given = with_key(docs, key=key)
    found = classified(given.select(F.col(key).alias("_key"), "text"), opts)
    kept = found.filter("_key = component").select(F.col("_key").alias(key)).distinct().hint("shuffle_hash")
    names = [col(c) for c in docs.columns]
    if given.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").limit(1).take(1):
        return given.join(kept, key).dropDuplicates([key]).select(*names)
    return given.join(kept, key, "left_semi").select(*names)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_key(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = classified(docs, Options(words=3, percent=85))
    names = docs.select("_key", "doc_id").distinct()
    plain = docs.schema["doc_id"].dataType.simpleString() == "bigint" and not _numbered(docs)
    if plain:
        return found.select(F.col("_key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("_key") == F.col("component")).alias("kept"))
    own = found.join(names, "_key")
    first = names.select(F.col("_key").alias("component"), F.col("doc_id").alias("component_id"))
    return own.join(first, "component").select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _numbered(keyed: DataFrame) -> bool:
    """Whether with_key() had to number the rows."""
    return bool(keyed.filter(~F.col("_key").eqNullSafe(F.col("doc_id"))).limit(1).take(1))


OP10_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                                 ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w
), n AS (
  SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), e AS (
  SELECT a, b FROM l UNION SELECT b, a FROM l
), reach AS (
  SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON reach.r = e.a
), c AS (
  SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id
)
SELECT n.doc_id, n.n AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN c ON n.doc_id = c.doc_id
"""

"""Removal of repeated substrings by a common-prefix-aware distributed merge sort of suffixes.

Every string S of `length` bytes is represented by its anchor, the leftmost smallest hash among its k-grams (k = 32), so equal
strings have their anchors at equal offsets, and a text has an anchor about every 35 bytes. Only suffixes at anchors take
part, and of these only such that may repeat:

1. Fingerprint exchange. Tasks sort their anchors' k-gram hashes and exchange them, front-coded by range and one a task for
   repeated ones; anchors whose k-gram is nowhere else drop out.
2. Sorted runs. The remaining suffixes (from the anchor to the end of the last string it represents, with the bytes before it
   back to the first) are sorted in each task, suffixes equal to an earlier one of the task are settled there, and the
   others are exchanged in ranges of the k-gram's hash as front-coded runs: common prefix length with the suffix before, and
   the rest.
3. Merge. A loser tree over the runs compares by the common prefix lengths it knows and reads characters only behind them.
   Neighbours that share the anchor's k-gram form a group, in which every string but its first occurrence is repeated.
4. The intervals of repeated strings are joined with the texts, whose covered bytes are removed.

k-grams that occur more than max(HOT, anchors / 4,000,000) times could make a group too large for one task: they are at
most 4,000,000, their list is broadcast, and each of their strings is a suffix of its own, dealt by its own hash and
settled to one a task beforehand.

Defined results: a null text is empty; texts shorter than `length` keep all bytes; strings never span documents; rows with
null or repeated doc_ids are ordered by common.with_key(), rows repeated in full are one document; very long texts are read
in overlapping parts; extra columns, whatever their names, pass through deduplicated(); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import Out, col, free, keyed, mapped, rows, shuffle_partitions, table, with_key, written

LENGTH, GRAM = 100, 32
HOT = 4096
MAX_HOT = 4_000_000
#: Bytes of text a part, where there are more of them than Spark's shuffle partitions take.
PART_BYTES = 1 << 26
#: Bytes hashed at a time, anchors a task sorts at once, suffixes in a run.
PART, ANCHORS, RUN = 1 << 19, 400_000, 60_000


def _hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each place."""
    n = len(data) - 7
    words = np.empty(n, dtype=np.uint64)
    for r in range(8):
        m = (len(data) - r) // 8
        part = data[r : r + 8 * m].view("<u8")
        words[r::8] = part[: len(words[r::8])]
    m = len(data) - GRAM + 1
    h = words[:m] * np.uint64(0x9E3779B97F4A7C15)
    for i, c in enumerate((0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93), 1):
        h ^= h >> np.uint64(29)
        h += words[8 * i : 8 * i + m] * np.uint64(c)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _spread(h: np.ndarray) -> np.ndarray:
    """A bijection of hashes: those of anchors are smallest in their windows, and ranges of them would be very uneven."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _anchors_of(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each start of a string its anchor; and the hashes."""
    h = _hashes(data)
    window = length - GRAM + 1
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    v = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= window:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    if span < window:
        v = np.minimum(v[: len(v) - (window - span)], v[window - span :])
    return (v & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), h


def anchors(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, place, first start, last start, hash) of the anchors of all texts; places are within their text."""
    found: list[tuple[np.ndarray, ...]] = []
    group: list[tuple[int, int, bytes]] = []
    held = 0

    def run() -> None:
        sizes = np.array([len(b) for _, _, b in group])
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join([b for _, _, b in group]), dtype=np.uint8)
        at, h = _anchors_of(data, length)
        start = np.arange(len(at))
        own = np.searchsorted(ends, start, side="right")
        ok = start + length <= ends[own]
        start, own, at = start[ok], own[ok], at[ok]
        first = np.concatenate(([True], (at[1:] != at[:-1]) | (own[1:] != own[:-1])))
        lo = np.flatnonzero(first)
        hi = np.append(lo[1:], len(start)) - 1
        base = (ends - sizes)[own[lo]]
        text = np.array([t for t, _, _ in group])[own[lo]]
        skip = np.array([o for _, o, _ in group])[own[lo]]
        found.append((text, at[lo] - base + skip, start[lo] - base + skip, start[hi] - base + skip, _spread(h[at[lo]])))

    for t, b in enumerate(texts):
        for o in range(0, max(0, len(b) - length + 1), PART):
            part = b[o : o + PART + length - 1]
            group.append((t, o, part))
            held += len(part)
            if held >= PART:
                run()
                group, held = [], 0
    if group:
        run()
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _planes(a: np.ndarray) -> bytes:
    """Byte planes of an array: the high bytes, mostly equal, lie together."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()


def _unplanes(raw: bytes, at: int, n: int, kind: str) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize
    a = np.frombuffer(raw, dtype=np.uint8, count=n * size, offset=at).reshape(size, n)
    return np.ascontiguousarray(a.T).reshape(-1).view(kind), at + n * size


def _pack(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(len(columns[0]).to_bytes(4, "little") + b"".join(map(_planes, columns)))


def _unpack(raw: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n, at, out = int.from_bytes(raw[:4], "little"), 4, []
    for k in kinds:
        a, at = _unplanes(raw, at, n, k)
        out.append(a)
    return out


_SENT = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])


def _fingerprints(docs: DataFrame, buckets: int, length: int) -> DataFrame:
    """(bucket, kind, payload): 0 hashes with key, place and count, one for each hash in the task's batch of anchors; 1 keys
    and places of anchors that repeat inside the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n, turn = 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal turn
            h, key, place = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")
            h, key, place = h[order], key[order], place[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            count = np.diff(np.append(first, len(h)))
            again = np.repeat(count > 1, count)
            out = Out(_SENT)
            if again.any():
                k, p = key[again], place[again]
                for part in np.array_split(np.arange(len(k)), max(1, len(k) // 100_000)):
                    out.add(turn % buckets, 1, _pack(k[part], p[part].astype(np.int32)))
                    turn += 1
            h, key, place, count = h[first], key[first], place[first], count.astype(np.uint32)
            cut = np.searchsorted(_bucket(h, buckets), np.arange(buckets + 1))
            for b in range(buckets):
                lo, hi = cut[b], cut[b + 1]
                if hi > lo and out.add(b, 0, _pack(h[lo:hi], key[lo:hi], place[lo:hi].astype(np.int32), count[lo:hi])):
                    yield from out.flush()
            yield from out.flush()

        for batch in batches:
            keys, texts = batch["_key"].to_numpy(), batch["data"].to_pylist()
            text, place, _, _, h = anchors(texts, length)
            if len(h):
                held.append((h, keys[text], place))
                n += len(h)
            if n >= ANCHORS:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    return docs.mapInArrow(run, "bucket int, kind int, payload binary")


_REPEATED = "_key long, places array<int>, hot long"


def _repeated(sent: DataFrame, buckets: int, hot_from: int) -> DataFrame:
    """Keys and places of the anchors whose k-gram occurs again; and the hashes of those that occur hot_from times."""
    schema = pa.schema([("_key", pa.int64()), ("places", pa.list_(pa.int32())), ("hot", pa.int64())])

    def by_key(key: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(key):
            order = np.argsort(key, kind="stable")
            key, place = key[order], place[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            offsets = pa.array(np.append(first, len(key)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.ListArray.from_arrays(offsets, pa.array(place)), pa.nulls(len(first), pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def settle() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            h, key, place, count = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")
            h, key, place, count = h[order], key[order], place[order], count[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            tasks = np.diff(np.append(first, len(h)))
            total = np.add.reduceat(count.astype(np.int64), first)
            dup = np.repeat(tasks > 1, tasks) & (count == 1)
            yield from by_key(key[dup], place[dup])
            hot = h[first][total >= hot_from].view(np.int64)
            if len(hot):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(hot), pa.int64()), pa.nulls(len(hot), pa.list_(pa.int32())), pa.array(hot)], schema=schema)

        for bucket, kind, payload in rows(batches):
            if kind == 1:
                yield from by_key(*_unpack(payload, "<i8", "<i4"))
                continue
            if bucket != at:
                yield from settle()
                at, held = bucket, []
            held.append(_unpack(payload, "<u8", "<i8", "<i4", "<u4"))
        yield from settle()

    return sent.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(run, _REPEATED)


# sorted runs and their merge


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which `known` is known."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


def front_code(run: list[tuple[bytes, bytes, int, int]]) -> bytes:
    """A sorted run of (key and suffix, bytes before, document, place). The first eight bytes, the key, count as one symbol:
    a common prefix is 0 or at least 8."""
    lcp, last = [], b""
    rest, before = [], []
    for x, left, _, _ in run:
        n = common(last, x, 8) if last[:8] == x[:8] else 0
        lcp.append(n)
        rest.append(x[n:])
        before.append(left)
        last = x
    columns = np.array(lcp, dtype=np.uint16), np.array([len(r) for r in rest], dtype=np.uint16), np.array([len(b) for b in before], dtype=np.uint16), np.array([r[2] for r in run], dtype=np.int64), np.array([r[3] for r in run], dtype=np.int64)
    return zstandard.ZstdCompressor(level=1).compress(len(run).to_bytes(4, "little") + b"".join(map(_planes, columns)) + b"".join(rest) + b"".join(before))


class Run:
    """A front-coded run, decoded as it is read."""

    def __init__(self, raw: bytes):
        raw = zstandard.ZstdDecompressor().decompress(raw)
        self.n = int.from_bytes(raw[:4], "little")
        at = 4
        columns = []
        for kind in ("<u2", "<u2", "<u2", "<i8", "<i8"):
            a, at = _unplanes(raw, at, self.n, kind)
            columns.append(array("H" if kind == "<u2" else "q", a.tobytes()))
        self.lcp, sizes, self.lefts, self.docs, self.places = columns
        self.raw, self.sizes, self.rest, self.before = raw, sizes, at, at + sum(sizes)
        self.i, self.x, self.left = -1, b"", b""

    def step(self) -> bool:
        """To the next suffix; its x, left, doc, place and h (common prefix with the one before it)."""
        self.i += 1
        if self.i >= self.n:
            return False
        i = self.i
        self.h = self.lcp[i]
        size, back = self.sizes[i], self.lefts[i]
        self.x = self.x[: self.h] + self.raw[self.rest : self.rest + size]
        self.left = self.raw[self.before : self.before + back]
        self.rest += size
        self.before += back
        return True


def merged(runs: list[Run]) -> Iterator[tuple[int, bytes, bytes, int, int]]:
    """(common prefix with the suffix before, key and suffix, bytes before, document, place) in order, by a loser tree. A
    stream's h is always its common prefix with the last winner: of two streams the one with the longer is smaller, and only
    at equal lengths are characters compared, from there on."""
    runs = [r for r in runs if r.step()]
    k = len(runs)
    if not k:
        return
    if k == 1:
        r = runs[0]
        while True:
            yield r.h, r.x, r.left, r.docs[r.i], r.places[r.i]
            if not r.step():
                return
    heads: list[bytes | None] = [r.x for r in runs]
    known = [0] * k
    loser = [-1] * k

    def less(a: int, b: int) -> bool:
        """Whether a's head comes first; notes the common prefix at the loser."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return y is None
        h = known[a]
        if h != known[b]:
            return h > known[b]
        if h == 0:
            if x[:8] != y[:8]:
                return x[:8] < y[:8]
            h = 8
        h = common(x, y, h)
        first = a < b if h == len(x) == len(y) else h == len(x) or (h < len(y) and x[h] < y[h])
        known[b if first else a] = h
        return first

    for leaf in range(k):
        node, winner = (leaf + k) // 2, leaf
        while node:
            if loser[node] < 0:
                loser[node] = winner
                winner = -1
                break
            if less(loser[node], winner):
                winner, loser[node] = loser[node], winner
            node //= 2
        if winner >= 0:
            top = winner
    while heads[top] is not None:
        r = runs[top]
        yield known[top], r.x, r.left, r.docs[r.i], r.places[r.i]
        if r.step():
            heads[top], known[top] = r.x, r.h
        else:
            heads[top] = None
        node = (top + k) // 2
        while node:
            other = loser[node]
            if less(other, top):
                loser[node], top = top, other
            node //= 2


def settled(group: list[tuple[bytes, bytes, int, int]], length: int) -> Iterator[tuple[int, int, int]]:
    """(document, first start, last start) of the strings of a group that occur earlier. Members share the anchor's k-gram."""
    x0, l0, _, _ = group[0]
    if all(x == x0 and left == l0 for x, left, _, _ in group):
        low = min((d, p) for _, _, d, p in group)
        n = len(x0) - 8 - length
        for _, left, d, p in group:
            if (d, p) > low:
                yield d, p - len(left), p + n
        return
    seen: dict[bytes, tuple[int, int]] = {}
    for x, left, d, p in sorted(group, key=lambda g: g[2:]):
        text = left + x[8:]
        start, lo = p - len(left), -1
        for i in range(len(text) - length + 1):
            s = text[i : i + length]
            if seen.setdefault(s, (d, start + i)) < (d, start + i):
                if lo < 0:
                    lo = i
            elif lo >= 0:
                yield d, start + lo, start + i - 1
                lo = -1
        if lo >= 0:
            yield d, start + lo, start + len(text) - length


def _runs(docs: DataFrame, hot, buckets: int, length: int) -> DataFrame:
    """(bucket, kind, payload) from rows of _key, data, places: 0 front-coded runs; 1 intervals settled inside the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes, int, int]] = []
        turn = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal turn
            held.sort()
            own: list[tuple[bytes, bytes, int, int]] = []
            done: list[tuple[int, int, int]] = []
            for g in held:
                if own and own[-1][0] == g[0] and own[-1][1] == g[1]:
                    if own[-1][2:] != g[2:]:
                        done.append((g[2], g[3] - len(g[1]), g[3] + len(g[0]) - 8 - length))
                else:
                    own.append(g)
            out = Out(_SENT)
            for lo in range(0, len(done), 100_000):
                part = np.array(done[lo : lo + 100_000], dtype=np.int64)
                out.add(turn % buckets, 1, _pack(*(np.ascontiguousarray(part[:, i]) for i in range(3))))
                turn += 1
            keys = np.array([int.from_bytes(g[0][:8], "big") for g in own], dtype=np.uint64)
            cut = np.searchsorted(_bucket(keys, buckets), np.arange(buckets + 1))
            for b in range(buckets):
                if cut[b + 1] > cut[b] and out.add(b, 0, front_code(own[cut[b] : cut[b + 1]])):
                    yield from out.flush()
            yield from out.flush()

        for batch in batches:
            keys, texts = batch["_key"].to_pylist(), batch["data"].to_pylist()
            places = batch["places"].to_pylist()
            text, place, lo, hi, h = anchors(texts, length)
            wanted = np.array([t << 40 | p for t, ps in enumerate(places) for p in ps], dtype=np.int64)
            some = np.isin(text.astype(np.int64) << 40 | place, wanted)
            text, place, lo, hi, h = text[some], place[some], lo[some], hi[some], h[some]
            is_hot = np.isin(h, hot.value)
            names = h.astype(">u8").tobytes()
            for i, (t, p, a, b, hh) in enumerate(zip(text.tolist(), place.tolist(), lo.tolist(), hi.tolist(), is_hot.tolist(), strict=True)):
                data, key = texts[t], keys[t]
                if hh:
                    for s in range(a, b + 1):
                        x = data[s : s + length]
                        held.append((xxhash.xxh3_64_digest(x) + x, b"", key, s))
                else:
                    held.append((names[8 * i : 8 * i + 8] + data[p : b + length], data[a:p], key, p))
            if len(held) >= RUN:
                yield from flush()
                held.clear()
        if held:
            yield from flush()

    return docs.mapInArrow(run, "bucket int, kind int, payload binary")


def _merged(sent: DataFrame, buckets: int, length: int) -> DataFrame:
    """_key, lo, hi: intervals of starts of repeated strings."""
    schema = pa.schema([("_key", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(schema, rows=16384)
        at, runs = None, []

        def merge() -> Iterator[pa.RecordBatch]:
            group: list[tuple[bytes, bytes, int, int]] = []
            for h, x, left, doc, place in merged(runs):
                if h < 8 + GRAM and group:
                    if len(group) > 1:
                        for found in settled(group, length):
                            if out.add(*found):
                                yield from out.flush()
                    group.clear()
                group.append((x, left, doc, place))
            if len(group) > 1:
                for found in settled(group, length):
                    out.add(*found)
            yield from out.flush()

        for bucket, kind, payload in rows(batches):
            if kind == 1:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, _unpack(payload, "<i8", "<i8", "<i8"))), schema=schema)
                continue
            if bucket != at:
                yield from merge()
                at, runs = bucket, []
            runs.append(Run(payload))
        yield from merge()

    return sent.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(run, "_key long, lo long, hi long")


def parts_of(docs: DataFrame, text: str) -> tuple[int, int]:
    """Bytes of all texts, and the number of parts that they are dealt to: at most about PART_BYTES each."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return total, max(shuffle_partitions(docs.sparkSession), total // PART_BYTES)


def repeated_strings(docs: DataFrame, total: int, parts: int, length: int = LENGTH) -> DataFrame:
    """_key and spans, an array of (lo, hi): starts of the strings that occur earlier. docs: _key (not null) and data."""
    spark = docs.sparkSession
    found = written(_repeated(_fingerprints(docs, parts, length), parts, max(HOT, total // 35 // MAX_HOT)), "anchors")
    names = found.filter("hot is not null").select("hot").distinct().toArrow()["hot"].combine_chunks()
    hot = spark.sparkContext.broadcast(np.sort(names.to_numpy(zero_copy_only=False).astype(np.int64)).view(np.uint64))
    places = found.filter("_key is not null").groupBy("_key").agg(F.flatten(F.collect_list("places")).alias("places"))
    runs = _runs(docs.repartition(parts, "_key").join(places.hint("shuffle_hash"), "_key"), hot, parts, length)
    return _merged(runs, parts, length).groupBy("_key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def kept_bytes(data: bytes, spans: list[tuple[int, int]], length: int = LENGTH) -> tuple[bytes, int, int]:
    """The bytes that no span's strings cover; how many are removed, in how many runs."""
    out, at, runs = [], 0, 0
    end = -1
    for lo, hi in sorted(spans):
        if lo > end:
            runs += 1
            out.append(data[max(at, 0) : lo])
        end = max(end, hi + length)
        at = end
    out.append(data[at:])
    kept = b"".join(out)
    return kept, len(data) - len(kept), runs


def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256. Both joins with the texts take the same columns by the same key, so
    their one exchange is written once; the filter, which drops nothing, makes their inputs equal plans."""
    given, plain = keyed(docs.select("doc_id", "text"))
    total, parts = parts_of(docs, "text")
    texts = given.filter("_key is not null").select("_key", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    spans = repeated_strings(texts, total, parts, length)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(schema)
        for doc_id, data, found in rows(batches):
            kept, n, k = kept_bytes(data, [(s["lo"], s["hi"]) for s in found or []], length)
            if out.add(doc_id, len(data), n, k, hashlib.sha256(kept).hexdigest()):
                yield from out.flush()
        yield from out.flush()

    joined = texts.repartition(parts, "_key").join(spans.hint("shuffle_hash"), "_key", "left").select("_key", "data", "spans")
    found = joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    if plain:
        return found
    names = given.select("_key", F.col("doc_id").cast("long").alias("_id")).distinct()
    return found.join(names, found["doc_id"] == names["_key"]).select(F.col("_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the repeated bytes of text removed (a character of which some bytes are removed goes whole), n_chars, where
    it is a column, of what is left."""
    key, found = free("_key", docs), free("_spans", docs)
    total, parts = parts_of(docs, "text")
    given = with_key(docs, key=key).filter(F.col(key).isNotNull())
    spans = repeated_strings(given.select(F.col(key).alias("_key"), F.coalesce("text", F.lit("")).cast("binary").alias("data")), total, parts, length)
    names = docs.columns
    text, n_chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t, found in zip(b.column(text).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                if t is not None and found:
                    t = kept_bytes(t.encode("utf-8", "surrogatepass"), [(s["lo"], s["hi"]) for s in found], length)[0].decode("utf-8", "ignore")
                texts.append(t)
            columns = [b.column(i) for i in range(len(names))]
            columns[text] = pa.array(texts, columns[text].type)
            if n_chars is not None:
                columns[n_chars] = pa.array([None if t is None else len(t) for t in texts], columns[n_chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[: len(names)])

    joined = given.repartition(parts, key).join(spans.select(F.col("_key").alias(key), F.col("spans").alias(found)).hint("shuffle_hash"), key, "left")
    return mapped(joined.select(*(col(c) for c in names), found), run, len(names))


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"))

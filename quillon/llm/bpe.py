"""BPE encoding and decoding with an index of pair occurrences.

The distinct words of a chunk of texts are laid out as one array of symbols linked to their neighbours. Every pair that the
vocabulary can merge has the list of all its positions. Active ranks are taken in ascending order; a rank merges all its
positions, left to right, and the two pairs beside each merge leave their old lists (their symbols no longer match) and
enter the lists of the new symbols. A merge can only make pairs of higher ranks, since a merged symbol is made by one rank
alone, so one ascending sweep over the whole chunk does for each word what merging its lowest rank again and again does.

Defined results: null and empty texts have no ids and decode to an empty text; extra columns pass through; very long texts
are split at white space, where nothing is ever merged or normalised across; strings of special tokens in a text are those
tokens.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import Out, rows, table

#: Words whose ids a worker keeps, twice: those met since the last turn of generations, and those before. Texts encoded together, in characters.
CACHE_WORDS, CHUNK_CHARS = 300_000, 6_000_000
_WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.of_rank: dict[int, tuple[int, int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for k, (a, b) in enumerate(merges):
            if self.rank.setdefault((self.ids[a], self.ids[b]), k) == k:
                self.of_rank[k] = self.ids[a], self.ids[b], self.ids[a + b]
        pairs = sorted((a << 32 | b, k) for (a, b), k in self.rank.items())
        self.pair_keys, self.pair_ranks = np.array([p for p, _ in pairs]), np.array([k for _, k in pairs])
        letters = byte_letters()
        self.of_byte = np.array([self.ids[c] for c in letters])
        self.of_last = np.array([self.ids[c + self.suffix] for c in letters])
        self.spaced = {i: b" " + t.encode() for i, t in self.token.items()}
        self.spaced_len = np.zeros(max(self.token) + 1, dtype=np.int64)
        self.spaced_len[list(self.spaced)] = [len(t) for t in self.spaced.values()]
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+".replace(r"\s", "\t-\r \x85\xa0  -     　"))
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def split(self, word: str) -> list[str]:
        """The pieces of a run without white space, normalised."""
        if not word.isascii():
            word = unicodedata.normalize("NFC", word).replace("Σ", "σ")  # each letter is lowered by itself
        word = word.lower()
        if word.isalpha():
            return [word]
        if word[-1] in ".,;:!?" and word[:-1].isalpha():
            return [word[:-1], word[-1]]
        return self.pieces.findall(word)

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 for pairs that don't merge."""
        key = left.astype(np.int64) << 32 | right
        spot = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[spot] == key) & (left >= 0) & (right >= 0), self.pair_ranks[spot], -1)

    def encode_pieces(self, pieces: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """Ids (as bytes) and decoded tokens of distinct pieces, by the index of pair occurrences. A rank with few
        positions, or of a pair of equal symbols (whose positions may overlap), is applied one position after another; else
        all its positions at once."""
        if not pieces:
            return {}
        coded = [p.encode("utf-8", "surrogatepass") for p in pieces]
        sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(coded), dtype=np.uint8)
        n = len(data)
        sym = self.of_byte[data]
        sym[ends - 1] = self.of_last[data[ends - 1]]
        nxt, prev = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[ends - 1] = -1
        prev[ends - sizes] = -1
        at: dict[int, list] = {}  # rank: positions of left symbols, in parts
        active: list[int] = []

        def enter(spots: np.ndarray) -> None:
            after = nxt[spots]
            spots, after = spots[after >= 0], after[after >= 0]
            ranks = self._ranked(sym[spots], sym[after])
            spots, ranks = spots[ranks >= 0], ranks[ranks >= 0]
            if not len(spots):
                return
            order = np.argsort(ranks, kind="stable")
            spots, ranks = spots[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for part, k in zip(np.split(spots, cuts), ranks[np.concatenate(([0], cuts))].tolist(), strict=True):
                if k not in at:
                    heapq.heappush(active, k)
                    at[k] = [part]
                else:
                    at[k].append(part)

        enter(np.flatnonzero(nxt >= 0))
        rank = self.rank
        while active:
            k = heapq.heappop(active)
            left, right, made = self.of_rank[k]
            parts = at.pop(k)
            spots = np.unique(np.concatenate([np.atleast_1d(x) for x in parts])) if len(parts) > 1 else np.atleast_1d(parts[0])
            if left == right or len(spots) < 24:
                for i in spots.tolist():
                    j = int(nxt[i])
                    if sym[i] != left or j < 0 or sym[j] != right:
                        continue  # its symbols have been merged since
                    sym[i], sym[j] = made, -1
                    after, before = int(nxt[j]), int(prev[i])
                    nxt[i] = after
                    if after >= 0:
                        prev[after] = i
                    for a, b in ((i, after), (before, i)):
                        if a >= 0 and b >= 0 and (r := rank.get((int(sym[a]), int(sym[b])))) is not None:
                            if r not in at:
                                heapq.heappush(active, r)
                                at[r] = []
                            at[r].append(a)
                continue
            j = nxt[spots]
            good = (sym[spots] == left) & (j >= 0) & (sym[j] == right)
            spots, j = spots[good], j[good]
            if not len(spots):
                continue
            sym[spots], sym[j] = made, -1
            after = nxt[j]
            nxt[spots] = after
            has = after >= 0
            prev[after[has]] = spots[has]
            before = prev[spots]
            enter(np.unique(np.concatenate((spots, before[before >= 0]))))
        kept = sym >= 0
        ids = sym[kept]
        counts = np.cumsum(kept)[ends - 1]
        raw, text = ids.astype("<u4").tobytes(), b"".join([self.spaced[i] for i in ids.tolist()])
        lengths = np.concatenate(([0], np.cumsum(self.spaced_len[ids])))
        out, c0, t0 = {}, 0, 0
        for p, c, t in zip(pieces, (counts * 4).tolist(), lengths[counts].tolist(), strict=True):
            out[p] = raw[c0:c], text[t0:t]
            c0, t0 = c, t
        return out


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts in chunks and keeps, per word, its ids (little-endian 32-bit) and its decoded bytes (each token and a
    space before it)."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.words: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}

    def _parts(self, text: str) -> list[str]:
        """Words and special tokens in order."""
        v = self.vocab
        if v.special_split is None or not any(s in text for s in v.special):
            return [x for x in _WHITE.split(text) if x] if _ODD.search(text) else text.split()
        out = []
        for i, part in enumerate(v.special_split.split(text)):
            out += [part] if i % 2 else [x for x in _WHITE.split(part) if x]
        return out

    def _learn(self, words: set[str]) -> None:
        v = self.vocab
        split = {w: v.split(w) for w in words if w not in v.special}
        found = v.encode_pieces(list({p for ps in split.values() for p in ps}))
        for w, ps in split.items():
            self.words[w] = found[ps[0]] if len(ps) == 1 else (b"".join([found[p][0] for p in ps]), b"".join([found[p][1] for p in ps]))
        for w in words & v.special.keys():
            self.words[w] = array("I", [v.special[w]]).tobytes(), v.spaced[v.special[w]]

    def encode(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """For each text the ids' bytes and the decoded text in UTF-8."""
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size < CHUNK_CHARS):
                size += len(texts[hi] or "")
                hi += 1
            split = [self._parts(t or "") for t in texts[lo:hi]]
            if len(self.words) > CACHE_WORDS:
                self.words, self.old = {}, self.words
            new = set()
            for ws in split:
                new.update(ws)
            new.difference_update(self.words)
            again = self.old.keys() & new
            self.words.update({w: self.old[w] for w in again})
            new -= again
            if new:
                self._learn(new)
            known = self.words
            for ws in split:
                found = [known[w] for w in ws]
                yield b"".join([x[0] for x in found]), b"".join([x[1] for x in found])[1:]
            lo = hi


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>) and decoded of every text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(path)
        for b in batches:
            out = Out(schema)
            for doc_id, (ids, text) in zip(b["doc_id"].to_pylist(), coder.encode(b["text"].to_pylist()), strict=True):
                if out.add(doc_id, array("i", ids).tolist(), text.decode("utf-8", "surrogatepass")):
                    yield from out.flush()
            yield from out.flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what encode_decode() gives, as digests made where the ids are."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, out = Encoder(path), Out(schema)
        for b in batches:
            for doc_id, (ids, text) in zip(b["doc_id"].to_pylist(), coder.encode(b["text"].to_pylist()), strict=True):
                if out.add(doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()):
                    yield from out.flush()
        yield from out.flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

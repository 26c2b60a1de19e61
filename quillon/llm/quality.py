"""Quality rules: Jensen-Shannon distance of a document's histograms from its language's, with minimum-length guards.

A pass over the texts counts, per document, ten character classes and the common words of the known languages. The sums
per language over all documents are the references. A document is judged by the Jensen-Shannon distances (base 2, 0 to 1)
of its two histograms from its language's reference: it is kept if neither is above its limit. Documents shorter than
`min_words` words for the character classes, or `min_common_words` for the common words, are too short to judge by that
histogram and pass it. The limit of the common words falls with the length (`Limits.of_words`). The base rules (word count, repeated 5-word windows) come first.

Every language, however rare, has its own reference. Those of the `HELD` most frequent ones travel with the tasks; documents
of the others, each at most one in `HELD` of all, are joined with theirs.

Defined results: a null or empty text has no words and fails the base rules; a document of null language is judged by the
nearest reference of all (least sum of both divergences, then the first name), by the sum over all documents if every
language is null; a language's only document is its own reference; rows repeated in full are each judged alike; words are
runs of bytes other than space and \\t \\n \\v \\f \\r; very long texts are counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import Out, col, mapped, rows, set_aside, shared_dir, table, written

COMMON = {
    "en": "the of and to in a is that it for on with as was be by this are at or an he not from have".split(),
    "fr": "de la le et les des en un une du que est pour qui dans par sur au avec elle ne se pas ce il".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er sie".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero".split(),
}
WORDS = sorted({w for ws in COMMON.values() for w in ws})
COMMON_SIZE = max(map(len, COMMON.values()))
WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
N_CLASSES = 10
#: Languages whose references (about 1 KB each) travel with every task; no limit to how many there are.
HELD = 1024
#: References that a document of null language is compared with at once, beyond those held.
BLOCK = 256


@dataclass(frozen=True)
class Limits:
    """Limits of the two distances and lengths (in words) from which they are judged; words_base is what the limit of the
    common words falls to in very long texts."""

    chars: float = 0.28
    words: float = 0.335
    min_words: int = 40
    min_common_words: int = 150
    words_base: float = 0.2

    def of_words(self, n):
        """Limit of the common words' distance in a text of n words, at most `words`.

        In n words drawn from the reference itself, 8 n ln 2 times the divergence is about chi squared with one degree of
        freedom a common word of the language. Twice that mean is exceeded by about two in a thousand; words_base
        leaves room for style on top, and doesn't shrink with n: 0.2 is a text with 0.7 of its common words replaced.
        """
        noise = 2 * COMMON_SIZE / (8 * np.log(2) * np.maximum(n, 1))
        return np.minimum(self.words, np.sqrt(self.words_base**2 + noise))


def _classes() -> np.ndarray:
    """Class of each byte: lower, upper, digit, blank, line break, sentence mark, symbol of SYMBOLS, other ASCII, lead byte
    of a two-byte character, lead byte of a longer one; -1 for continuation bytes."""
    out = np.full(256, 7)
    for b in range(256):
        c = chr(b)
        if b >= 0xE0:
            out[b] = 9
        elif b >= 0xC0:
            out[b] = 8
        elif b >= 0x80:
            out[b] = -1
        elif c.islower():
            out[b] = 0
        elif c.isupper():
            out[b] = 1
        elif c.isdigit():
            out[b] = 2
        elif c in " \t":
            out[b] = 3
        elif c in "\n\r":
            out[b] = 4
        elif c in ".,;:!?'\"-()":
            out[b] = 5
        elif c in SYMBOLS:
            out[b] = 6
    return out


_FOLD = np.zeros((256, N_CLASSES), dtype=np.int64)
for _b, _k in enumerate(_classes()):
    if _k >= 0:
        _FOLD[_b, _k] = 1
_TOKENS = [(i, [v.encode() for v in dict.fromkeys((w, w.capitalize()))]) for i, w in enumerate(WORDS)]


def repeated(ids: np.ndarray, size: int = 5) -> int:
    """Words in windows of `size` words that are found twice or more, the first included. Exact: windows are numbered by
    doubling (pairs, fours, then one more word), never by a hash."""
    n = len(ids) - size + 1
    if n < 2:
        return 0
    base = int(ids.max()) + 1
    if base**size < 2**62:
        key = np.zeros(n, dtype=np.int64)
        for i in range(size):
            key = key * base + ids[i : i + n]
    else:
        key, span, count = ids.astype(np.int64), 1, base
        while span * 2 <= size:
            _, key = np.unique(key[:-span] * count + key[span:], return_inverse=True)
            span, count = span * 2, int(key.max()) + 1
        while span < size:
            _, key = np.unique(key[: len(ids) - span] * base + ids[span:], return_inverse=True)
            span += 1
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    cover = np.zeros(len(ids) + 1, dtype=np.int32)
    starts = np.flatnonzero(hit)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + size, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, character classes, common words (and all others last)."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    word_chars = len(text) - sum(text.count(chr(c)) for c in WHITE)
    n_symbols = sum(text.count(c) for c in SYMBOLS)
    dup, seen = 0, set()
    for line in data.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip(WHITE):
            seen.add(line)
    chars = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) @ _FOLD
    common = [0] * (len(WORDS) + 1)
    if words:
        counts = np.bincount(ids)
        for i, forms in _TOKENS:
            for w in forms:
                at = numbers.get(w)
                if at is not None:
                    common[i] += int(counts[at])
        common[-1] = len(words) - sum(common)
    return len(words), word_chars, n_symbols, dup, repeated(ids), chars.tolist(), common


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")
_MEASURED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars array<long>, common array<long>"


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep`, lang and what measure() finds."""
    arrow = docs.select(*keep, "lang").limit(0).toArrow().schema
    schema = pa.schema([*arrow, *(pa.field(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.field("chars", pa.list_(pa.int64())), pa.field("common", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(schema)
        for *kept, text in rows(batches):
            if out.add(*kept, *measure(text)):
                yield from out.flush()
        yield from out.flush()

    frame = docs.select(*keep, "lang", "text")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields if f.name != "text")
    return frame.mapInArrow(run, f"{ddl}, {_MEASURED}")


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> float:
    """Distance (root of the divergence in bits) of two histograms, normalised here; 0 if either is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2

    def entropy(x: np.ndarray) -> float:
        x = x[x > 0]
        return float(-(x * np.log2(x)).sum())

    return float(np.sqrt(max(0.0, entropy(m) - (entropy(p) + entropy(q)) / 2)))


def _entropies(x: np.ndarray) -> np.ndarray:
    return -(x * np.log2(np.where(x > 0, x, 1))).sum(axis=-1)


def divergences(p: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Squares of jensen_shannon(p, q) for the rows q of refs."""
    total = refs.sum(axis=1)
    if not p.sum():
        return np.zeros(len(refs))
    p, q = p / p.sum(), refs / np.maximum(total, 1)[:, None]
    found = _entropies((p + q) / 2) - (_entropies(p) + _entropies(q)) / 2
    return np.where(total > 0, np.maximum(found, 0.0), 0.0)


def nearest(chars: np.ndarray, common: np.ndarray, refs: tuple[np.ndarray, np.ndarray]) -> tuple[float, int]:
    """Least sum of both divergences and the place of the first reference that has it; sums are rounded to 12 digits."""
    apart = np.round(divergences(chars, refs[0]) + divergences(common, refs[1]), 12)
    at = int(apart.argmin())
    return float(apart[at]), at


@dataclass(frozen=True)
class Held:
    """References of the most frequent languages in the order of their names, and the sum over all documents."""

    names: list[str]
    refs: tuple[np.ndarray, np.ndarray]
    whole: tuple[np.ndarray, np.ndarray]

    def of(self, lang: str | None, at: dict[str, int], chars: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.names:
            return self.whole
        i = nearest(chars, common, self.refs)[1] if lang is None else at[lang]
        return self.refs[0][i], self.refs[1][i]

    def places(self) -> dict[str, int]:
        return {x: i for i, x in enumerate(self.names)}


def references(counted: DataFrame, held: int = HELD) -> tuple[Held, DataFrame | None]:
    """Sums of the histograms over all documents per language: the most frequent `held` ones, and a frame (lang, ref_chars,
    ref_common) of all others, None if there are none."""
    sums = [F.sum(F.col("chars")[i]).alias(f"c{i}") for i in range(N_CLASSES)] + [F.sum(F.col("common")[i]).alias(f"w{i}") for i in range(len(WORDS) + 1)]

    def histograms(found: list) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array([[r[f"{x}{i}"] or 0 for i in range(n)] for r in found], dtype=float).reshape(len(found), n) for x, n in (("c", N_CLASSES), ("w", len(WORDS) + 1)))

    shared_dir(counted.sparkSession)
    by_lang = counted.groupBy("lang").agg(F.count("*").alias("n"), *sums).checkpoint()
    known = by_lang.filter("lang is not null")
    first = known.orderBy(F.desc("n"), "lang").limit(held + 1).collect()
    more, first = len(first) > held, sorted(first[:held], key=lambda r: r["lang"])
    whole = histograms([by_lang.agg(*(F.sum(c).alias(c) for c in by_lang.columns[2:])).first()])
    out = Held([r["lang"] for r in first], histograms(first), (whole[0][0], whole[1][0]))
    if not more:
        return out, None
    rest = known.filter(~F.col("lang").isin(out.names))
    return out, rest.select("lang", F.array(*(f"c{i}" for i in range(N_CLASSES))).alias("ref_chars"), F.array(*(f"w{i}" for i in range(len(WORDS) + 1))).alias("ref_common"))


def _nearest_of_all(unnamed: DataFrame, held: Held, rest: DataFrame) -> DataFrame:
    """The distinct histograms (chars, common) of `unnamed` with the nearest reference of all languages."""
    spark = unnamed.sparkSession
    own = spark.createDataFrame([(x, list(map(int, c)), list(map(int, w))) for x, c, w in zip(held.names, *held.refs, strict=True)], rest.schema)
    refs = own.unionByName(rest)
    blocks = refs.groupBy(F.pmod(F.xxhash64("lang"), F.lit(-(-refs.count() // BLOCK))).alias("block")).agg(F.sort_array(F.collect_list(F.struct("lang", "ref_chars", "ref_common"))).alias("refs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chars, common, block in rows(batches):
            score, at = nearest(np.array(chars, dtype=float), np.array(common, dtype=float), tuple(np.array([x[c] for x in block], dtype=float) for c in ("ref_chars", "ref_common")))
            row = {"chars": [chars], "common": [common], "score": [score], **{c: [block[at][c]] for c in ("lang", "ref_chars", "ref_common")}}
            yield pa.RecordBatch.from_pydict(row)

    ddl = "chars array<long>, common array<long>, score double, lang string, ref_chars array<long>, ref_common array<long>"
    best = unnamed.select("chars", "common").distinct().crossJoin(blocks.select("refs")).mapInArrow(run, ddl)
    return best.groupBy("chars", "common").agg(F.min(F.struct("score", "lang", "ref_chars", "ref_common")).alias("r")).select("chars", "common", "r.ref_chars", "r.ref_common")


def _judged(counted: DataFrame, keep: list[str], limits: Limits, held: Held, rest: DataFrame | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = held.places()
        for b in batches:
            chars = np.array(b["chars"].to_pylist(), dtype=float).reshape(b.num_rows, N_CLASSES)
            common = np.array(b["common"].to_pylist(), dtype=float).reshape(b.num_rows, len(WORDS) + 1)
            n, again = b["n_words"].to_numpy(), b["n_repeat_words"].to_numpy()
            base_failed = (n < 10) | (100 * again > 20 * n)
            if "ref_chars" in b.schema.names:
                near = [(np.array(p, dtype=float), np.array(q, dtype=float)) for p, q in zip(b["ref_chars"].to_pylist(), b["ref_common"].to_pylist(), strict=True)]
            else:
                near = [held.of(x, at, p, q) for x, p, q in zip(b["lang"].to_pylist(), chars, common, strict=True)]
            dc = np.array([jensen_shannon(p, r[0]) for p, r in zip(chars, near, strict=True)], dtype=float)
            dw = np.array([jensen_shannon(p, r[1]) for p, r in zip(common, near, strict=True)], dtype=float)
            off = ((n >= limits.min_words) & (dc > limits.chars)) | ((n >= limits.min_common_words) & (dw > limits.of_words(n)))
            yield pa.RecordBatch.from_arrays(
                [*(b[c] for c in keep), *(b[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), *map(pa.array, (base_failed, dc, dw, ~base_failed & ~off))],
                names=[*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"],
            )

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counted.select(*keep).schema.fields)
    ddl = f"{ddl}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, kept boolean"
    if rest is None:
        return counted.mapInArrow(run, ddl)
    known, unnamed = counted.filter("lang is not null"), counted.filter("lang is null")
    common_ones, rare = known.filter(F.col("lang").isin(held.names)), known.filter(~F.col("lang").isin(held.names))
    parts = [common_ones, rare.join(rest, "lang"), unnamed.join(_nearest_of_all(unnamed, held, rest), ["chars", "common"])]
    return parts[0].mapInArrow(run, ddl).unionByName(parts[1].mapInArrow(run, ddl)).unionByName(parts[2].mapInArrow(run, ddl))


def judged(docs: DataFrame, keep: list[str], limits: Limits = Limits(), held: int = HELD) -> DataFrame:
    """The columns `keep` of docs with the base counts, base_failed, char_distance, word_distance and kept. A column of docs
    that is named like one of these comes back with its name lengthened by "_" (common.set_aside)."""
    names = [f"_{i}" for i in range(len(keep))]
    flat = docs.select(*(col(c).alias(x) for c, x in zip(keep, names, strict=True)), "lang", "text")
    counted = written(measured(flat, names), "quality")
    found = _judged(counted, names, limits, *references(counted, held))
    return found.select(*(F.col(x).alias(c) for c, x in zip(set_aside(keep, RESULTS), names, strict=True)), *RESULTS)


def filtered(docs: DataFrame, limits: Limits = Limits(), held: int = HELD) -> DataFrame:
    """The documents that are kept, all columns. Texts are read twice (references, then verdicts) and never shuffled, unless
    there are more languages than `held`: then they are written once more, and those of rare or null language joined."""
    most, rest = references(measured(docs, []), held)
    if rest is not None:
        names = [f"_{i}" for i in range(len(docs.columns))]
        flat = docs.select(*(col(c).alias(x) for c, x in zip(docs.columns, names, strict=True)), "lang", "text")
        found = _judged(written(measured(flat, names), "quality"), names, limits, most, rest).filter("kept")
        return found.select(*(F.col(x).alias(c) for c, x in zip(docs.columns, names, strict=True)))
    at, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = most.places()
        for b in batches:
            keep = []
            for text, name in zip(b.column(at).to_pylist(), b.column(lang).to_pylist(), strict=True):
                n, _, _, _, again, *found = measure(text)
                chars, common = (np.array(x, dtype=float) for x in found)
                p, q = most.of(name, places, chars, common)
                ok = n >= 10 and 100 * again <= 20 * n
                ok = ok and (n < limits.min_words or jensen_shannon(chars, p) <= limits.chars)
                keep.append(ok and (n < limits.min_common_words or jensen_shannon(common, q) <= limits.of_words(n)))
            yield b.filter(pa.array(keep, pa.bool_()))

    return mapped(docs, run)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), ["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")

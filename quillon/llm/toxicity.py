"""Toxicity by a counterfactually regularised classifier.

Features are the lower-cased words of a text (without punctuation at their ends) and their prefixes of 4, 5 and 6 letters,
each counted once a text. On a bounded sample of labelled rows (`max_toxic` and `max_clean` rows, those with the smallest
hash of doc_id) the features associated with the label are chosen by their two-proportion z score, at most `max_features`,
and beside them, always, those of the identity terms that occur in the sample; a logistic regression is fitted. Each
labelled text whose sentences name a group comes with its counterfactuals: the text with those identity terms swapped for
their partners, and swapped for a neutral word (people, Menschen, gens, gente). The loss adds `swap_weight` times the mean
squared change of the logit between a text and its counterfactuals. The partners tie the weights of groups to each other,
the neutral word ties them to no group at all, so that naming a group by itself can't move a score, however unevenly the
labels are spread over groups. A swap exchanges all forms of a term, its prefixes too, so it is their sum that is tied.

The sample and the chosen features are bounded by those parameters, so the model is small and is broadcast with the
closure that scores every whole text where it is read; nothing is shuffled.

Defined results: null and empty texts have no features and get the score of the bias; rows without a label, or with a null
one, teach nothing; a doc_id labelled more than once counts with its largest label; with no labelled rows, or rows of one
class only, every score is the (smoothed) share of toxic rows; extra columns pass through.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import Out, mapped, rows, table, written

#: Identity terms and what each is swapped for.
SWAPS = {
    a: b
    for pair in (
        "women men", "woman man", "she he", "her his", "girls boys", "female male", "muslims christians", "muslim christian", "jews hindus", "jewish hindu", "black white", "blacks whites", "gay straight", "lesbian heterosexual",
        "immigrants natives", "foreigners locals", "asian european", "african american", "arabs germans", "frauen männer", "muslime christen", "ausländer deutsche", "juden hindus", "femmes hommes", "musulmans chrétiens", "juifs hindous",
        "étrangers français", "mujeres hombres", "musulmanes cristianos", "judíos hindúes", "extranjeros españoles",
    )
    for a, b in (pair.split(), pair.split()[::-1])
}
#: The word of each language that stands for no group.
_NEUTRAL = {"frauen": "menschen", "männer": "menschen", "muslime": "menschen", "christen": "menschen", "ausländer": "menschen", "deutsche": "menschen", "juden": "menschen"}
_NEUTRAL |= dict.fromkeys(("femmes", "hommes", "musulmans", "chrétiens", "juifs", "hindous", "étrangers", "français"), "gens")
_NEUTRAL |= dict.fromkeys(("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "hindúes", "extranjeros", "españoles"), "gente")
NEUTRAL = {t: _NEUTRAL.get(t, "people") for t in SWAPS}
_MARKS = ".,;:!?\"'()[]{}<>|*#$%&-_/\\«»¿¡…“”„"
_BUCKETS = 1 << 22
CACHE_WORDS = 150_000


@dataclass(frozen=True)
class Options:
    max_toxic: int = 4000
    max_clean: int = 8000
    max_features: int = 20_000
    min_rows: int = 4
    min_z: float = 3.0
    swap_weight: float = 1.0
    ridge: float = 1e-4
    steps: int = 400
    threshold: float = 0.3


def features_of(word: str) -> tuple[int, ...]:
    word = word.strip(_MARKS)
    if not word:
        return ()
    forms = [word + "$", *(word[:n] for n in (4, 5, 6) if len(word) >= n)]
    return tuple(zlib.crc32(f.encode("utf-8", "surrogatepass")) % _BUCKETS for f in forms)


def features(text: str) -> set[int]:
    return {f for w in set(text.lower().split()) for f in features_of(w)}


_SENTENCE = re.compile(r"(?<=[.!?\n])\s+")
_WORD = re.compile(r"\w+")


def swapped(text: str, swaps: dict[str, str] = SWAPS) -> str | None:
    """The text with identity terms swapped in each sentence that has one; None if none has."""
    low = text.lower()
    if not any(t in low for t in swaps):
        return None
    parts = [_WORD.sub(lambda m: swaps.get(m[0], m[0]), s) for s in _SENTENCE.split(low)]
    out = " ".join(parts)
    return None if out.split() == low.split() else out


def counterfactuals(text: str) -> list[str]:
    """The text with identity terms swapped for their partners, and for a neutral word; nothing if it has none."""
    return [x for x in (swapped(text), swapped(text, NEUTRAL)) if x is not None]


def identity_features() -> set[int]:
    return {f for t in (*SWAPS, *NEUTRAL.values()) for f in features_of(t)}


@dataclass
class Model:
    weights: dict[int, float]
    bias: float

    def score(self, found: set[int]) -> float:
        z = self.bias + sum(self.weights.get(f, 0.0) for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def learnable(labels: DataFrame) -> DataFrame:
    """Labelled rows outside the held-out fold: crc32(doc_id as text) mod 4 is not 2."""
    return labels.filter(held_out(F.col("doc_id")) == F.lit(False)).filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


_ROWS = pa.schema([("toxic", pa.int32()), ("found", pa.list_(pa.int32())), ("others", pa.list_(pa.list_(pa.int32())))])
_DDL = "toxic int, found array<int>, others array<array<int>>"


def _sample(docs: DataFrame, labels: DataFrame, opts: Options) -> DataFrame:
    """toxic, features, features of each counterfactual of the bounded sample. Bounded, so broadcast."""
    known = learnable(labels).withColumn("_h", F.xxhash64("doc_id"))
    picked = known.filter("toxic = 1").orderBy("_h", "doc_id").limit(opts.max_toxic).unionByName(known.filter("toxic = 0").orderBy("_h", "doc_id").limit(opts.max_clean)).select(F.col("doc_id").alias("_id"), "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(_ROWS, rows=256)
        for toxic, text in rows(batches):
            text = text or ""
            if out.add(toxic, sorted(features(text)), [sorted(features(x)) for x in counterfactuals(text)]):
                yield from out.flush()
        yield from out.flush()

    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select(F.col("toxic").cast("int"), "text")
    return written(joined.mapInArrow(run, _DDL), "toxicity")


def fit(docs: DataFrame, labels: DataFrame, opts: Options = Options()) -> Model:
    sample = _sample(docs, labels, opts)
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    prior = (pos + 0.5) / (pos + neg + 1) if pos + neg else 0.05
    if not pos or not neg:
        return Model({}, float(np.log(prior / (1 - prior))))
    rate = (F.col("p") / pos, F.col("q") / neg)
    pooled = (F.col("p") + F.col("q") + 1) / (pos + neg + 2)
    counted = (
        sample.select("toxic", F.explode("found").alias("f"))
        .groupBy("f")
        .agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("q"))
        .filter(F.col("p") + F.col("q") >= opts.min_rows)
        .withColumn("z", F.abs(rate[0] - rate[1]) / F.sqrt(pooled * (1 - pooled) * (1 / pos + 1 / neg)))
    )
    own = sorted(identity_features())
    chosen = counted.filter(F.col("z") >= opts.min_z).orderBy(F.desc("z"), "f").limit(opts.max_features).select("f").unionByName(counted.filter(F.col("f").isin(own)).select("f")).distinct().collect()
    names = sorted(r["f"] for r in chosen)
    if not names:
        return Model({}, float(np.log(prior / (1 - prior))))
    place = {f: i for i, f in enumerate(names)}

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(_ROWS)
        for toxic, found, others in rows(batches):
            if out.add(toxic, [place[f] for f in found if f in place], [[place[f] for f in x if f in place] for x in others]):
                yield from out.flush()
        yield from out.flush()

    data = sample.mapInArrow(narrow, _DDL).toArrow()
    y = data["toxic"].to_numpy().astype(float)
    found, others = data["found"].to_pylist(), data["others"].to_pylist()
    order = sorted(range(len(y)), key=lambda i: (y[i], found[i], others[i]))
    y, found, others = y[order], [found[i] for i in order], [others[i] for i in order]
    weights, bias = _logistic(y, found, others, len(names), prior, opts)
    return Model({f: float(w) for f, w in zip(names, weights, strict=True) if w}, bias)


class _Sparse:
    """Rows of 0/1 features."""

    def __init__(self, found: list[list[int]], width: int):
        self.width, self.n = width, len(found)
        self.col = np.array([f for x in found for f in x], dtype=np.int64)
        self.row = np.repeat(np.arange(len(found)), [len(x) for x in found])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=g[self.row], minlength=self.width)


def _logistic(y, found, others, width, prior, opts: Options) -> tuple[np.ndarray, float]:
    """Adam on the mean log loss, the ridge and the mean squared change of the logit under swaps."""
    x = _Sparse(found, width)
    pairs = [(i, o) for i, own in enumerate(others) for o in own]
    a, b = _Sparse([found[i] for i, _ in pairs], width), _Sparse([o for _, o in pairs], width)
    w, bias = np.zeros(width), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, opts.steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w) + bias, -30, 30)))
        g = (p - y) / len(y)
        grad = np.append(x.back(g) + opts.ridge * w, g.sum())
        if pairs:
            change = (a.dot(w) - b.dot(w)) * (2 * opts.swap_weight / len(pairs))
            grad[:-1] += a.back(change) - b.back(change)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - float(step[-1])
    return w, bias


class Scorer:
    """Scores texts; keeps the model's features of words it has met."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def __call__(self, text: str | None) -> float:
        weights, known, found = self.model.weights, self.known, set()
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set((text or "").lower().split()):
            fs = known.get(w)
            if fs is None:
                fs = known[w] = tuple(f for f in features_of(w) if f in weights)
            if fs:
                found.update(fs)
        return self.model.score(found)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, out = Scorer(model), Out(schema)
        for doc_id, text in rows(batches):
            if out.add(doc_id, score(text)):
                yield from out.flush()
        yield from out.flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def filtered(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The documents whose score is below the threshold, all columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model)
        for b in batches:
            yield b.filter(pa.array([score(t) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return mapped(docs, run)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    opts = Options()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), opts)
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= opts.threshold).cast("int").alias("predicted"))

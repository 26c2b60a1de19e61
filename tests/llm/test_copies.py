"""Near-duplicates, repeated substrings and the pipeline against brute force."""

import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("quillon.llm")

from quillon.llm import minhash, suffix  # noqa: E402


def shingles(text, n):
    ws = (text or "").encode().lower().split()
    if not ws:
        return set()
    return {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if len(ws) >= n else {tuple(ws)}


def near_copies(seed, groups=8, size=9):
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([4, 12, 60, 150]))]
        for _ in range(size):
            own = base[:]
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = f"v{rng.randrange(9999)}"
            texts.append(" ".join(own))
    return texts + ["", None, "one", "one", "ONE", "two words", " \n "]


@pytest.mark.parametrize("seed,opts", [(1, minhash.Options(3, 85)), (2, minhash.Options()), (3, minhash.Options(3, 85, rows=1, bands=8))])
def test_components_equal_brute_force(spark, seed, opts):
    texts = near_copies(seed)
    sets = [shingles(t, opts.words) for t in texts]
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= opts.percent * len(a | b) and label[j] > label[i]:
                    label[j], changed = label[i], True
    docs = spark.createDataFrame(list(enumerate(texts)), "_key long, text string").repartition(3)
    got = {r["_key"]: r for r in minhash.classified(docs, opts).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i]["component"] for i in range(len(texts))] == label


def test_odd_rows_of_near_duplicates(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g", 1), (5, "a b c d e f g", 2), (5, "a b c d e f g", 2), (5, "other words here", 3), (7, None, 4)], "doc_id long, text string, component int")
    left = minhash.deduplicated(docs)
    assert left.columns == docs.columns and sorted((r["doc_id"] or 0, r["component"]) for r in left.collect()) == [(0, 1), (5, 3), (7, 4)]
    assert minhash.deduplicated(docs.limit(0)).count() == 0


def brute_removed(texts, n=100):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        cover = np.zeros(len(b) + 1, dtype=int)
        for i in range(len(b) - n + 1):
            s = b[i : i + n]
            if s in seen:
                cover[i] += 1
                cover[i + n] -= 1
            seen.add(s)
        gone = np.cumsum(cover)[:-1] > 0
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def passages(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    shared = [" ".join(word() for _ in range(k)) for k in (20, 26, 40, 90)]
    texts = []
    for _ in range(60):
        parts = [rng.choice(shared)[rng.randrange(9) :] if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randrange(40))) for _ in range(rng.randrange(6))]
        texts.append(" ".join(parts))
    return texts + ["a" * 450, "a" * 99, "a" * 100, "ab" * 300, None, "", texts[3], texts[3], shared[3] * 3]


@pytest.mark.parametrize("hot", [4096, 2])
def test_repeated_bytes_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "PART", 700)
    monkeypatch.setattr(suffix, "RUN", 50)
    monkeypatch.setattr(suffix, "ANCHORS", 60)
    texts = passages(hot)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "0 AS lo", "'x' AS data").repartition(4)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix.removed(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removed(texts)


def test_kept_texts(spark):
    passage = "".join(chr(0xE0 + i % 31) for i in range(80)) + "".join(chr(97 + i * i % 26) for i in range(40))
    docs = spark.createDataFrame([(1, "a " + passage, 5), (2, passage + " b", 5), (None, "short", 5), (2, passage + " b", 5)], "doc_id long, text string, n_chars long")
    got = sorted((r["doc_id"] or 0, r["text"], r["n_chars"]) for r in suffix.deduplicated(docs).collect())
    assert got == [(0, "short", 5), (1, "a " + passage, 122), (2, " b", 2), (2, " b", 2)]
    assert suffix.removed(docs.limit(0)).count() == 0


def test_merge_equals_sorting():
    rng = random.Random(4)
    runs, all_ = [], []
    for k in range(7):
        run = sorted((rng.choice([b"k" * 8, b"m" * 8]) + bytes(rng.choice(b"ab") for _ in range(rng.randrange(30))), b"", k, i) for i in range(rng.randrange(40)))
        all_ += run
        if run:
            runs.append(suffix.Run(suffix.front_code(run)))
    out = list(suffix.merged(runs))
    assert [x for _, x, *_ in out] == sorted(x for x, *_ in all_) and sorted(o[1:] for o in out) == sorted(all_)
    for (_, a, *_), (h, b, *_) in zip(out, out[1:]):
        n = suffix.common(a, b, 8) if a[:8] == b[:8] else 0
        assert h == n


CLASH = ["_key", "_key_", "spans", "_spans", "_mark", "_same", "_id", "_number", "_host", "host", "n_words", "lang2", "rep", "bucket", "digest", "kept", "_0", "_1", "a.b", "places", "data"]


@pytest.mark.parametrize("ids", ["plain", "odd"])
def test_stages_with_clashing_columns_and_odd_rows(spark, ids):
    """Every filtering stage passes every column on, whatever its name, with null, empty, repeated and very long texts."""
    from quillon.llm import quality, toxicity

    rng = random.Random(12)
    prose = " ".join(rng.choice(quality.COMMON["en"] + ["house", "river", "stone"]) for _ in range(60))
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(150_000))
    texts = [prose, prose, prose + " one more word", None, "", long, " ".join(rng.choice(quality.COMMON["en"]) for _ in range(90))]
    rows = [((i if ids == "plain" else (None, 1, 1, 2, None, 3, 3)[i]), t, "en" if i else None, i) for i, t in enumerate(texts)]
    if ids == "odd":
        rows.append(rows[0])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, at int")
    for c in CLASH:
        docs = docs.selectExpr("*", f"concat('{c}', at) AS `{c}`")
    docs = docs.repartition(3)
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int")

    def check(out, at):
        got = out.collect()
        assert out.columns == docs.columns and sorted(r["at"] for r in got) == at
        assert all(r[c] == f"{c}{r['at']}" for r in got for c in CLASH)

    again = [0] if ids == "odd" else []
    check(minhash.deduplicated(docs), [0, 3, 4, 5, 6] if ids == "plain" else [0, 3, 4, 5, 6])
    check(suffix.deduplicated(docs), sorted(list(range(7)) + again))
    check(toxicity.filtered(docs, toxicity.fit(docs, labels), 1.1), sorted(list(range(7)) + again))
    check(quality.filtered(docs, quality.Limits(words=2, chars=2, words_base=2)), sorted([0, 1, 2, 5, 6] + again))
    judged = quality.judged(docs, [c for c in docs.columns if c != "text"], quality.Limits(words=2, chars=2, words_base=2))
    assert "n_words_" in judged.columns and judged.filter("kept").select("at").distinct().count() == 5 and judged.filter("n_words_ <> concat('n_words', at)").count() == 0
    for f in (minhash.deduplicated, suffix.deduplicated, quality.filtered):
        none = f(docs.limit(0))
        assert none.columns == docs.columns and none.count() == 0


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[1] < seen[0] and seen[-1] == seen[-2]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.collect()}

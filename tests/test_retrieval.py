import math
import random

import pytest
from pyspark.sql import functions as F

from quillon.errors import InvalidArgument
from quillon.operators.retrieval import search, similarity


def cos(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


RNG = random.Random(5)
VECTORS = [[RNG.gauss(0, 1) for _ in range(6)] for i in range(40)]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(list(enumerate(VECTORS + [VECTORS[3]])), "key long, vector array<double>").repartition(3)


def test_similarity(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [1, 2, 2], [2, 3]), (None, [1.0], [], [])], "a array<double>, b array<double>, s array<int>, t array<int>")
    r = df.select(similarity.cosine(F.col("a"), F.col("b")), similarity.dot(F.col("a"), F.col("b")), similarity.euclidean(F.col("a"), F.col("b")), similarity.jaccard(F.col("s"), F.col("t"))).collect()
    assert tuple(r[0]) == pytest.approx((0.96, 24, math.sqrt(2), 1 / 3)) and r[1][0] is None and r[1][3] == 1
    for bad in (([0.0], [1.0]), ([1.0, 2.0], [1.0]), ([], [])):
        one = spark.createDataFrame([bad], "a array<double>, b array<double>")
        with pytest.raises(Exception, match="InvalidArgument"):
            one.select(similarity.cosine(F.col("a"), F.col("b"))).collect()


def test_nearest(vectors, monkeypatch):
    for numbers in (10_000, 12):
        monkeypatch.setattr(search, "BLOCK_NUMBERS", numbers)
        got = {(r["query"], r["rank"]): r["key"] for r in search.nearest(vectors.filter("key < 5"), vectors, 3).collect()}
        for q in range(5):
            want = sorted(range(41), key=lambda k: (-round(cos(VECTORS[q], (VECTORS + [VECTORS[3]])[k]), 12), k))[:3]
            assert [got[q, i] for i in (1, 2, 3)] == want
    with pytest.raises(InvalidArgument):
        search.nearest(vectors, vectors, 0)


def test_nearest_holds_a_tile(spark, monkeypatch):
    # no more than a tile's likenesses at once, and exact ties go by key in every task and tile
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    base = rng.normal(size=(500, 7))
    v = spark.createDataFrame([(i, base[i % 500].tolist()) for i in range(3000)], "key long, vector array<double>").repartition(2)
    seen, plain = [], type(v).mapInArrow
    monkeypatch.setattr(type(v), "mapInArrow", lambda self, f, *a: seen.append(f) or plain(self, f, *a))
    got = {(r["query"], r["rank"]): r["key"] for r in search.nearest(v, v, 5).collect()}
    assert all([got[q, i + 1] for i in range(5)] == [q % 500 + 500 * i for i in range(5)] for q in range(3000))
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array([base[i % 500].tolist() for i in range(3000)])], names=["key", "v"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in seen[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 15_000 and peak < 3000 * 3000 * 8  # less than all likenesses of the block


def test_mmr(spark, vectors):
    pool = vectors.filter("key < 12").select(F.lit(0).alias("query"), "key", "vector")
    query = spark.createDataFrame([(0, VECTORS[20])], "query int, vector array<double>")
    got = [r["key"] for r in search.maximal_marginal_relevance(query, pool, 4, 0.4).orderBy("rank").collect()]
    picks, left = [], list(range(12))
    while len(picks) < 4:
        score = lambda k: cos(VECTORS[20], VECTORS[k]) if not picks else 0.4 * cos(VECTORS[20], VECTORS[k]) - 0.6 * max(0, *(cos(VECTORS[k], VECTORS[p]) for p in picks))  # noqa: B023, E731
        picks.append(max(left, key=score))
        left.remove(picks[-1])
    assert got == picks
    with pytest.raises(InvalidArgument):
        search.maximal_marginal_relevance(query, pool, 4, 1.5)


def test_mmr_query_takes_all_vectors(spark):
    # 40 near copies of the query fill its 30 nearest; key 99 is farther off and the only one that isn't redundant
    near = [[1.0, 0.001 * i, 0.0] for i in range(40)]
    rows = [(100 if i == 0 else i + 100, v) for i, v in enumerate(near)] + [(99, [0.6, 0.0, 0.8])]
    v = spark.createDataFrame(rows, "key long, vector array<double>").repartition(3)
    got = {(r["query"], r["rank"]): r["key"] for r in search.marginal_relevance_of_all(v.filter("key % 20 = 0"), v, 5, 0.5).collect()}
    import numpy as np

    vectors, units = dict(rows), {k: np.array(v) / np.linalg.norm(v) for k, v in rows}
    for q in (100, 120):
        keys = sorted(vectors, key=lambda k: (-units[k] @ units[q], k))
        want = [keys[i] for i in search.mmr(np.array(vectors[q]), np.array([vectors[k] for k in keys]), 5, 0.5)]
        assert [got[q, i] for i in range(1, 6)] == want
    assert 99 in [got[100, i] for i in range(1, 6)]


def test_mmr_of_copies_in_tiles(spark, monkeypatch):
    # exact copies tie wherever they stand; tiles and blocks of any size pick the same
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 5))
    rows = [(i, base[i % 60].tolist()) for i in range(240)]
    v = spark.createDataFrame(rows, "key long, vector array<double>").repartition(3)
    for tile, numbers in (((256, 4096), 4_000_000), ((3, 16), 100)):
        monkeypatch.setattr(search, "TILE", tile)
        monkeypatch.setattr(search, "BLOCK_NUMBERS", numbers)
        got = {(r["query"], r["rank"]): r["key"] for r in search.marginal_relevance_of_all(v.filter("key % 20 = 0"), v, 4, 0.7).collect()}
        unit = base / np.linalg.norm(base, axis=1, keepdims=True)
        for q in range(0, 240, 20):
            like, red, left, picks = unit @ unit[q % 60], np.zeros(60), set(range(240)), []
            for n in range(4):
                score = np.round(0.7 * like - 0.3 * red if n else like, 12)
                picks.append(min(left, key=lambda i: (-score[i % 60], -round(like[i % 60], 12), i)))  # noqa: B023
                left.remove(picks[-1])
                red = np.maximum(red, unit @ unit[picks[-1] % 60])
            assert [got[q, i + 1] for i in range(4)] == picks
        if tile[0] == 3:
            assert len(got) == 48


def test_fusion(spark):
    rankings = {0: ["a", "b", "a", "c"], 1: ["c", "a"]}
    df = spark.createDataFrame([(r, i, k) for r, ks in rankings.items() for i, k in enumerate(ks)], "ranking int, position int, key string")
    got = {r["key"]: r["score"] for r in search.reciprocal_rank_fusion(df).collect()}
    assert got == pytest.approx({"a": 1 / 61 + 1 / 62, "b": 1 / 62, "c": 1 / 64 + 1 / 61})
    assert [r["key"] for r in search.reciprocal_rank_fusion(df).collect()] == ["a", "c", "b"]
    with pytest.raises(InvalidArgument):
        search.reciprocal_rank_fusion(df, -1)

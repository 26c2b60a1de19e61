"""Exact nearest neighbours by cosine, maximal marginal relevance, reciprocal rank fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.errors import require
from quillon.iterate import python_path, settled
from quillon.plans.prefix import running_total

#: Numbers in a block of query vectors: what is broadcast at once.
BLOCK_NUMBERS = 4_000_000

#: Queries and candidates whose likenesses a task holds at once, and pairs whose exact likenesses it does.
TILE = (256, 4096)
PAIRS = 65_536


def _checked(df: DataFrame, vector: str) -> int:
    """Length of the vectors, which must be one, with none of zeros."""
    r = df.agg(F.min(F.size(vector)).alias("low"), F.max(F.size(vector)).alias("high"), F.max(F.forall(vector, lambda x: x == 0)).alias("zero")).first()
    require(r["low"] is not None, "there are no vectors")
    require(r["low"] == r["high"] and r["low"] > 0, "vectors must have one length and not be empty")
    require(not r["zero"], "cosine of a zero vector is undefined")
    return r["low"]


def _spread(candidates: DataFrame) -> DataFrame:
    """In as many tasks as there are cores at least: a file of vectors has few splits for the work that they take."""
    n = candidates.sparkSession.sparkContext.defaultParallelism
    return candidates if candidates.rdd.getNumPartitions() >= n else settled(candidates.repartition(n))


def _units(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and unit vectors of at most a tile's width of candidates."""
    for batch in batches:
        for lo in range(0, batch.num_rows, TILE[1]):
            part = batch.slice(lo, TILE[1])
            c = part["v"].flatten().to_numpy().reshape(part.num_rows, dims)
            yield part["key"].to_numpy(), c / np.linalg.norm(c, axis=1, keepdims=True)


def _slack(dims: int) -> float:
    """More than likenesses in single precision are off: what lies within it is compared in doubles."""
    return 4 * (dims + 8) * 2.0**-24


def _likeness(a: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Cosines of the pairs (a[rows], b[cols]), the same for the same vectors wherever they stand."""
    out = np.empty(len(rows))
    for lo in range(0, len(rows), PAIRS):
        at = slice(lo, lo + PAIRS)
        out[at] = (a[rows[at]] * b[cols[at]]).sum(axis=1)
    return np.clip(out, -1, 1)


def _firsts(n: int, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending rows, which are among the first k of their number, and their place there."""
    place = np.arange(len(rows)) - np.searchsorted(rows, np.arange(n))[rows]
    return place < k, place


def nearest(queries: DataFrame, candidates: DataFrame, k: int, key: str = "key", vector: str = "vector", query_key: str | None = None) -> DataFrame:
    """query, key, similarity, rank: the k most similar candidates of each query; ties by ascending key.

    Query vectors are gathered in blocks of bounded size; each task keeps the k best of its candidates per query, so the
    exchange carries k rows a query and task. A task compares tile by tile in single precision and what may be among the best
    in doubles, so its memory grows with neither table.
    """
    require(k >= 1, "k must be at least 1")
    query_key = query_key or key
    spark = queries.sparkSession
    python_path(spark)
    queries = queries.select(F.col(query_key).cast("long").alias("query"), F.col(vector).cast("array<double>").alias("v"))
    candidates = candidates.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    dims = _checked(candidates, "v")
    require(_checked(queries, "v") == dims, "vectors must have one length")
    candidates = _spread(candidates)
    size = max(1, BLOCK_NUMBERS // (dims + 2 * k))
    n_blocks = max(1, -(-queries.count() // size))
    parts = []
    for b in range(n_blocks):
        own = queries if n_blocks == 1 else queries.filter(F.pmod(F.xxhash64("query"), F.lit(n_blocks)) == b)
        t = own.orderBy("query").toArrow()
        if not t.num_rows:
            continue
        q = t["v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, dims)
        held = spark.sparkContext.broadcast((t["query"].to_numpy(), q / np.linalg.norm(q, axis=1, keepdims=True)))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names, unit = held.value
            rough, slack = unit.astype(np.float32), _slack(dims)
            best_s = np.full((len(names), k), -np.inf)
            best_k = np.full((len(names), k), np.iinfo(np.int64).max)
            for keys, c in _units(batches, dims):
                turned = c.astype(np.float32).T
                for lo in range(0, len(names), TILE[0]):
                    s = rough[lo : lo + TILE[0]] @ turned
                    limit = best_s[lo : lo + TILE[0], -1] - slack
                    some = np.flatnonzero(s.max(axis=1) >= limit)
                    s, limit = s[some], limit[some]
                    if len(keys) > k:
                        limit = np.maximum(limit, np.partition(s, -k, axis=1)[:, -k] - slack)
                    rows, cols = np.nonzero(s >= limit[:, None])
                    some += lo
                    r = np.concatenate((np.repeat(np.arange(len(some)), k), rows))
                    s = np.concatenate((best_s[some].ravel(), _likeness(unit, c, some[rows], cols)))
                    ks = np.concatenate((best_k[some].ravel(), keys[cols]))
                    order = np.lexsort((ks, -s, r))
                    kept, place = _firsts(len(some), r[order], k)
                    order, place = order[kept], place[kept]
                    best_s[some[r[order]], place], best_k[some[r[order]], place] = s[order], ks[order]
            at, place = np.nonzero(best_s > -np.inf)
            for lo in range(0, len(at), PAIRS):
                i, j = at[lo : lo + PAIRS], place[lo : lo + PAIRS]
                yield pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(best_k[i, j]), pa.array(best_s[i, j])], names=["query", "key", "similarity"])

        parts.append(candidates.mapInArrow(run, "query long, key long, similarity double"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "key"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def mmr(query: np.ndarray, vectors: np.ndarray, k: int, weight: float) -> list[int]:
    """Places of the selected vectors, in order. Redundancy starts at 0, so unlike vectors aren't rewarded."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    relevance = np.clip(unit @ (query / np.linalg.norm(query)), -1, 1)
    redundancy, left, out = np.zeros(len(unit)), np.ones(len(unit), dtype=bool), []
    while len(out) < min(k, len(unit)):
        score = relevance if not out else weight * relevance - (1 - weight) * redundancy
        pick = int(np.argmax(np.where(left, score, -np.inf)))
        out.append(pick)
        left[pick] = False
        redundancy = np.maximum(redundancy, np.clip(unit @ unit[pick], -1, 1))
    return out


def maximal_marginal_relevance(queries: DataFrame, candidates: DataFrame, k: int, weight: float = 0.5, query: str = "query", key: str = "key", vector: str = "vector", position: str | None = None) -> DataFrame:
    """query, key, rank. candidates: (query, key, vector), each query's own list, in order of `position` (ties in relevance
    keep it) or of key. Greedy selection needs a query's candidates together: one task each, one query after another."""
    require(k >= 1, "k must be at least 1")
    require(0 <= weight <= 1, "lambda must be between 0 and 1")
    python_path(queries.sparkSession)
    own = queries.select(F.col(query).alias("query"), F.col(vector).cast("array<double>").alias("qv"))
    pool = candidates.select(F.col(query).alias("query"), F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"), F.col(position or key).alias("at"))
    _checked(own.select(F.col("qv").alias("v")), "v")
    _checked(pool, "v")
    kinds = {f.name: f.dataType.simpleString() for f in pool.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at", kind="stable")
        picks = mmr(np.array(pdf["qv"].iloc[0]), np.array(pdf["v"].tolist()), k, weight)
        return pd.DataFrame({"query": pdf["query"].iloc[0], "key": pdf["key"].iloc[picks].tolist(), "rank": range(1, len(picks) + 1)})

    return pool.join(own, "query").groupBy("query").applyInPandas(run, f"query {kinds['query']}, key {kinds['key']}, rank int")


def marginal_relevance_of_all(queries: DataFrame, candidates: DataFrame, k: int, weight: float = 0.5, key: str = "key", vector: str = "vector", query_key: str | None = None) -> DataFrame:
    """query, key, rank: maximal marginal relevance with every candidate in every query's list; ties by similarity, then key.

    k rounds a block of queries: each task gives its best candidate per query, given what was picked; candidates stay where
    they are. A task scores tile by tile in single precision and what may be the best in doubles. Keys must be unique.
    """
    require(k >= 1, "k must be at least 1")
    require(0 <= weight <= 1, "lambda must be between 0 and 1")
    query_key = query_key or key
    spark = queries.sparkSession
    python_path(spark)
    queries = queries.select(F.col(query_key).cast("long").alias("query"), F.col(vector).cast("array<double>").alias("v"))
    candidates = candidates.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    dims = _checked(candidates, "v")
    require(_checked(queries, "v") == dims, "vectors must have one length")
    candidates = _spread(candidates)
    n_blocks = max(1, -(-queries.count() // max(1, BLOCK_NUMBERS // (dims * k))))
    found = []
    for b in range(n_blocks):
        t = queries.filter(F.pmod(F.xxhash64("query"), F.lit(n_blocks)) == b).orderBy("query").toArrow()
        if not t.num_rows:
            continue
        names, q = t["query"].to_numpy(), t["v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, dims)
        unit, keys, picked = q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 0), dtype=np.int64), np.zeros((0, len(q), dims))
        for rank in range(1, k + 1):
            held = spark.sparkContext.broadcast((unit, keys, picked))

            def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
                unit, keys, picked = held.value
                n, slack = len(unit), _slack(dims)
                rough, rough_picked = unit.astype(np.float32), picked.astype(np.float32)
                near, far = (np.float32(weight), np.float32(1 - weight)) if len(picked) else (np.float32(1), None)
                best_s, best_like, best_k, best_v = np.full(n, -np.inf), np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max), np.zeros((n, dims))
                for own, c in _units(batches, dims):
                    turned = c.astype(np.float32).T
                    by_key = np.argsort(own)
                    for lo in range(0, n, TILE[0]):
                        hi = min(n, lo + TILE[0])
                        s = rough[lo:hi] @ turned
                        if len(picked):
                            again = np.maximum(rough_picked[0, lo:hi] @ turned, 0)
                            for p in rough_picked[1:]:
                                np.maximum(again, p[lo:hi] @ turned, out=again)
                            s *= near
                            again *= far
                            s -= again
                            at = np.minimum(np.searchsorted(own, keys[lo:hi], sorter=by_key), len(own) - 1)
                            taken = np.nonzero(own[by_key[at]] == keys[lo:hi])
                            s[taken[0], by_key[at[taken]]] = -np.inf
                        top = s.max(axis=1)
                        some = np.flatnonzero((top >= best_s[lo:hi] - slack) & (top > -np.inf))
                        rows, cols = np.nonzero(s[some] >= np.maximum(top[some], best_s[lo + some])[:, None] - slack)
                        if not len(rows):
                            continue
                        rows = lo + some[rows]
                        like = score = _likeness(unit, c, rows, cols)
                        if len(picked):
                            worst = np.zeros(len(rows))
                            for p in picked:
                                np.maximum(worst, _likeness(p, c, rows, cols), out=worst)
                            score = weight * like - (1 - weight) * worst
                        order = np.lexsort((own[cols], -like, -score, rows))
                        order = order[np.concatenate(([True], np.diff(rows[order]) > 0))]
                        i, j, x, y = rows[order], cols[order], score[order], like[order]
                        ahead = (x > best_s[i]) | ((x == best_s[i]) & ((y > best_like[i]) | ((y == best_like[i]) & (own[j] < best_k[i]))))
                        i, j = i[ahead], j[ahead]
                        best_s[i], best_like[i], best_k[i], best_v[i] = x[ahead], y[ahead], own[j], c[j]
                at = np.flatnonzero(best_s > -np.inf)
                for lo in range(0, len(at), TILE[1]):
                    i = at[lo : lo + TILE[1]]
                    vectors = pa.ListArray.from_arrays(np.arange(0, len(i) * dims + 1, dims, dtype=np.int32), best_v[i].ravel())
                    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(-best_s[i]), pa.array(-best_like[i]), pa.array(best_k[i]), vectors], names=["i", "s", "r", "key", "v"])

            tops = candidates.mapInArrow(run, "i long, s double, r double, key long, v array<double>")
            tops = tops.groupBy("i").agg(F.min(F.struct("s", "r", "key", "v")).alias("x")).select("i", "x.key", "x.v").orderBy("i").toArrow()
            held.destroy()
            if not tops.num_rows:
                break
            best = tops["key"].to_numpy()
            found += zip(names[tops["i"].to_numpy()].tolist(), best.tolist(), [rank] * len(best), strict=True)
            keys = np.concatenate((keys, best[:, None]), axis=1)
            picked = np.concatenate((picked, tops["v"].combine_chunks().flatten().to_numpy().reshape(1, len(best), dims)))
    return spark.createDataFrame(found, "query long, key long, rank int")


#: Rankings whose first places are sent to every task; with more of them, none has more than this part of all rows on average.
FEW_RANKINGS = 10_000


def reciprocal_rank_fusion(rankings: DataFrame, k: int = 60, key: str = "key", position: str = "position", ranking: str = "ranking", by: list[str] | None = None) -> DataFrame:
    """key, score and rank (a query, `by`). A key's first place in a ranking counts, and later ones still take up places.
    position orders a ranking; places are counted from 1, by a running total over all rankings, so that no task holds a long
    one. Contributions are added from the largest rank on."""
    require(k >= 0, "k must not be negative")
    by = by or []
    placed = running_total(rankings.select(*by, ranking, key, position), [*map(F.col, by), F.col(ranking), F.col(position), F.col(key)], F.lit(1), "_at")
    first = placed.groupBy(*by, ranking, key).agg(F.min("_at").alias("_at"))
    begins = settled(placed.groupBy(*by, ranking).agg((F.min("_at") - 1).alias("_before")))
    if begins.count() <= FEW_RANKINGS:
        begins = F.broadcast(begins)
    first = first.join(begins, [*by, ranking]).withColumn("_place", F.col("_at") - F.col("_before"))
    terms = F.transform(F.sort_array(F.collect_list("_place"), False), lambda p: 1.0 / (F.lit(k) + p))
    fused = first.groupBy(*by, key).agg(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x).alias("score"))
    if not by:
        return fused.orderBy(F.desc("score"), key)
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), key)))


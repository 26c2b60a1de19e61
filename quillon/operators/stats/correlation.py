"""Pearson (deviations about exact means, clamped to [-1, 1]), Spearman (Pearson of midranks), Kendall's tau-b, matrices.

Rows with a null in either column are left out. A column without variation is refused.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.errors import InvalidArgument, require
from quillon.functions.sums import exact_sums, products
from quillon.iterate import python_path
from quillon.operators.stats.ranks import midranks, no_nan

#: Rows that Kendall's merge count takes in one task; more are refused.
KENDALL_BLOCK = 5_000_000


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()


def pearson(df: DataFrame, x: str, y: str) -> float:
    pairs = _pairs(df, x, y)
    n, sums = exact_sums(pairs, [F.col("x"), F.col("y")], lambda a, b: [[a], [b]])
    require(n >= 2, "correlation needs at least 2 pairs")
    mx, my = (s / n for s in sums)
    require(math.isfinite(mx) and math.isfinite(my), "correlation needs finite values")

    def build(a: np.ndarray, b: np.ndarray) -> list[list[np.ndarray]]:
        a, b = a - mx, b - my
        return [[a], [b], products(a, a), products(b, b), products(a, b)]

    _, (sa, sb, saa, sbb, sab) = exact_sums(pairs, [F.col("x"), F.col("y")], build)
    saa, sbb, sab = saa - sa * sa / n, sbb - sb * sb / n, sab - sa * sb / n
    require(saa > 0 and sbb > 0, "correlation of a sample without variation is undefined")
    return max(-1.0, min(1.0, sab / (math.sqrt(saa) * math.sqrt(sbb))))


def spearman(df: DataFrame, x: str, y: str) -> float:
    pairs = _pairs(df, x, y)
    return pearson(midranks(midranks(pairs, "x", "rx"), "y", "ry"), "rx", "ry")


def inversions(y: np.ndarray) -> int:
    """Pairs i < j with y[i] > y[j], by merge counting over blocks that double."""
    ranks = np.unique(y, return_inverse=True)[1]
    total, width, n = 0, 1, len(ranks)
    ranks = ranks.astype(np.int64)
    while width < n:
        block = np.arange(n) // (2 * width)
        left = (np.arange(n) // width) % 2 == 0
        order = np.lexsort((~left, ranks, block))  # left before right among equals
        is_left = left[order]
        blocks = block[order]
        seen = np.cumsum(is_left)
        starts = np.searchsorted(blocks, np.arange(blocks[-1] + 1))
        base = np.concatenate(([0], seen))[starts]
        lefts = np.bincount(block[left], minlength=blocks[-1] + 1)
        right = ~is_left
        total += int((lefts[blocks[right]] - (seen[right] - base[blocks[right]])).sum())
        ranks = ranks[order]
        width *= 2
    return total


def kendall(df: DataFrame, x: str, y: str) -> float:
    """tau-b. Ties are counted by aggregates; discordant pairs by merge counting over the rows sorted by (x, y), in one task
    (Knight's O(n log n)), refused beyond KENDALL_BLOCK rows."""
    pairs = _pairs(df, x, y)
    no_nan(pairs, "x", "y")
    n = pairs.count()
    require(n >= 2, "correlation needs at least 2 pairs")
    require(n <= KENDALL_BLOCK, f"kendall takes at most {KENDALL_BLOCK} pairs")

    def tied(*cols: str) -> int:
        return pairs.groupBy(*cols).count().agg(F.coalesce(F.sum(F.expr("count * (count - 1) div 2")), F.lit(0))).first()[0]

    tx, ty, txy = tied("x"), tied("y"), tied("x", "y")
    whole = n * (n - 1) // 2
    require(tx < whole and ty < whole, "correlation of an entirely tied sample is undefined")
    python_path(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if found:
            a = np.concatenate([b["x"].to_numpy() for b in found])
            c = np.concatenate([b["y"].to_numpy() for b in found])
            yield pa.RecordBatch.from_arrays([pa.array([inversions(c[np.lexsort((c, a))])])], names=["n"])

    discordant = sum(r["n"] for r in pairs.coalesce(1).mapInArrow(run, "n long").collect())
    concordant = whole - tx - ty + txy - discordant
    return max(-1.0, min(1.0, (concordant - discordant) / math.sqrt(whole - tx) / math.sqrt(whole - ty)))


def _pearson_matrix(df: DataFrame, columns: list[str]) -> list[list[float]]:
    """Two passes for all columns together: means, then all cross products about them."""
    k = len(columns)
    own = [F.col(c) for c in columns]
    n, sums = exact_sums(df, own, lambda *x: [[a] for a in x])
    require(n >= 2, "correlation needs at least 2 pairs")
    means = [s / n for s in sums]
    require(all(map(math.isfinite, means)), "correlation needs finite values")

    def build(*x: np.ndarray) -> list[list[np.ndarray]]:
        x = [a - m for a, m in zip(x, means, strict=True)]
        return [[a] for a in x] + [products(x[i], x[j]) for i in range(k) for j in range(i + 1)]

    found = exact_sums(df, own, build)[1]
    rest = found[:k]
    cross = {(i, j): found[k + i * (i + 1) // 2 + j] - rest[i] * rest[j] / n for i in range(k) for j in range(i + 1)}
    require(k == 1 or all(cross[i, i] > 0 for i in range(k)), "correlation of a sample without variation is undefined")
    r = {(i, j): max(-1.0, min(1.0, cross[i, j] / (math.sqrt(cross[i, i]) * math.sqrt(cross[j, j])))) for i in range(k) for j in range(i)}
    return [[1.0 if i == j else r[max(i, j), min(i, j)] for j in range(k)] for i in range(k)]


def matrix(df: DataFrame, columns: list[str], method: str = "pearson") -> list[list[float]]:
    """Over the rows that have all columns."""
    if method not in ("pearson", "spearman", "kendall"):
        raise InvalidArgument(f"no correlation method {method!r}")
    require(len(columns) >= 1, "a correlation matrix needs columns")
    names = [f"c{i}" for i in range(len(columns))]
    complete = df.select(*(F.col(c).cast("double").alias(x) for c, x in zip(columns, names, strict=True))).dropna()
    if method == "pearson":
        return _pearson_matrix(complete, names)
    if method == "spearman":
        for x in names:
            complete = midranks(complete, x, f"r{x}")
        return _pearson_matrix(complete, [f"r{x}" for x in names])
    out = [[1.0] * len(names) for _ in names]
    for i, a in enumerate(names):
        for j in range(i):
            out[i][j] = out[j][i] = kendall(complete, a, names[j])
    return out

"""Sums that don't depend on how rows are partitioned.

Each task adds its batches with math.fsum and keeps, of every sum, a triple: the rounded sum, the rounded rest and the rest of
that. The triples of all tasks, three numbers each, are added with math.fsum on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from quillon.iterate import python_path


def triple(values: list[float]) -> list[float]:
    hi = math.fsum(values)
    if not math.isfinite(hi):
        return [hi, 0.0, 0.0]
    lo = math.fsum([*values, -hi])
    return [hi, lo, math.fsum([*values, -hi, -lo])]


def products(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """x * y as two arrays whose sum is exact (Dekker, Veltkamp)."""

    def split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = 134217729.0 * a
        hi = c - (c - a)
        return hi, a - hi

    p = x * y
    (xh, xl), (yh, yl) = split(x), split(y)
    return [p, ((xh * yh - p) + xh * yl + xl * yh) + xl * yl]


def exact_sums(df: DataFrame, columns: list[Column], build: Callable[..., list[list[np.ndarray]]]) -> tuple[int, list[float]]:
    """Number of rows (without those that have a null), and for each item of build(*arrays) the exact sum of its arrays."""
    names = [f"c{i}" for i in range(len(columns))]
    python_path(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            n += b.num_rows
            parts = build(*(c.to_numpy(zero_copy_only=False) for c in b.columns))
            new = [triple(np.concatenate(p).tolist()) for p in parts]
            held = new if held is None else [triple(a + c) for a, c in zip(held, new, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[v for t in held for v in t]])], names=["n", "parts"])

    picked = df.select(*(c.cast("double").alias(n) for c, n in zip(columns, names, strict=True))).dropna()
    found = picked.mapInArrow(run, "n long, parts array<double>").collect()  # a row a task
    n = sum(r["n"] for r in found)
    if not found:
        return 0, []
    return n, [math.fsum(v for r in found for v in r["parts"][3 * i : 3 * i + 3]) for i in range(len(found[0]["parts"]) // 3)]


def compensated_sum(values: list[float]) -> float:
    return math.fsum(values)


def exact_product(x: float, y: float) -> tuple[float, float]:
    p = x * y
    return p, math.fma(x, y, -p)


def dot(x: list[float], y: list[float]) -> float:
    return math.sumprod(x, y)

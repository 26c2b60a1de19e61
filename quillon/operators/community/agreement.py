"""Agreement of two partitions of the same nodes, from their contingency table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.errors import require


def _moments(a: DataFrame, b: DataFrame) -> dict:
    x = a.select("node", F.col("community").alias("x"))
    y = b.select("node", F.col("community").alias("y"))
    n = x.count()
    require(n == y.count(), "the partitions cover different numbers of nodes")
    for p, c in ((x, "x"), (y, "y")):
        require(not p.filter(F.col(c) < 0).take(1), "a partition leaves nodes out")
    cells = x.join(y, "node").groupBy("x", "y").agg(F.count("*").cast("double").alias("n"))

    def sums(df: DataFrame, c: str) -> tuple[float, float]:
        v = F.col(c)
        share = v / F.lit(float(max(n, 1)))
        r = df.agg(F.sum(v * (v - 1) / 2), F.sum(-share * F.log(share))).first()
        return r[0] or 0.0, r[1] or 0.0

    both, joint = sums(cells, "n")
    px, hx = sums(cells.groupBy("x").agg(F.sum("n").alias("n")), "n")
    py, hy = sums(cells.groupBy("y").agg(F.sum("n").alias("n")), "n")
    return {"n": n, "both": both, "px": px, "py": py, "hx": hx, "hy": hy, "mutual": max(0.0, hx + hy - joint)}


def normalised_mutual_information(a: DataFrame, b: DataFrame) -> float:
    """Over the mean of the entropies, in [0, 1]; 1 if both are 0."""
    m = _moments(a, b)
    mean = (m["hx"] + m["hy"]) / 2
    return 1.0 if mean <= 0 else max(0.0, min(1.0, m["mutual"] / mean))


def adjusted_rand_index(a: DataFrame, b: DataFrame) -> float:
    m = _moments(a, b)
    if m["n"] < 2:
        return 1.0
    expected = m["px"] * m["py"] / (m["n"] * (m["n"] - 1) / 2)
    most = (m["px"] + m["py"]) / 2
    return 1.0 if most == expected else (m["both"] - expected) / (most - expected)


def variation_of_information(a: DataFrame, b: DataFrame) -> float:
    """In nats."""
    m = _moments(a, b)
    out = m["hx"] + m["hy"] - 2 * m["mutual"]
    return 0.0 if out < 1e-14 or math.isnan(out) else out

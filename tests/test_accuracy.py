"""Digits on samples with known answers (generated by their published rules), and the order-based plans against brute force."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from quillon.operators.graph import paths
from quillon.operators.graph.frame import Graph
from quillon.operators.stats import correlation, regression, tests
from quillon.operators.stats.descriptive import Descriptive, Precision, describe
from quillon.plans.prefix import quantiles


def digits(found, true):
    return 15.0 if found == true else min(15.0, -math.log10(abs(found - true) / abs(true)))


@pytest.mark.parametrize("base,mean_bar,sd_bar", [(1, 14, 14), (1_000_000, 14, 8), (10_000_000, 14, 7.5)])
def test_alternating_samples(spark, base, mean_bar, sd_bar):
    """A value in the middle, then 1,000 that lie 0.1 below and above it by turns."""
    values = [base + 0.2] + [base + (0.1, 0.3)[i % 2] for i in range(1000)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v double").repartition(5)
    x = Descriptive(df, "v", "i")
    assert digits(x.mean(), base + 0.2) > mean_bar and digits(x.std_dev(), 0.1) > sd_bar
    assert digits(x.autocorrelation(), -0.999) > (13 if base == 1 else 8)
    assert digits(x.with_precision(Precision.FAST).std_dev(), 0.1) > 7


@pytest.mark.parametrize("scale,bar", [(1.0, 9.4), (0.1, 12.5)])
def test_polynomials_of_degree_five(spark, scale, bar):
    df = spark.createDataFrame([(float(x), sum((scale * x) ** k for k in range(6))) for x in range(21)], "x double, y double").repartition(3)
    f = regression.polynomial(df, "x", "y", 5)
    assert min(digits(b, scale**k) for k, b in enumerate(f.coefficients)) > bar


@pytest.mark.parametrize("base", [0.0, 1e6, 1e9])
def test_anova_equals_exact_rationals(spark, base):
    rows = [(g, base + 0.1 * g + (0.4 if i == 0 else (0.3, 0.5)[i % 2])) for g in range(1, 10) for i in range(21)]
    groups = [[Fraction(v) for h, v in rows if h == g] for g in range(1, 10)]
    grand = sum(map(sum, groups)) / len(rows)
    between = sum(len(x) * (sum(x) / len(x) - grand) ** 2 for x in groups) / 8
    within = sum((v - sum(x) / len(x)) ** 2 for x in groups for v in x) / 180
    a = tests.anova(spark.createDataFrame(rows, "g int, v double").repartition(4), "g", "v")
    assert digits(a.f, float(between / within)) > 12 and (a.between_df, a.within_df) == (8, 180)


def test_quantiles_equal_numpy(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), float(rng.randrange(20))) for _ in range(400)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    ps = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r["_q"] for r in quantiles(df, "v", ps, ["g"]).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for g, q in got.items():
        assert np.allclose(q, np.quantile([v for h, v in rows if h == g], ps))
    assert np.allclose(quantiles(df, "v", ps).first()[0], np.quantile([v for _, v in rows if v is not None], ps))
    assert {r["g"]: r["median"] for r in describe(df, "v", ["g"]).collect()}["a"] == np.median([v for h, v in rows if h == "a"])
    assert Descriptive(df, "v").median() == np.median([v for _, v in rows if v is not None])


def test_long_lags(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.normal(size=500)
    x = Descriptive(spark.createDataFrame([(i, float(a)) for i, a in enumerate(v)], "i long, v double").repartition(4), "v", "i")
    d = v - v.mean()
    for border in (4096, 10):
        monkeypatch.setattr("quillon.operators.stats.descriptive.BORDER", border)
        for lag in (1, 37, 499):
            assert x.autocorrelation(lag) == pytest.approx((d[:-lag] * d[lag:]).sum() / (d * d).sum(), abs=1e-12)


def test_adjustments_of_a_whole_table_equal_those_of_a_family(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, 0, round(rng.random() ** 3, 2)) for i in range(200)], "i int, f int, p double").repartition(4)
    for m in tests.Adjustment:
        one, other = ({r["i"]: r["adjusted"] for r in tests.adjust(df, "p", m, by).collect()} for by in (None, ["f"]))
        assert one.keys() == other.keys() and all(one[i] == pytest.approx(other[i], abs=1e-12) for i in one), m


def test_contingency_with_empty_cells(spark):
    cells = {(r, c): n for r, row in enumerate([[5, 0, 3], [0, 7, 1], [2, 2, 0]]) for c, n in enumerate(row)}
    df = spark.createDataFrame([(r, c, n) for (r, c), n in cells.items() if n], "r int, c int, n int")
    x = tests.chi_squared(df, "r", "c", "n")
    rn, cn = ([sum(n for k, n in cells.items() if k[i] == j) for j in range(3)] for i in (0, 1))
    total = sum(cells.values())
    assert x.statistic == pytest.approx(sum((n - rn[r] * cn[c] / total) ** 2 / (rn[r] * cn[c] / total) for (r, c), n in cells.items()))
    assert {(e["r"], e["c"]): e["expected"] for e in x.expected().collect()} == {(r, c): pytest.approx(rn[r] * cn[c] / total) for r, c in cells}


def test_correlation_matrices_equal_pairs(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(0, 9, size=(60, 3)).astype(float)
    df = spark.createDataFrame([tuple(map(float, r)) for r in v], "a double, b double, `c d` double").withColumnRenamed("c d", "c").repartition(3)
    for method, f in (("pearson", correlation.pearson), ("spearman", correlation.spearman)):
        m = correlation.matrix(df, ["a", "b", "c"], method)
        assert m[1][0] == m[0][1] == pytest.approx(f(df, "a", "b"), abs=1e-12) and m[2][1] == pytest.approx(f(df, "b", "c"), abs=1e-12) and m[0][0] == 1


@pytest.mark.parametrize("local", [2_000_000, 0])
def test_paths_one_way_and_the_other(spark, local):
    ends = [(i, i + 1, 1.0) for i in range(12)] + [(0, 6, 5.5), (6, 12, 7.0), (3, 14, 0.5)]
    g = Graph.of_directed(spark.createDataFrame(ends, "src long, dst long, weight double"), 15, local)
    assert paths.shortest_path(g, 0, 12) == [0, 6, 7, 8, 9, 10, 11, 12]
    assert paths.shortest_path(g, 0, 14) == [0, 1, 2, 3, 14] and paths.shortest_path(g, 4, 4) == [4] and paths.shortest_path(g, 14, 0) == [] and paths.shortest_path(g, 13, 0) == []

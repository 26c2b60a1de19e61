import itertools
import math
import random
import statistics

import pytest

from quillon.errors import InvalidArgument
from quillon.operators.stats import correlation, ranks, regression
from quillon.operators.stats.descriptive import Descriptive, Precision, describe
from quillon.operators.stats.tests import Adjustment, Alternative, Continuity, adjust, anova, chi_squared, kruskal_wallis, mann_whitney, rejected, t_student, t_welch


def column(spark, values):
    return spark.createDataFrame(list(enumerate(map(float, values))), "i long, x double").repartition(3)


def mid(values):
    s = sorted(values)
    return [s.index(v) + (s.count(v) + 1) / 2 for v in values]


def test_descriptive(spark):
    rng = random.Random(1)
    v = [rng.gauss(5, 2) for _ in range(300)]
    for p in Precision:
        d = Descriptive(column(spark, v), "x", "i", p)
        m = statistics.fmean(v)
        assert d.mean() == pytest.approx(m, rel=1e-14) and d.count() == 300
        assert d.variance() == pytest.approx(statistics.variance(v), rel=1e-12)
        assert d.skewness() == pytest.approx(sum((x - m) ** 3 for x in v) / 300 / statistics.pvariance(v) ** 1.5, rel=1e-10)
        assert d.median() == pytest.approx(statistics.median(v)) and d.iqr() > 0
        for lag in (1, 7, 299):
            want = sum((v[i] - m) * (v[i + lag] - m) for i in range(300 - lag)) / sum((x - m) ** 2 for x in v)
            assert d.autocorrelation(lag) == pytest.approx(want, abs=1e-12)


def test_variance_of_values_far_from_zero(spark):
    from pyspark.sql import functions as F

    df = spark.range(20_000).select((F.lit(1e9) + (F.col("id") % 7) * 1e-6).alias("x"))
    exact = statistics.variance([1e9 + (i % 7) * 1e-6 for i in range(20_000)])
    for n in (1, 5):
        assert Descriptive(df.repartition(n), "x").variance() == pytest.approx(exact, rel=1e-9)


def test_descriptive_refusals(spark):
    empty, constant = Descriptive(column(spark, []), "x", "i"), Descriptive(column(spark, [2, 2, 2, 2]), "x", "i")
    assert empty.sum() == 0 and empty.is_empty()
    for f in (empty.mean, empty.variance, empty.min, constant.skewness, constant.kurtosis, constant.autocorrelation, lambda: constant.autocorrelation(4), lambda: constant.quantile(2), Descriptive(column(spark, [-1, 1]), "x").coefficient_of_variation, Descriptive(column(spark, [math.nan]), "x").sum):
        with pytest.raises(InvalidArgument):
            f()


def test_describe_by_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 3.0), ("b", None)], "g string, x double")
    got = {r["g"]: r for r in describe(df, "x", ["g"]).collect()}
    assert got["a"]["variance"] == pytest.approx(7 / 3) and got["a"]["n"] == 3 and got["b"]["variance"] is None and got["a"]["median"] == 2


def test_ranks(spark):
    v = [3, 1, 3, 2, 2, 2, 9]
    got = [r["midrank"] for r in ranks.midranks(column(spark, v), "x").orderBy("i").collect()]
    assert got == mid(v)
    assert [tuple(r) for r in ranks.tie_sizes(column(spark, v), "x").collect()] == [(1, 1), (2, 3), (3, 2), (9, 1)]
    assert ranks.tied_pairs(column(spark, v), "x") == 4


def brute_tau(x, y):
    s = n = tx = ty = 0
    for i, j in itertools.combinations(range(len(x)), 2):
        a, b = (x[i] > x[j]) - (x[i] < x[j]), (y[i] > y[j]) - (y[i] < y[j])
        s, n, tx, ty = s + a * b, n + 1, tx + (a == 0), ty + (b == 0)
    return s / math.sqrt((n - tx) * (n - ty))


def test_correlations(spark):
    rng = random.Random(4)
    x = [rng.randrange(12) for _ in range(90)]
    y = [a + rng.randrange(9) for a in x]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0)], "x double, y double")
    assert correlation.pearson(df, "x", "y") == pytest.approx(statistics.correlation(x, y), rel=1e-13)
    assert correlation.spearman(df, "x", "y") == pytest.approx(statistics.correlation(mid(x), mid(y)), rel=1e-13)
    assert correlation.kendall(df, "x", "y") == pytest.approx(brute_tau(x, y), rel=1e-13)
    m = correlation.matrix(df, ["x", "y"])
    assert m[0][0] == 1 and m[0][1] == m[1][0]
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    for f in (correlation.pearson, correlation.spearman, correlation.kendall):
        with pytest.raises(InvalidArgument):
            f(flat, "x", "y")
    with pytest.raises(InvalidArgument):
        correlation.matrix(df, ["x", "y"], "cosine")


def groups(spark, **samples):
    return spark.createDataFrame([(g, float(v)) for g, vs in samples.items() for v in vs], "g string, v double")


def test_anova_and_kruskal(spark):
    a, b, c = [1, 2, 3, 4], [2, 4, 6, 8, 10], [5, 5, 6]
    df = groups(spark, a=a, b=b, c=c)
    r = anova(df, "g", "v")
    all_ = a + b + c
    m = statistics.fmean(all_)
    between = sum(len(g) * (statistics.fmean(g) - m) ** 2 for g in (a, b, c))
    within = sum((v - statistics.fmean(g)) ** 2 for g in (a, b, c) for v in g)
    assert r.f == pytest.approx(between / 2 / (within / 9), rel=1e-13)
    assert r.p_value() == pytest.approx((1 + 2 * r.f / 9) ** -4.5, rel=1e-12)
    k = kruskal_wallis(df, "g", "v")
    assert k.p_value() == pytest.approx(math.exp(-k.statistic / 2), rel=1e-13)
    assert anova(groups(spark, a=[1, 1], b=[2, 2]), "g", "v").f == math.inf
    for bad in (groups(spark, a=[1, 2]), groups(spark, a=[1], b=[2])):
        with pytest.raises(InvalidArgument):
            anova(bad, "g", "v")
    with pytest.raises(InvalidArgument):
        kruskal_wallis(groups(spark, a=[1, 1], b=[1]), "g", "v")


def test_chi_squared(spark):
    df = spark.createDataFrame([("a", "x", 10.0), ("a", "y", 20.0), ("b", "x", 30.0), ("b", "y", 5.0)], "r string, c string, n double")
    plain = chi_squared(df, "r", "c", "n", Continuity.UNCORRECTED)
    want = sum((o - e) ** 2 / e for o, e in ((10, 30 * 40 / 65), (20, 30 * 25 / 65), (30, 35 * 40 / 65), (5, 35 * 25 / 65)))
    assert plain.statistic == pytest.approx(want, rel=1e-13) and plain.degrees_of_freedom == 1
    assert chi_squared(df, "r", "c", "n").statistic < plain.statistic
    sparse = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x"), ("c", "y")], "r string, c string")
    assert chi_squared(sparse, "r", "c").degrees_of_freedom == 2
    with pytest.raises(InvalidArgument):
        chi_squared(sparse.filter("c = 'x'"), "r", "c")


def test_t_tests(spark):
    x, y = [1.0, 2.0, 4.0], [2.0, 3.0, 5.0, 9.0]
    w, s = (f(groups(spark, x=x, y=y), "g", "v", "x", "y") for f in (t_welch, t_student))
    se = math.sqrt(statistics.variance(x) / 3 + statistics.variance(y) / 4)
    assert w.statistic == pytest.approx((statistics.fmean(x) - statistics.fmean(y)) / se, rel=1e-13)
    assert s.degrees_of_freedom == 5 and 0 < w.p_value() < 1
    low, high = w.confidence_interval()
    assert low < statistics.fmean(x) - statistics.fmean(y) < high
    assert t_student(groups(spark, x=[1, 1], y=[1, 1]), "g", "v", "x", "y").p_value() != 0
    assert math.isnan(t_student(groups(spark, x=[1, 1], y=[1, 1]), "g", "v", "x", "y").statistic)
    with pytest.raises(InvalidArgument):
        t_welch(groups(spark, x=[1], y=[1, 2]), "g", "v", "x", "y")


def test_mann_whitney(spark):
    x, y = [1, 2, 2, 7], [2, 3, 8, 9, 9]
    df = groups(spark, x=x, y=y)
    u = sum((a > b) + 0.5 * (a == b) for a in x for b in y)
    two = mann_whitney(df, "g", "v", "x", "y")
    assert two.statistic == u
    less, greater = (mann_whitney(df, "g", "v", "x", "y", a, Continuity.UNCORRECTED).p_value() for a in (Alternative.LESS, Alternative.GREATER))
    assert less + greater == pytest.approx(1, rel=1e-12)
    with pytest.raises(InvalidArgument):
        mann_whitney(groups(spark, x=[1], y=[1]), "g", "v", "x", "y")


def test_multiple_testing(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.04, 0.9]
    df = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    n, order = len(p), sorted(range(len(p)), key=lambda i: p[i])
    holm, bh, run = {}, {}, 0.0
    for k, i in enumerate(order):
        run = max(run, (n - k) * p[i])
        holm[i] = min(1.0, run)
    run = 1.0
    for k in range(n - 1, -1, -1):
        run = min(run, p[order[k]] / ((k + 1) / n))
        bh[order[k]] = run
    for method, want in ((Adjustment.HOLM, holm), (Adjustment.BENJAMINI_HOCHBERG, bh), (Adjustment.BONFERRONI, {i: min(1, n * v) for i, v in enumerate(p)})):
        got = {r["i"]: r["adjusted"] for r in adjust(df, "p", method).collect()}
        assert got == pytest.approx(want, rel=1e-13)
    assert sum(r["rejected"] for r in rejected(df, "p", Adjustment.HOLM).collect()) == sum(v <= 0.05 for v in holm.values())
    for bad in (1.5, math.nan):
        with pytest.raises(InvalidArgument):
            adjust(spark.createDataFrame([(0, bad)], "i int, p double"), "p", Adjustment.HOLM)
    with pytest.raises(InvalidArgument):
        rejected(df, "p", Adjustment.HOLM, 0.0)


def test_regression(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3))
    y = 4 + x @ [1, -2, 0.5] + 0.1 * rng.normal(size=60)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double").repartition(4)
    fit = regression.least_squares(df, ["a", "b", "c"], "y")
    design = np.column_stack((np.ones(60), x))
    want, rss = np.linalg.lstsq(design, y, rcond=None)[:2]
    assert fit.coefficients == pytest.approx(want.tolist(), rel=1e-11) and fit.rss == pytest.approx(float(rss[0]), rel=1e-10)
    cov = np.linalg.inv(design.T @ design) * rss[0] / 56
    assert fit.standard_errors == pytest.approx(np.sqrt(np.diag(cov)).tolist(), rel=1e-10)
    assert fit.predict([1, 2, 3]) == pytest.approx(float(want @ [1, 1, 2, 3]))
    inner, outer = fit.mean_response_interval([0, 0, 0]), fit.prediction_interval([0, 0, 0])
    assert outer[0] < inner[0] < inner[1] < outer[1] and fit.overall_p_value() < 1e-30 and fit.p_value(1) < 1e-20
    poly = regression.polynomial(spark.createDataFrame([(float(i), 2.0 + 3.0 * i - 0.25 * i**3) for i in range(10)], "x double, y double"), "x", "y", 3)
    assert poly.coefficients == pytest.approx([2, 3, 0, -0.25], abs=1e-10)
    with pytest.raises(InvalidArgument):
        regression.least_squares(df.withColumn("d", df["a"] * 2), ["a", "d"], "y")
    with pytest.raises(InvalidArgument):
        regression.polynomial(df.withColumn("k", df["a"] * 0), "k", "y", 2)
    with pytest.raises(InvalidArgument):
        fit.predict([1])

import math
from fractions import Fraction

import pytest

from quillon.errors import InvalidArgument
from quillon.functions import special, sums
from quillon.functions.distributions import ChiSquared, FisherSnedecor, Normal, StudentT


@pytest.mark.parametrize("x", [0.1, 1.0, 3.0, 30.0])
def test_gamma_tails_have_closed_forms(x):
    assert special.regularized_gamma_q(1, x) == pytest.approx(math.exp(-x), rel=1e-14)
    assert special.regularized_gamma_q(3, x) == pytest.approx(math.exp(-x) * (1 + x + x * x / 2), rel=1e-13)
    assert special.regularized_gamma_p(2.5, x) + special.regularized_gamma_q(2.5, x) == pytest.approx(1, abs=1e-15)


@pytest.mark.parametrize("x,a,b", [(0.3, 2, 3), (0.9, 5, 2), (0.5, 10, 12)])
def test_beta_equals_a_binomial_sum(x, a, b):
    n, q = a + b - 1, Fraction(x)
    want = sum(math.comb(n, j) * q**j * (1 - q) ** (n - j) for j in range(a, n + 1))
    assert special.regularized_beta(x, a, b) == pytest.approx(float(want), rel=1e-13)


@pytest.mark.parametrize("d", [Normal(), Normal(3, 2), StudentT(1), StudentT(4.5), StudentT(300), ChiSquared(0.7), ChiSquared(2), ChiSquared(40), FisherSnedecor(2, 10), FisherSnedecor(5.5, 3)])
def test_quantiles_invert_both_tails(d):
    for p in (1e-10, 0.01, 0.3, 0.5, 0.8, 0.999):
        assert d.cumulative(d.quantile(p)) == pytest.approx(p, rel=1e-10)
        assert d.survival(d.upper_quantile(p)) == pytest.approx(p, rel=1e-10)


def test_closed_forms_of_tails():
    assert StudentT(1).survival(2.0) == pytest.approx(0.5 - math.atan(2) / math.pi, rel=1e-14)
    assert ChiSquared(2).survival(5.0) == pytest.approx(math.exp(-2.5), rel=1e-14)
    assert FisherSnedecor(2, 10).survival(3.0) == pytest.approx(1.6**-5, rel=1e-13)
    assert FisherSnedecor(2, 7).density(0) == 1.0
    assert ChiSquared(3).quantile(1e-20) > 0
    assert StudentT(3).quantile(1e-18) > -math.inf


def test_bad_arguments_are_refused():
    for f in (lambda: StudentT(0), lambda: Normal(0, -1), lambda: ChiSquared(math.inf), lambda: Normal().quantile(1.5), lambda: special.log_gamma(0), lambda: special.regularized_beta(2, 1, 1)):
        with pytest.raises(InvalidArgument):
            f()


def test_exact_sums_do_not_depend_on_partitions(spark):
    from pyspark.sql import functions as F

    df = spark.range(5000).select((F.pow(F.lit(-1.0), F.col("id")) * F.pow(F.lit(10.0), F.col("id") % 17) + F.rand(3)).alias("x"))
    df = spark.createDataFrame(df.collect(), "x double")
    want = math.fsum(r["x"] for r in df.collect())
    for n in (1, 3, 8):
        assert sums.exact_sums(df.repartition(n), [F.col("x")], lambda x: [[x]])[1][0] == want

"""Distribution and special functions of columns, as Arrow-batched UDFs; null in, null out."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import distributions, special


def _over(f, *columns: Column) -> Column:
    @F.pandas_udf("double")
    def run(*parts: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None or v != v for v in row) else float(f(*row)) for row in zip(*parts, strict=True)], dtype="float64")

    return run(*(c.cast("double") for c in columns))


def erf(x: Column) -> Column:
    return _over(math.erf, x)


def erfc(x: Column) -> Column:
    return _over(math.erfc, x)


def log_gamma(x: Column) -> Column:
    return _over(special.log_gamma, x)


def regularized_gamma_p(a: Column, x: Column) -> Column:
    return _over(special.regularized_gamma_p, a, x)


def regularized_gamma_q(a: Column, x: Column) -> Column:
    return _over(special.regularized_gamma_q, a, x)


def regularized_beta(x: Column, a: Column, b: Column) -> Column:
    return _over(special.regularized_beta, x, a, b)


def _method(method: str, name: str, x: Column, shape: tuple[Column, ...]) -> Column:
    return _over(lambda v, *s: getattr(distributions.named(name, *s), method)(v), x, *shape)


def density(name: str, x: Column, *shape: Column) -> Column:
    """name: normal (mean, sd), t (df), chi2 (df), f (d1, d2)."""
    return _method("density", name, x, shape)


def cumulative(name: str, x: Column, *shape: Column) -> Column:
    return _method("cumulative", name, x, shape)


def survival(name: str, x: Column, *shape: Column) -> Column:
    return _method("survival", name, x, shape)


def quantile(name: str, p: Column, *shape: Column) -> Column:
    return _method("quantile", name, p, shape)


def upper_quantile(name: str, q: Column, *shape: Column) -> Column:
    return _method("upper_quantile", name, q, shape)

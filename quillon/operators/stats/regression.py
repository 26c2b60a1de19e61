"""Least squares by TSQR with refinement.

Tasks reduce their rows of [X | y] to one triangular factor by Householder QR, batch by batch; the factors, one a task and
as wide as the design, are stacked and reduced on the driver. Two passes then refine the solution by the semi-normal
equations from residuals computed with exact products, and a last one adds the squared residuals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.errors import require
from quillon.functions.distributions import FisherSnedecor, StudentT
from quillon.functions.sums import exact_sums, products
from quillon.iterate import python_path

_EPS = 2.0**-52


@dataclass(frozen=True)
class Fit:
    """coefficients (the intercept first), standard_errors, residual_sd, r_squared (about 0 without an intercept)."""

    coefficients: list[float]
    covariance: list[list[float]]
    rss: float
    tss: float
    n: int
    has_intercept: bool

    @property
    def p(self) -> int:
        return len(self.coefficients)

    @property
    def df(self) -> int:
        return self.n - self.p

    @property
    def residual_sd(self) -> float:
        return math.sqrt(self.rss / self.df) if self.df > 0 else 0.0

    @property
    def r_squared(self) -> float:
        return 1 - self.rss / self.tss if self.tss > 0 else 1.0

    @property
    def standard_errors(self) -> list[float]:
        return [math.sqrt(max(0.0, self.covariance[i][i])) for i in range(self.p)]

    def _row(self, row: list[float]) -> list[float]:
        out = [1.0, *row] if self.has_intercept else list(row)
        require(len(out) == self.p, f"a row needs {self.p - self.has_intercept} values")
        return out

    def predict(self, row: list[float]) -> float:
        return math.sumprod(self._row(row), self.coefficients)

    def predict_column(self, columns: list[str]):
        """The prediction as a column."""
        require(len(columns) + self.has_intercept == self.p, f"a row needs {self.p - self.has_intercept} values")
        terms = [F.lit(b) * F.col(c) for b, c in zip(self.coefficients[int(self.has_intercept) :], columns, strict=True)]
        return sum(terms[1:], terms[0]) + F.lit(self.coefficients[0] if self.has_intercept else 0.0)

    def t_statistic(self, i: int) -> float:
        b, se = self.coefficients[i], self.standard_errors[i]
        return b / se if se else math.nan if b == 0 else math.copysign(math.inf, b)

    def p_value(self, i: int) -> float:
        t = self.t_statistic(i)
        return math.nan if math.isnan(t) else 2 * StudentT(self.df).survival(abs(t))

    def _t(self, level: float) -> float:
        require(0 < level < 1, "a confidence level must be between 0 and 1")
        return StudentT(self.df).upper_quantile((1 - level) / 2)

    def confidence_interval(self, i: int, level: float = 0.95) -> tuple[float, float]:
        half = self._t(level) * self.standard_errors[i]
        return self.coefficients[i] - half, self.coefficients[i] + half

    def f_statistic(self) -> float:
        slopes = self.p - self.has_intercept
        require(slopes > 0, "a model without slopes has no F statistic")
        require(self.df > 0, "F needs residual degrees of freedom")
        return math.inf if self.rss == 0 else (self.tss - self.rss) / slopes / (self.rss / self.df)

    def overall_p_value(self) -> float:
        return FisherSnedecor(self.p - self.has_intercept, self.df).survival(self.f_statistic())

    def _interval(self, row: list[float], level: float, extra: float) -> tuple[float, float]:
        x = np.array(self._row(row))
        half = self._t(level) * math.sqrt(extra + max(0.0, float(x @ np.array(self.covariance) @ x)))
        at = self.predict(row)
        return at - half, at + half

    def mean_response_interval(self, row: list[float], level: float = 0.95) -> tuple[float, float]:
        return self._interval(row, level, 0.0)

    def prediction_interval(self, row: list[float], level: float = 0.95) -> tuple[float, float]:
        return self._interval(row, level, self.residual_sd**2)


def _residual(x: np.ndarray, y: np.ndarray, b: list[float]) -> np.ndarray:
    """y - x b with exact products and the sums' rounding errors carried along (twice the working precision)."""
    total, rest = y.astype(float), np.zeros(len(y))
    for i, v in enumerate(b):
        p, low = products(x[:, i], np.full(len(y), -v))
        new = total + p
        back = new - total
        rest += ((total - (new - back)) + (p - back)) + low
        total = new
    return total + rest


def _solve(df: DataFrame, names: list[str], intercept: bool) -> Fit:
    python_path(df.sparkSession)
    p = len(names) + intercept

    def design(cols: tuple[np.ndarray, ...]) -> np.ndarray:
        return np.column_stack([*([np.ones(len(cols[0]))] if intercept else []), *cols])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros((0, p + 1)), 0
        for b in batches:
            if b.num_rows:
                cols = [c.to_numpy() for c in b.columns]
                n += b.num_rows
                held = np.linalg.qr(np.vstack((held, np.column_stack((design(tuple(cols[:-1])), cols[-1])))), mode="r")
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([len(held)]), pa.array([held.ravel().tolist()])], names=["n", "k", "r"])

    rows = df.select(*names, "_y")
    parts = rows.mapInArrow(run, "n long, k long, r array<double>").collect()  # a triangle a task
    n = sum(r["n"] for r in parts)
    require(n >= p, f"a fit of {p} coefficients needs at least {p} rows")
    r = np.linalg.qr(np.vstack([np.array(x["r"]).reshape(x["k"], p + 1) for x in parts]), mode="r")
    r, z = r[:p, :p], r[:p, p]
    diagonal = np.abs(np.diag(r))
    require(diagonal.min() > diagonal.max() * p * _EPS * 16, "the design is rank deficient")  # triangles of triangles round more than one
    b = _back(r, z)
    columns = [F.col(c) for c in [*names, "_y"]]
    for _ in range(2):

        def normal(*cols: np.ndarray, b=b) -> list[list[np.ndarray]]:
            x = design(cols[:-1])
            e = _residual(x, cols[-1], b.tolist())
            return [[x[:, i] * e] for i in range(p)]

        _, g = exact_sums(rows, columns, normal)
        b = b + _back(r, _forward(r, np.array(g)))

    def rest(*cols: np.ndarray) -> list[list[np.ndarray]]:
        e = _residual(design(cols[:-1]), cols[-1], b.tolist())
        return [[e * e], [cols[-1]]]

    _, (rss, total) = exact_sums(rows, columns, rest)
    centre = total / n if intercept else 0.0
    _, (dev, tss) = exact_sums(rows, [F.col("_y")], lambda y: [[y - centre], [(y - centre) ** 2]])
    if intercept:
        tss -= dev * dev / n
    inverse = np.column_stack([_back(r, e) for e in np.eye(p)])
    s2 = rss / (n - p) if n > p else 0.0
    return Fit(b.tolist(), (inverse @ inverse.T * s2).tolist(), rss, tss, n, intercept)


def _back(r: np.ndarray, z: np.ndarray) -> np.ndarray:
    x = np.zeros(len(z))
    for i in range(len(z) - 1, -1, -1):
        x[i] = math.fsum([z[i], *(-r[i, j] * x[j] for j in range(i + 1, len(z)))]) / r[i, i]
    return x


def _forward(r: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Solves r' x = g."""
    x = np.zeros(len(g))
    for i in range(len(g)):
        x[i] = math.fsum([g[i], *(-r[j, i] * x[j] for j in range(i))]) / r[i, i]
    return x


def least_squares(df: DataFrame, columns: list[str], y: str, intercept: bool = True) -> Fit:
    require(bool(columns) or intercept, "a fit needs columns")
    rows = df.select(*(F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)), F.col(y).cast("double").alias("_y")).dropna()
    return _solve(rows, [f"_x{i}" for i in range(len(columns))], intercept)


def polynomial(df: DataFrame, x: str, y: str, degree: int, intercept: bool = True) -> Fit:
    """x is mapped to [-1, 1], fitted, and coefficients and covariance are mapped back. Without an intercept x is only
    scaled."""
    require(degree >= 1, "a polynomial's degree must be at least 1")
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("_y")).dropna()
    low, high = rows.agg(F.min("x"), F.max("x")).first()
    require(low is not None and high > low, "a polynomial needs an x that varies")
    centre, half = ((low + high) / 2, (high - low) / 2) if intercept else (0.0, max(abs(low), abs(high)))
    t = (F.col("x") - F.lit(centre)) / F.lit(half)
    names = [f"_x{k}" for k in range(1, degree + 1)]
    powers, held = [], t
    for k in range(1, degree + 1):
        powers.append(held.alias(f"_x{k}"))
        held = held * t
    fit = _solve(rows.select(*powers, "_y"), names, intercept)
    first = 0 if intercept else 1
    m = np.zeros((degree + 1 - first, degree + 1 - first))
    for k in range(first, degree + 1):  # ((x - centre) / half)**k in powers of x
        for j in range(first, k + 1):
            m[j - first, k - first] = math.comb(k, j) * (-centre) ** (k - j) / half**k
    b = [math.fsum(m[j, k] * fit.coefficients[k] for k in range(len(m))) for j in range(len(m))]
    return Fit(b, (m @ np.array(fit.covariance) @ m.T).tolist(), fit.rss, fit.tss, fit.n, intercept)

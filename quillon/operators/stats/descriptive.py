"""Descriptive statistics of a column.

Conventions: variance with n - 1 (corrected two-pass); skewness g1 and excess kurtosis of population moments; quantiles by
linear interpolation (R type 7); autocorrelation about the overall mean with the denominator over all rows. Rows with a null
value are left out. Extended precision sums exactly (functions.sums), Fast uses Spark's own sums.
"""

from __future__ import annotations

import enum
import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.errors import require
from quillon.functions.sums import exact_sums, products, triple
from quillon.iterate import python_path
from quillon.plans.prefix import quantiles, running_total


class Precision(enum.Enum):
    EXTENDED = "extended"
    FAST = "fast"


#: Lag up to which ranges hand their border values to the driver.
BORDER = 4096


class Descriptive:
    def __init__(self, df: DataFrame, column: str | Column, order_by: str | Column | None = None, precision: Precision = Precision.EXTENDED):
        value = F.col(column) if isinstance(column, str) else column
        order = F.col(order_by) if isinstance(order_by, str) else order_by
        self.precision, self._source = precision, (df, column, order_by)
        self.df = df.select(value.cast("double").alias("x"), *([] if order is None else [order.alias("at")])).filter("x is not null")
        self.ordered = order is not None

    def with_precision(self, precision: Precision) -> Descriptive:
        return Descriptive(*self._source, precision)

    def values(self) -> DataFrame:
        return self.df.orderBy("at").select("x") if self.ordered else self.df.select("x")

    @functools.cached_property
    def _plain(self):
        r = self.df.agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.min("x").alias("low"), F.max("x").alias("high"), F.max(F.isnan("x")).alias("nan")).first()
        require(not r["nan"], "a sample must not contain NaN")
        return r

    def count(self) -> int:
        return self._plain["n"]

    def is_empty(self) -> bool:
        return self.count() == 0

    def _need(self, n: int, what: str) -> None:
        require(self.count() >= n, f"{what} needs at least {n} value{'s' if n > 1 else ''}")

    @functools.cached_property
    def _sum(self) -> float:
        if self.is_empty():
            return 0.0
        return self._plain["s"] if self.precision is Precision.FAST else exact_sums(self.df, [F.col("x")], lambda x: [[x]])[1][0]

    def sum(self) -> float:
        return self._sum

    @functools.cached_property
    def _mean(self) -> tuple[float, float]:
        """The mean and what its rounding left out."""
        self._need(1, "mean")
        m = self._sum / self.count()
        if self.precision is Precision.FAST:
            return m, 0.0
        return m, exact_sums(self.df, [F.col("x")], lambda x: [[x, np.full(len(x), -m)]])[1][0] / self.count()

    def mean(self) -> float:
        m, rest = self._mean
        return m + rest

    def min(self) -> float:
        self._need(1, "min")
        return self._plain["low"]

    def max(self) -> float:
        self._need(1, "max")
        return self._plain["high"]

    def range(self) -> float:
        return self.max() - self.min()

    @functools.cached_property
    def _moments(self) -> list[float]:
        """Sums of the deviations' 2nd to 4th powers, corrected for the mean's rounding."""
        m = self.mean()
        n = self.count()
        if self.precision is Precision.FAST:
            d = F.col("x") - F.lit(m)
            r = self.df.agg(*(F.sum(F.pow(d, F.lit(k))).alias(f"s{k}") for k in (1, 2, 3, 4))).first()
            s1, s2, s3, s4 = (r[f"s{k}"] for k in (1, 2, 3, 4))
        else:

            def build(x: np.ndarray) -> list[list[np.ndarray]]:
                d = x - m
                rest = (x - (d + m)) + 0.0
                return [[d, rest], [*products(d, d), 2 * d * rest], [d**3], [d**4]]

            s1, s2, s3, s4 = exact_sums(self.df, [F.col("x")], build)[1]
        return [s2 - s1 * s1 / n, s3, s4]

    def population_variance(self) -> float:
        self._need(1, "populationVariance")
        return max(0.0, self._moments[0]) / self.count()

    def variance(self) -> float:
        self._need(2, "variance")
        return max(0.0, self._moments[0]) / (self.count() - 1)

    def population_std_dev(self) -> float:
        return math.sqrt(self.population_variance())

    def std_dev(self) -> float:
        return math.sqrt(self.variance())

    def standard_error(self) -> float:
        return self.std_dev() / math.sqrt(self.count())

    def coefficient_of_variation(self) -> float:
        require(self.mean() != 0, "coefficientOfVariation needs a mean other than 0")
        return self.std_dev() / self.mean()

    def skewness(self) -> float:
        self._need(3, "skewness")
        s2, s3, _ = self._moments
        require(s2 > 0, "skewness of a constant sample is undefined")
        return (s3 / self.count()) / (s2 / self.count()) ** 1.5

    def kurtosis(self) -> float:
        self._need(4, "kurtosis")
        s2, _, s4 = self._moments
        require(s2 > 0, "kurtosis of a constant sample is undefined")
        return (s4 / self.count()) / (s2 / self.count()) ** 2 - 3

    def quantile(self, p: float) -> float:
        require(0 <= p <= 1, "a quantile's probability must be between 0 and 1")
        self._need(1, "quantile")
        return quantiles(self.df, "x", [p]).first()[0][0]

    def median(self) -> float:
        return self.quantile(0.5)

    def iqr(self) -> float:
        self._need(1, "iqr")
        low, high = quantiles(self.df, "x", [0.25, 0.75]).first()[0]
        return high - low

    def autocorrelation(self, lag: int = 1) -> float:
        """Rows are range-sorted; each range gives its own products and its first and last `lag` values. Beyond BORDER values,
        too many for the driver to take from every range, rows are numbered and joined with those `lag` places on."""
        require(self.ordered, "autocorrelation needs order_by")
        n = self.count()
        require(1 <= lag < n, "lag must be at least 1 and below the number of values")
        m, rest = self._mean
        exact = self.precision is Precision.EXTENDED
        python_path(self.df.sparkSession)

        def deviations(x: np.ndarray) -> list[np.ndarray]:
            d = x - m
            return [d, (x - (d + m)) - rest] if exact else [d]

        def product(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
            a, b = deviations(x), deviations(y)
            return [*products(a[0], b[0]), a[0] * b[1], a[1] * b[0]] if exact else [a[0] * b[0]]

        def ratio(terms: list[float]) -> float:
            below = exact_sums(self.df, [F.col("x")], lambda x: [product(x, x)])[1][0] if exact else self._moments[0]
            require(below > 0, "autocorrelation of a constant sample is undefined")
            return math.fsum(terms) / below

        if lag > BORDER:
            numbered = running_total(self.df, [F.col("at")], F.lit(1), "i").select("i", "x")
            later = numbered.select((F.col("i") - lag).alias("i"), F.col("x").alias("y"))
            return ratio(exact_sums(numbered.join(later, "i"), [F.col("x"), F.col("y")], lambda x, y: [product(x, y)])[1])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            head, tail, held = np.zeros(0), np.zeros(0), [0.0, 0.0, 0.0]
            count = 0
            for b in batches:
                x = b.column(0).to_numpy()
                if len(x):
                    both = np.concatenate((tail, x))
                    if len(both) > lag:
                        held = triple(np.concatenate([held, *product(both[:-lag], both[lag:])]).tolist())
                    tail = both[-lag:]
                    head = np.concatenate((head, x))[:lag]
                    count += len(x)
            if count:
                yield pa.RecordBatch.from_arrays([pa.array([count]), pa.array([held]), pa.array([head]), pa.array([tail])], names=["n", "held", "head", "tail"])

        parts = int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sorted_ = self.df.repartitionByRange(parts, "at").sortWithinPartitions("at")
        ranges = sorted_.select("x", F.spark_partition_id().alias("p"))

        def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = next(batches, None)
            if first is None or not first.num_rows:
                return
            p = first["p"][0].as_py()

            def rest_of() -> Iterator[pa.RecordBatch]:
                yield first.select(["x"])
                for b in batches:
                    yield b.select(["x"])

            for r in run(rest_of()):
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *r.columns], names=["p", *r.schema.names])

        found = sorted(ranges.mapInArrow(tagged, "p int, n long, held array<double>, head array<double>, tail array<double>").collect())
        terms = [v for r in found for v in r["held"]]
        tail = np.zeros(0)
        for r in found:  # pairs across the borders of ranges
            head = np.array(r["head"])
            both = np.concatenate((tail, head))
            lo = max(0, len(tail) - lag)
            for i in range(lo, len(tail)):
                if len(tail) <= i + lag < len(both):
                    terms += [float(v[0]) for v in product(both[i : i + 1], both[i + lag : i + lag + 1])]
            tail = np.concatenate((tail, np.array(r["tail"])))[-lag:]
        return ratio(terms)


def describe(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """One row (a group) with n, sum, mean, min, max, variance, std_dev, standard_error, skewness, kurtosis, q1, median, q3.
    Two passes: means, then deviations about them. Statistics that a group is too small or constant for are null."""
    by = by or []
    x = df.select(*by, F.col(column).cast("double").alias("_x")).filter("_x is not null")
    means = x.groupBy(*by).agg(F.avg("_x").alias("_m"))
    if by:
        spread = x.join(means, by)
    else:
        spread = x.withColumn("_m", F.lit(means.first()["_m"]))
    d = F.col("_x") - F.col("_m")
    s = spread.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("_x").alias("sum"), F.first("_m").alias("mean"), F.min("_x").alias("min"), F.max("_x").alias("max"), *(F.sum(F.pow(d, F.lit(k))).alias(f"_s{k}") for k in (1, 2, 3, 4))
    )
    found = quantiles(x, "_x", [0.25, 0.5, 0.75], by)
    if by:
        on = F.lit(True)
        for i, c in enumerate(by):
            on = on & F.col(c).eqNullSafe(F.col(f"_by{i}"))
        s = s.join(found.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), "_q"), on)
    else:
        r = found.first()
        s = s.withColumn("_q", F.array(*(F.lit(v).cast("double") for v in (r["_q"] if r else [None] * 3))))
    n = F.col("n").cast("double")
    s2 = F.greatest(F.lit(0.0), F.col("_s2") - F.col("_s1") * F.col("_s1") / n)
    some = s2 > 0
    var = F.when(n > 1, s2 / F.nullif(n - 1, F.lit(0.0)))
    return s.select(
        *by, "n", "sum", "mean", "min", "max", var.alias("variance"), F.sqrt(var).alias("std_dev"), (F.sqrt(var) / F.sqrt(n)).alias("standard_error"),
        F.when(some & (n > 2), (F.col("_s3") / n) / F.pow(F.nullif(s2, F.lit(0.0)) / n, F.lit(1.5))).alias("skewness"), F.when(some & (n > 3), (F.col("_s4") / n) / F.pow(F.nullif(s2, F.lit(0.0)) / n, F.lit(2.0)) - 3).alias("kurtosis"),
        F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"),
    )


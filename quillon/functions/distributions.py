"""Normal, Student's t, chi-squared and F: density, both tails computed directly, and quantiles of either tail."""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

from quillon.errors import InvalidArgument, require
from quillon.functions import special


class Distribution:
    """A continuous distribution; quantile(p) has p below, upper_quantile(q) has q above."""

    lowest = -math.inf

    def density(self, x: float) -> float:
        raise NotImplementedError

    def cumulative(self, x: float) -> float:
        raise NotImplementedError

    def survival(self, x: float) -> float:
        raise NotImplementedError

    def _start(self) -> float:
        return 1.0

    def quantile(self, p: float) -> float:
        require(0 <= p <= 1, "a probability must be between 0 and 1")
        if p == 0:
            return self.lowest
        if p == 1:
            return math.inf
        return self._invert(p, self.cumulative, 1) if p <= 0.5 else self._invert(1 - p, self.survival, -1)

    def upper_quantile(self, q: float) -> float:
        require(0 <= q <= 1, "a probability must be between 0 and 1")
        if q == 0:
            return math.inf
        if q == 1:
            return self.lowest
        return self._invert(q, self.survival, -1) if q <= 0.5 else self._invert(1 - q, self.cumulative, 1)

    def _invert(self, want: float, tail, sign: int) -> float:
        """x with tail(x) = want: a bracket by doubling, then Newton steps on the tail's logarithm kept inside it."""
        low, high = (0.0, self._start()) if self.lowest == 0 else (-self._start(), self._start())
        above = lambda x: sign * (tail(x) - want) > 0  # noqa: E731  the root lies below x
        while not above(high) and high < 1e300:
            low, high = high, high * 2
        if self.lowest == 0:
            while above(low if low > 0 else high / 2) and high > 1e-300:
                high = low if low > 0 else high / 2
                low = 0.0 if low > 0 else 0.0
        else:
            while above(low) and low > -1e300:
                low, high = low * 2, low
        x = (low + high) / 2
        for _ in range(400):
            t = tail(x)
            if sign * (t - want) > 0:
                high = x
            else:
                low = x
            d = self.density(x)
            step = (math.log(t) - math.log(want)) * t / (sign * d) if t > 0 and 0 < d < math.inf else math.nan
            new = x - step
            if not low < new < high:
                new = (low + high) / 2
            if new == x or abs(new - x) <= 1e-16 * abs(new):
                return new
            x = new
        return x


@dataclass(frozen=True)
class Normal(Distribution):
    mean: float = 0.0
    sd: float = 1.0

    def __post_init__(self):
        require(self.sd > 0 and math.isfinite(self.sd) and math.isfinite(self.mean), "a standard deviation must be positive")

    def _z(self, x: float) -> float:
        return (x - self.mean) / self.sd

    def density(self, x: float) -> float:
        return math.exp(-self._z(x) ** 2 / 2) / (self.sd * math.sqrt(2 * math.pi))

    def cumulative(self, x: float) -> float:
        return math.erfc(-self._z(x) / math.sqrt(2)) / 2

    def survival(self, x: float) -> float:
        return math.erfc(self._z(x) / math.sqrt(2)) / 2

    def quantile(self, p: float) -> float:
        require(0 <= p <= 1, "a probability must be between 0 and 1")
        if p in (0, 1):
            return math.inf if p else -math.inf
        return self.mean + self.sd * NormalDist().inv_cdf(p)

    def upper_quantile(self, q: float) -> float:
        require(0 <= q <= 1, "a probability must be between 0 and 1")
        if q in (0, 1):
            return -math.inf if q else math.inf
        return self.mean - self.sd * NormalDist().inv_cdf(q)


def _shape(x: float, what: str = "degrees of freedom") -> None:
    require(x > 0 and math.isfinite(x), f"{what} must be positive and finite")


@dataclass(frozen=True)
class StudentT(Distribution):
    df: float

    def __post_init__(self):
        _shape(self.df)

    def density(self, t: float) -> float:
        n = self.df
        c = math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) if n < 200 else math.sqrt(n / 2) * math.exp(-1 / (4 * n) + 1 / (24 * n**3))
        return c / math.sqrt(n * math.pi) * math.exp(-(n + 1) / 2 * math.log1p(t * t / n))

    def _upper(self, t: float) -> float:
        """Above a t that isn't negative."""
        if math.isinf(t):
            return 0.0
        n, s = self.df, t * t
        return special.regularized_beta(n / (n + s), n / 2, 0.5, s / (n + s)) / 2 if s < 1e300 else 0.5 * special.beta_prefactor(n / s, n / 2, 0.5, 1.0) / (n / 2)

    def cumulative(self, t: float) -> float:
        return 1 - self._upper(t) if t > 0 else self._upper(-t)

    def survival(self, t: float) -> float:
        return self._upper(t) if t >= 0 else 1 - self._upper(-t)

    def quantile(self, p: float) -> float:
        require(0 <= p <= 1, "a probability must be between 0 and 1")
        return 0.0 if p == 0.5 else -self.upper_quantile(p) if p < 0.5 else super().quantile(p)

    def upper_quantile(self, q: float) -> float:
        require(0 <= q <= 1, "a probability must be between 0 and 1")
        return 0.0 if q == 0.5 else super().upper_quantile(q)


@dataclass(frozen=True)
class ChiSquared(Distribution):
    df: float
    lowest = 0.0

    def __post_init__(self):
        _shape(self.df)

    def _start(self) -> float:
        return self.df

    def density(self, x: float) -> float:
        if x < 0:
            return 0.0
        if x == 0:
            return math.inf if self.df < 2 else 0.5 if self.df == 2 else 0.0
        return special.gamma_prefactor(self.df / 2, x / 2) / x

    def cumulative(self, x: float) -> float:
        return 0.0 if x <= 0 else special.regularized_gamma_p(self.df / 2, x / 2)

    def survival(self, x: float) -> float:
        return 1.0 if x <= 0 else special.regularized_gamma_q(self.df / 2, x / 2)


@dataclass(frozen=True)
class FisherSnedecor(Distribution):
    d1: float
    d2: float
    lowest = 0.0

    def __post_init__(self):
        _shape(self.d1)
        _shape(self.d2)

    def density(self, x: float) -> float:
        if x < 0:
            return 0.0
        if x == 0:
            return math.inf if self.d1 < 2 else 1.0 if self.d1 == 2 else 0.0
        n = self.d1 * x + self.d2
        return special.beta_prefactor(self.d1 * x / n, self.d1 / 2, self.d2 / 2, self.d2 / n) / x

    def cumulative(self, x: float) -> float:
        if x <= 0:
            return 0.0
        if math.isinf(x):
            return 1.0
        n = self.d1 * x + self.d2
        return special.regularized_beta(self.d1 * x / n, self.d1 / 2, self.d2 / 2, self.d2 / n)

    def survival(self, x: float) -> float:
        if x <= 0:
            return 1.0
        if math.isinf(x):
            return 0.0
        n = self.d1 * x + self.d2
        return special.regularized_beta(self.d2 / n, self.d2 / 2, self.d1 / 2, self.d1 * x / n)


def named(name: str, *shape: float) -> Distribution:
    kinds = {"normal": Normal, "t": StudentT, "chi2": ChiSquared, "f": FisherSnedecor}
    if name not in kinds:
        raise InvalidArgument(f"no distribution {name!r}")
    return kinds[name](*shape)

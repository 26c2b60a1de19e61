"""Special functions of one number, from their series and continued fractions."""

from __future__ import annotations

import math

from quillon.errors import DidNotConverge, require

_TINY, _EPS = 1e-300, 2.0**-53
erf, erfc = math.erf, math.erfc


def log_gamma(x: float) -> float:
    require(x > 0, "logGamma needs a positive argument")
    return math.lgamma(x)


def _stirling_rest(a: float) -> float:
    """ln Gamma(a) less Stirling's leading terms, for a of 10 or more."""
    r = 1 / (a * a)
    return (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r * (1 / 1188 - r * 691 / 360360))))) / a


def _log1pmx(x: float) -> float:
    """log(1 + x) - x without cancellation near 0."""
    if abs(x) > 0.4:
        return math.log1p(x) - x
    r = x / (2 + x)
    total, term, k, r2 = 0.0, 2 * r * r * r, 3, r * r
    while True:
        new = total + term / k
        if new == total:
            break
        total, term, k = new, term * r2, k + 2
    return total - r * x


def gamma_prefactor(a: float, x: float) -> float:
    """x**a * exp(-x) / Gamma(a)."""
    require(a > 0 and x >= 0, "gammaPrefactor needs a > 0 and x >= 0")
    if x == 0:
        return 0.0
    if a < 10:
        return math.exp(a * math.log(x) - x - math.lgamma(a))
    e = a * _log1pmx((x - a) / a) - _stirling_rest(a)
    return math.sqrt(a / (2 * math.pi)) * math.exp(e)


def beta_prefactor(x: float, a: float, b: float, complement: float | None = None) -> float:
    """x**a * (1 - x)**b / Beta(a, b); complement is 1 - x where that is known better."""
    require(a > 0 and b > 0, "betaPrefactor needs positive shapes")
    y = 1 - x if complement is None else complement
    if x <= 0 or y <= 0:
        return 0.0
    if a < 10 or b < 10:
        if a + b < 100:
            return math.exp(a * math.log(x) + b * math.log(y) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
        small, big = min(a, b), max(a, b)
        # ln Gamma(big + small) - ln Gamma(big) without cancelling large values
        up = (big + small - 0.5) * math.log1p(small / big) + small * (math.log(big) - 1) + _stirling_rest(big + small) - _stirling_rest(big)
        return math.exp(a * math.log(x) + b * math.log(y) + up - math.lgamma(small))
    n = a + b
    xa, yb = x * n / a, y * n / b
    e = a * (math.log(xa) if abs(xa - 1) > 0.4 else _log1pmx((x * n - a) / a) + (x * n - a) / a)
    e += b * (math.log(yb) if abs(yb - 1) > 0.4 else _log1pmx((y * n - b) / b) + (y * n - b) / b)
    return math.sqrt(a * b / (2 * math.pi * n)) * math.exp(e + _stirling_rest(n) - _stirling_rest(a) - _stirling_rest(b))


def _gamma_series(a: float, x: float) -> float:
    term = total = 1 / a
    for k in range(1, 100_000):
        term *= x / (a + k)
        total += term
        if term < total * _EPS:
            return gamma_prefactor(a, x) * total
    raise DidNotConverge("the series of the incomplete gamma function did not converge")


def _gamma_fraction(a: float, x: float) -> float:
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / (b or _TINY)
    h = d
    for k in range(1, 100_000):
        n = -k * (k - a)
        b += 2
        d = 1 / ((n * d + b) or _TINY)
        c = (b + n / c) or _TINY
        step = c * d
        h *= step
        if abs(step - 1) < 2 * _EPS:
            return gamma_prefactor(a, x) * h
    raise DidNotConverge("the fraction of the incomplete gamma function did not converge")


def regularized_gamma_p(a: float, x: float) -> float:
    require(a > 0 and x >= 0, "regularizedGammaP needs a > 0 and x >= 0")
    if x == 0:
        return 0.0
    if math.isinf(x):
        return 1.0
    return _gamma_series(a, x) if x < a + 1 else 1 - _gamma_fraction(a, x)


def regularized_gamma_q(a: float, x: float) -> float:
    require(a > 0 and x >= 0, "regularizedGammaQ needs a > 0 and x >= 0")
    if x == 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    return 1 - _gamma_series(a, x) if x < a + 1 else _gamma_fraction(a, x)


def _beta_fraction(x: float, a: float, b: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or _TINY)
    h = d
    for m in range(1, 200_000):
        n = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / ((1 + n * d) or _TINY)
        c = (1 + n / c) or _TINY
        h *= d * c
        n = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + n * d) or _TINY)
        c = (1 + n / c) or _TINY
        h *= d * c
        if abs(d * c - 1) < 2 * _EPS:
            return h
    raise DidNotConverge("the fraction of the incomplete beta function did not converge")


def regularized_beta(x: float, a: float, b: float, complement: float | None = None) -> float:
    """I_x(a, b); on the far side of the mean from the other tail."""
    require(a > 0 and b > 0, "regularizedBeta needs positive shapes")
    require(0 <= x <= 1, "regularizedBeta needs x in [0, 1]")
    y = 1 - x if complement is None else complement
    if x == 0:
        return 0.0
    if y == 0:
        return 1.0
    if x <= a / (a + b):
        return beta_prefactor(x, a, b, y) * _beta_fraction(x, a, b) / a
    return 1 - beta_prefactor(y, b, a, x) * _beta_fraction(y, b, a) / b

"""Tail probabilities for the sufficient statistics that Spark aggregates deliver.

Scalar helpers on plain floats: one call per test result row, never per data row.
"""

from __future__ import annotations

import math
from statistics import NormalDist

_UNIT = NormalDist()


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def normal_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2.0))


def normal_ppf(p: float) -> float:
    if p <= 0.0:
        return -math.inf
    if p >= 1.0:
        return math.inf
    return _UNIT.inv_cdf(p)


#: Beyond this parameter the continued fractions would need too many terms and limits are used.
LARGE = 1e9
MIDDLE = 1e5


def _stirling_error(n: float) -> float:
    """ln Gamma(n) less Stirling's formula (n - 1/2) ln n - n + ln(2 pi) / 2."""
    if n < 16.0:
        return math.lgamma(n) - (n - 0.5) * math.log(n) + n - 0.5 * math.log(2.0 * math.pi)
    q = 1.0 / (n * n)
    return (1 / 12 - q * (1 / 360 - q * (1 / 1260 - q * (1 / 1680 - q / 1188)))) / n


def _deviance(x: float, m: float) -> float:
    """x ln(x / m) + m - x without cancellation where x is close to m."""
    d = (x - m) / m
    if abs(d) > 0.1:
        return x * math.log(x / m) + m - x
    # ln(x/m) = 2 artanh(v) with v = (x - m) / (x + m)
    v = (x - m) / (x + m)
    total, term, k = (x - m) * v, 2.0 * x * v, 1
    while True:
        term *= v * v
        new = total + term / (2 * k + 1)
        if new == total:
            return total
        total, k = new, k + 1


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 4e-16:
            return total
    raise ArithmeticError(f"incomplete beta did not converge for a={a}, b={b}, x={x}")


def beta_cdf(x: float, a: float, b: float, rest: float | None = None) -> float:
    """Regularised incomplete beta function; ``rest`` is 1 - x where the caller knows it more exactly."""
    y = 1.0 - x if rest is None else rest
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    if max(a, b) > LARGE:
        if min(a, b) > MIDDLE:
            return _beta_both_large(x, y, a, b)
        if a > b:
            return gamma_sf(-(a + (b - 1.0) / 2.0) * (math.log1p(-y) if y < 0.5 else math.log(x)), b)
        return 1.0 - gamma_sf(-(b + (a - 1.0) / 2.0) * (math.log1p(-x) if x < 0.5 else math.log(y)), a)
    n = a + b
    front = math.sqrt(a * b / (2.0 * math.pi * n)) * math.exp(
        _stirling_error(n) - _stirling_error(a) - _stirling_error(b) - _deviance(a, n * x) - _deviance(b, n * y))
    if x < (a + 1.0) / (n + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, y) / b


def _beta_both_large(x: float, y: float, a: float, b: float) -> float:
    """Uniform expansion in a + b: an error function and its first correction."""
    n = a + b
    away = (x * b - y * a) / n  # x less its mean a / n
    half = (_deviance(a, n * x) + _deviance(b, n * y)) / n
    eta = math.copysign(math.sqrt(2.0 * half), away)
    middle = math.sqrt(a * b) / n
    small = (1.0 - 2.0 * a / n) / (3.0 * middle) if abs(eta) < 1e-5 else 1.0 / eta - middle / away
    return 0.5 * math.erfc(-eta * math.sqrt(n / 2.0)) + math.exp(-n * half) * small / math.sqrt(2.0 * math.pi * n)


def _bisect(f, lo: float, hi: float, p: float) -> float:
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if mid in (lo, hi):
            break
        if f(mid) < p:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


def beta_ppf(p: float, a: float, b: float) -> float:
    return _bisect(lambda x: beta_cdf(x, a, b), 0.0, 1.0, p)


def t_sf(t: float, df: float) -> float:
    half = 0.5 * t_two_sided(t, df)
    return half if t >= 0 else 1.0 - half


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / (df + t * t), df / 2.0, 0.5, t * t / (df + t * t))


def t_ppf(p: float, df: float) -> float:
    if p < 0.5:
        return -t_ppf(1.0 - p, df)
    hi = 2.0
    while 1.0 - t_sf(hi, df) < p:
        hi *= 2.0
    return _bisect(lambda x: 1.0 - t_sf(x, df), 0.0, hi, p)


def f_sf(x: float, d1: float, d2: float) -> float:
    if x <= 0.0:
        return 1.0
    return beta_cdf(d2 / (d2 + d1 * x), d2 / 2.0, d1 / 2.0, d1 * x / (d2 + d1 * x))


def gamma_sf(x: float, a: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    if a > LARGE:
        half = _deviance(a, x) / a
        eta = math.copysign(math.sqrt(2.0 * half), x - a)
        small = -1.0 / 3.0 if abs(eta) < 1e-5 else a / (x - a) - 1.0 / eta
        return 0.5 * math.erfc(eta * math.sqrt(a / 2.0)) + math.exp(-a * half) * small / math.sqrt(2.0 * math.pi * a)
    front = math.sqrt(a / (2.0 * math.pi)) * math.exp(-_deviance(a, x) - _stirling_error(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - front * total
    b, c = x + 1.0 - a, 1e300
    d = 1.0 / b
    total = d
    for i in range(1, 500_000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b)
        c = b + an / c
        total *= d * c
        if abs(d * c - 1.0) < 4e-16:
            return front * total
    raise ArithmeticError(f"incomplete gamma did not converge for a={a}, x={x}")


def chi2_sf(x: float, df: float) -> float:
    return gamma_sf(x / 2.0, df / 2.0)


def kolmogorov_sf(x: float) -> float:
    """Limit distribution of sqrt(n) times the Kolmogorov statistic."""
    if x <= 0.0:
        return 1.0
    if x < 0.5:
        s = sum(
            math.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * x * x)) for k in range(1, 30)
        )
        return 1.0 - math.sqrt(2 * math.pi) / x * s
    return max(
        0.0, 2.0 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))
    )

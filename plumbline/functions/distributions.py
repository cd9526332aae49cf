"""Distribution functions as column expressions (and one Arrow-batched helper)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's rational approximation of the normal distribution function.
HART_TOP = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
HART_BOTTOM = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, about fifteen digits."""
    a = F.abs(z)
    e = F.exp(-a * a / 2)
    near = e * _polynomial(a, HART_TOP) / _polynomial(a, HART_BOTTOM)
    far = e / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / math.sqrt(2 * math.pi)
    upper = F.when(a > 37, F.lit(0.0)).when(a < 7.07106781186547, near).otherwise(far)
    return F.when(z > 0, 1 - upper).otherwise(upper)


def gamma_cdf(shape: float):
    """Pandas UDF for the regularised lower incomplete gamma function of one shape."""
    a = float(shape)

    def lower(x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        front = np.exp(-x + a * np.log(np.maximum(x, 1e-300)) - math.lgamma(a))
        small = (x > 0) & (x < a + 1)
        if small.any():
            t = total = np.full(small.sum(), 1.0 / a)
            k = a
            while np.any(t > total * 1e-16):
                k += 1.0
                t = t * x[small] / k
                total = total + t
            out[small] = front[small] * total
        large = x >= a + 1
        if large.any():
            b, c = x[large] + 1 - a, np.full(large.sum(), 1e300)
            d = 1 / b
            h = d.copy()
            for i in range(1, 10_000):
                an = -i * (i - a)
                b = b + 2
                d = 1 / (an * d + b)
                c = b + an / c
                h = h * d * c
                if np.all(np.abs(d * c - 1) < 1e-15):
                    break
            out[large] = 1 - front[large] * h
        return out

    @F.pandas_udf("double")
    def cdf(x: pd.Series) -> pd.Series:
        return pd.Series(lower(x.to_numpy(dtype=float)))

    return cdf


# Acklam's rational approximation of the normal quantile function.
ACKLAM_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
            1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
ACKLAM_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
            6.680131188771972e+01, -1.328068155288572e+01, 1.0)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
            -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
            3.754408661907416e+00, 1.0)


def normal_ppf(p: Column) -> Column:
    """Standard normal quantile function, one Newton step after the approximation."""
    q = p - 0.5
    r = q * q
    middle = q * _polynomial(r, ACKLAM_A) / _polynomial(r, ACKLAM_B)
    t = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = _polynomial(t, ACKLAM_C) / _polynomial(t, ACKLAM_D)
    rough = F.when(F.least(p, 1 - p) < 0.02425, F.when(p < 0.5, tail).otherwise(-tail)).otherwise(middle)
    return rough - (normal_cdf(rough) - p) * math.sqrt(2 * math.pi) * F.exp(rough * rough / 2)

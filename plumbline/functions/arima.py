"""ARIMA of one regular series by exact maximum likelihood.

The differenced series is an ARMA process in state-space form, whose likelihood the Kalman filter gives exactly, missing values included. The
coefficients are searched for in a space where every point is stationary and invertible; the variance is solved for in closed form.
Spark applies this to one series per key (``operators.series.forecast``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: The gain counts as settled when it has moved by less than this for as many steps as the state is long.
SETTLED = 1e-10


def stable(free: np.ndarray) -> np.ndarray:
    """Coefficients c of a stationary recursion x_t = c_1 x_(t-1) + ... from any numbers, by way of partial autocorrelations in (-1, 1)."""
    partial, out = free / np.sqrt(1 + free * free), np.empty(0)
    for r in partial:
        out = np.append(out - r * out[::-1], r)
    return out


def unstable(coefficients: np.ndarray) -> np.ndarray:
    """The inverse of ``stable``; coefficients that are not stationary are drawn in first."""
    c, partial = np.array(coefficients, float), []
    while len(c):
        r = float(np.clip(c[-1], -0.97, 0.97))
        partial.append(r)
        c = (c[:-1] + r * c[:-1][::-1]) / (1 - r * r)
    partial = np.array(partial[::-1])
    return partial / np.sqrt(1 - partial * partial)


def seasonal_product(plain: np.ndarray, seasonal: np.ndarray, period: int, sign: float) -> np.ndarray:
    """Lag coefficients of (1 + sign a(B)) (1 + sign b(B^period)), with the leading one and ``sign`` taken off."""
    long = np.zeros(period * len(seasonal) + 1)
    long[0], long[period::period] = 1.0, sign * seasonal
    return sign * np.convolve(np.append(1.0, sign * plain), long)[1:]


def start_covariance(t: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The state's covariance before the first value: P = T P T' + r r', summed by doubling."""
    p, a = np.outer(r, r), t.copy()
    for _ in range(60):
        more = a @ p @ a.T
        p = p + more
        if np.abs(more).max() <= 1e-13 * np.abs(p).max():
            break
        a = a @ a
    return p


@dataclass
class Filtered:
    """What the filter leaves: observed values, sum of squared standardised errors, sum of log variances, and the state after the last value."""

    n: int
    squares: float
    logs: float
    state: np.ndarray


def kalman(x: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> Filtered:
    """Filter a zero-mean series (NaN: missing) under ARMA coefficients, with unit innovation variance."""
    size = max(len(ar), len(ma) + 1)
    phi, r = np.zeros(size), np.zeros(size)
    phi[:len(ar)] = ar
    r[0], r[1:len(ma) + 1] = 1.0, ma
    t = np.eye(size, k=1)
    t[:, 0] = phi
    noise, p, a = np.outer(r, r), start_covariance(t, r), np.zeros(size)
    n, squares, logs, calm, last = 0, 0.0, 0.0, 0, np.inf
    missing = np.isnan(x)
    whole_from = int(np.flatnonzero(missing)[-1]) + 1 if missing.any() else 0
    for i in range(len(x)):
        if calm > size and i >= whole_from:
            # The gain has settled: from here on the innovations follow the plain recursion.
            gain = (t @ p[:, 0]) / p[0, 0]
            f, rows = p[0, 0], gain.tolist()
            state, coefficients = a.tolist(), phi.tolist()
            for value in x[i:].tolist():
                v = value - state[0]
                first = state[0]
                state = [s + c * first + g * v for s, c, g in zip(state[1:] + [0.0], coefficients, rows)]
                squares += v * v / f
            n += len(x) - i
            logs += (len(x) - i) * np.log(f)
            return Filtered(n, squares, logs, np.array(state))
        if missing[i]:
            a, p, calm = t @ a, t @ p @ t.T + noise, 0
            continue
        f, v = p[0, 0], x[i] - a[0]
        gain = p[:, 0] / f
        n, squares, logs = n + 1, squares + v * v / f, logs + np.log(f)
        a = t @ (a + gain * v)
        p = t @ (p - np.outer(gain, p[0])) @ t.T + noise
        calm = calm + 1 if abs(f - last) <= SETTLED * f else 0
        last = f
    return Filtered(n, squares, logs, a)


def simplex_search(cost, start: np.ndarray, evaluations: int, step: float = 0.3, tolerance: float = 1e-7) -> np.ndarray:
    """Nelder and Mead's search without derivatives."""
    m = len(start)
    if not m:
        return start
    points = np.vstack([start, start + step * np.eye(m)])
    values, used = np.array([cost(p) for p in points]), m + 1
    while used < evaluations:
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if values[-1] - values[0] <= tolerance * (1 + abs(values[0])):
            break
        centre = points[:-1].mean(axis=0)
        trial = centre + (centre - points[-1])
        value, used = cost(trial), used + 1
        if value < values[0]:
            further = centre + 2 * (centre - points[-1])
            more, used = cost(further), used + 1
            if more < value:
                trial, value = further, more
        elif value >= values[-2]:
            inner = centre + 0.5 * ((trial if value < values[-1] else points[-1]) - centre)
            less, used = cost(inner), used + 1
            if less >= min(value, values[-1]):
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = [cost(p) for p in points[1:]]
                used += m
                continue
            trial, value = inner, less
        points[-1], values[-1] = trial, value
    return points[values.argmin()]


@dataclass
class Arima:
    """A fitted series: coefficients, mean of the differenced series, innovation variance, log-likelihood, AIC, BIC and forecasts."""

    ar: np.ndarray
    ma: np.ndarray
    seasonal_ar: np.ndarray
    seasonal_ma: np.ndarray
    mean: float
    sigma2: float
    loglik: float
    aic: float
    bic: float
    forecast: np.ndarray


def needed(order: tuple[int, int, int], seasonal: tuple[int, int, int, int] | None) -> int:
    """Values a series must have: those lost to differences, and three for each coefficient or one for each lag, whichever is more."""
    p, d, q = order
    sp, sd, sq, s = seasonal or (0, 0, 0, 1)
    return d + s * sd + max(3 * (p + q + sp + sq + 2), p + s * sp, q + s * sq) + 2


def fit_arima(y: np.ndarray, order: tuple[int, int, int], seasonal: tuple[int, int, int, int] | None, steps: int, evaluations: int = 400) -> Arima:
    """Fit by exact likelihood of the differenced series. A mean is fitted where nothing is differenced. ``y`` may hold NaN for
    missing values, though not at its end; a series too short for the order is a ValueError."""
    p, d, q = order
    sp, sd, sq, s = seasonal or (0, 0, 0, 1)
    if np.isfinite(y).sum() < needed(order, seasonal):
        raise ValueError(f"{int(np.isfinite(y).sum())} values are too few for order {order} {seasonal or ''}".strip())
    levels, x = [], y.astype(float)
    for lag in [1] * d + [s] * sd:
        levels.append((lag, x))
        x = x[lag:] - x[:-lag]
    mean, scale = (float(np.nanmean(x)) if not levels else 0.0), float(np.nanstd(x)) or 1.0
    z = (x - mean) / scale

    def unpack(free: np.ndarray):
        a, b, c, e = np.split(free[:p + q + sp + sq], np.cumsum([p, q, sp]))
        shift = free[-1] if not levels else 0.0
        return stable(a), -stable(b), stable(c), -stable(e), shift

    def filtered(free: np.ndarray) -> Filtered:
        ar, ma, sar, sma, shift = unpack(free)
        return kalman(z - shift, seasonal_product(ar, sar, s, -1.0), seasonal_product(ma, sma, s, 1.0))

    def cost(free: np.ndarray) -> float:
        got = filtered(free)
        return 0.5 * (got.n * np.log(max(got.squares / got.n, 1e-300)) + got.logs)

    filled = np.where(np.isnan(z), 0.0, z)
    start = np.zeros(p + q + sp + sq + (not levels))
    if p and len(filled) > 3 * p:
        lags = np.column_stack([filled[p - k:len(filled) - k] for k in range(1, p + 1)])
        start[:p] = unstable(np.linalg.lstsq(lags, filled[p:], rcond=None)[0])
    free = simplex_search(cost, start, evaluations)
    ar, ma, sar, sma, shift = unpack(free)
    got = filtered(free)
    sigma2 = got.squares / got.n
    loglik = -0.5 * (got.n * (np.log(2 * np.pi * max(sigma2, 1e-300)) + 1) + got.logs) - got.n * np.log(scale)
    k = len(free) + 1
    full_ar = seasonal_product(ar, sar, s, -1.0)
    size = len(got.state)
    t = np.eye(size, k=1)
    t[:len(full_ar), 0] = full_ar
    out, state = [], got.state
    for _ in range(steps):
        out.append(float(state[0]))
        state = t @ state
    out = (np.array(out) + shift) * scale + mean
    for lag, before in reversed(levels):
        level = list(before)
        for v in out:
            level.append(v + level[-lag])
        out = np.array(level[len(before):])
    return Arima(ar, ma, sar, sma, mean + shift * scale, float(sigma2 * scale * scale), float(loglik), float(2 * k - 2 * loglik), float(k * np.log(got.n) - 2 * loglik), out)

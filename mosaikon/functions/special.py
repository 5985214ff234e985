"""Tails of the usual distributions, in NumPy: incomplete beta and gamma functions by continued fractions."""

from __future__ import annotations

import math

import numpy as np


def _lgamma(x):
    return np.vectorize(math.lgamma, otypes=[float])(x)


def erfc(x):
    return np.vectorize(math.erfc, otypes=[float])(x)


def betainc(a, b, x):
    """The regularised incomplete beta function."""
    a, b, x = (np.asarray(v, float).copy() for v in np.broadcast_arrays(a, b, x))
    x = np.clip(x, 0, 1)
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
        tiny = 1e-300
        c, d = np.ones_like(z), 1 / np.where(np.abs(1 - (p + q) * z / (p + 1)) < tiny, tiny, 1 - (p + q) * z / (p + 1))
        h = d.copy()
        for m in range(1, 300):
            for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 / np.where(np.abs(1 + num * d) < tiny, tiny, 1 + num * d)
                c = np.where(np.abs(1 + num / c) < tiny, tiny, 1 + num / c)
                h = h * d * c
            if np.all(np.abs(d * c - 1) < 1e-14):
                break
    out = np.where(z <= 0, 0.0, front * h)
    return np.clip(np.where(swap, 1 - out, out), 0, 1)


def gammaincc(a, x):
    """The regularised upper incomplete gamma function."""
    a, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, x))
    out = np.ones(a.shape)
    for k in np.ndindex(a.shape):
        s, z = float(a[k]), float(x[k])
        if not z > 0:
            out[k] = 1.0 if z <= 0 else float("nan")
        elif z < s + 1:
            term = total = 1 / s
            n = s
            while abs(term) > abs(total) * 1e-15:
                n += 1
                term *= z / n
                total += term
            out[k] = 1 - total * math.exp(-z + s * math.log(z) - math.lgamma(s))
        else:
            b, c = z + 1 - s, 1e300
            d = h = 1 / b
            for i in range(1, 500):
                an = -i * (i - s)
                b += 2
                d = 1 / (an * d + b or 1e-300)
                c = b + an / c or 1e-300
                h *= d * c
                if abs(d * c - 1) < 1e-15:
                    break
            out[k] = h * math.exp(-z + s * math.log(z) - math.lgamma(s))
    return np.clip(out, 0, 1)


def normal_sf(z):
    return 0.5 * erfc(np.asarray(z, float) / math.sqrt(2))


def t_two_sided(t, df):
    t, df = np.asarray(t, float), np.asarray(df, float)
    return betainc(df / 2, 0.5, df / (df + t * t))


def f_sf(f, d1, d2):
    f = np.asarray(f, float)
    return betainc(np.asarray(d2, float) / 2, np.asarray(d1, float) / 2, d2 / (d2 + d1 * np.maximum(f, 0)))


def chi2_sf(x, df):
    return gammaincc(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def digamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out += 1 / (x * x)
        x += 1
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def exact_rank_sum(u: float, n: int, m: int) -> float:
    """Two-sided p of U under the exact null of no ties: the number of ways to each sum, by dynamic programming."""
    ways = np.zeros(n * m + 1)
    ways[0] = 1
    for k in range(1, n + 1):  # Gaussian binomial coefficients, factor by factor
        new = ways.copy()
        top = m + k
        for s in range(n * m, top - 1, -1):
            new[s] -= new[s - top]
        for s in range(k, n * m + 1):
            new[s] += new[s - k]
        ways = new
    tail = ways[int(math.ceil(max(u, n * m - u))) :].sum() / ways.sum()
    return min(1.0, 2 * tail)

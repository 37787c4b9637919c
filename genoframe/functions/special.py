"""Special functions and small tests in numpy, over whole arrays; and a Fisher test as a Spark column."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

log_gamma = np.frompyfunc(math.lgamma, 1, 1)


def _lgamma(x) -> np.ndarray:
    return np.asarray(log_gamma(x), float)


def beta_inc(a, b, x) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    inside = (z > 0) & (z < 1)
    z_safe = np.where(inside, z, 0.5)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z_safe) + q * np.log1p(-z_safe)) / p
    c = np.ones_like(p)
    d = 1 / _not_zero(1 - (p + q) * z_safe / (p + 1))
    f = d.copy()
    for m in range(1, 200):
        for t in (m * (q - m) * z_safe / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z_safe / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / _not_zero(1 + t * d)
            c = _not_zero(1 + t / c)
            f = f * c * d
    out = np.where(inside, front * f, np.where(z >= 1, 1.0, 0.0))
    return np.where(swap, 1 - out, out)


def _not_zero(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 1e-300, 1e-300, x)


def gamma_upper(s, x) -> np.ndarray:
    """The regularised upper incomplete gamma function: a series below s + 1, a continued fraction above."""
    s, x = (np.asarray(v, float) for v in np.broadcast_arrays(s, x))
    small = np.maximum(x, 1e-300)
    front = np.exp(s * np.log(small) - small - _lgamma(s))
    term = 1 / s
    total = term.copy() if isinstance(term, np.ndarray) else np.asarray(term)
    for n in range(1, 500):
        term = term * np.where(x < s + 1, x, 0) / (s + n)
        total = total + term
    c, d = np.full_like(s, 1e300), 1 / _not_zero(small + 1 - s)
    f = d.copy()
    for n in range(1, 500):
        k = -n * (n - s)
        b = small + 2 * n + 1 - s
        d = 1 / _not_zero(b + k * d)
        c = _not_zero(b + k / c)
        f = f * c * d
    return np.where(x <= 0, 1.0, np.where(x < s + 1, 1 - front * total, front * f))


def chi2_upper(x, degrees=1) -> np.ndarray:
    return gamma_upper(np.asarray(degrees, float) / 2, np.asarray(x, float) / 2)


def fisher_exact(n11: int, n12: int, n21: int, n22: int) -> float:
    """Two-sided chance of a 2 x 2 table: all tables of its margins that are not likelier."""
    row, column, n = n11 + n12, n11 + n21, n11 + n12 + n21 + n22
    k = np.arange(max(0, row + column - n), min(row, column) + 1)
    fact = lambda v: _lgamma(np.asarray(v) + 1)
    log_p = -(fact(k) + fact(row - k) + fact(column - k) + fact(n - row - column + k))
    p = np.exp(log_p - log_p.max())
    own = p[k == n11][0]
    return float(min(1.0, p[p <= own * (1 + 1e-7)].sum() / p.sum()))


def one_sided_t(n1, n2, sum1, square1, sum2, square2) -> np.ndarray:
    """Chance that the first mean is not above the second, from counts, sums and sums of squares; 1 where it is not above or there is too little."""
    n1, n2, sum1, square1, sum2, square2 = (np.asarray(v, float) for v in (n1, n2, sum1, square1, sum2, square2))
    enough = (n1 > 0) & (n2 > 0) & (n1 + n2 >= 3)
    a, b = np.where(enough, n1, 2), np.where(enough, n2, 2)
    m1, m2 = sum1 / a, sum2 / b
    v = a + b - 2
    spread = (square1 - a * m1 * m1 + square2 - b * m2 * m2) / v * (1 / a + 1 / b)
    above = enough & (m1 > m2)
    t = np.where(above, (m1 - m2) / np.sqrt(np.maximum(spread, 1e-300)), 0)
    return np.where(above, 0.5 * beta_inc(v / 2, 0.5, v / (v + t * t)), 1.0)


def minimise(f: Callable[[np.ndarray], np.ndarray], low: np.ndarray, high: np.ndarray, rounds: int = 60) -> np.ndarray:
    """The place of the least value between ``low`` and ``high``, for many functions at once.

    Parabolas through the best three points, as in Brent's method, where they fall inside
    and shrink the interval; golden sections elsewhere. ``f`` takes a place for each function.
    """
    gold = (3 - math.sqrt(5)) / 2
    a, b = low.astype(float), high.astype(float)
    x = a + gold * (b - a)
    w, v = x.copy(), x.copy()
    fx = f(x)
    fw, fv = fx.copy(), fx.copy()
    step = before = np.zeros_like(x)
    for _ in range(rounds):
        middle = (a + b) / 2
        r, q = (x - w) * (fx - fv), (x - v) * (fx - fw)
        p, q = (x - v) * q - (x - w) * r, 2 * (q - r)
        p, q = np.where(q > 0, -p, p), np.abs(q)
        good = (q > 1e-300) & (np.abs(p) < np.abs(q * before / 2)) & (p > q * (a - x)) & (p < q * (b - x))
        golden = np.where(x < middle, b - x, a - x)
        before = np.where(good, step, golden)
        step = np.where(good, p / np.where(q > 1e-300, q, 1), gold * golden)
        u = np.clip(x + np.where(np.abs(step) > 1e-10, step, np.where(step >= 0, 1e-10, -1e-10)), low, high)
        fu = f(u)
        better = fu <= fx
        a = np.where(better, np.where(u >= x, x, a), np.where(u < x, u, a))
        b = np.where(better, np.where(u >= x, b, x), np.where(u < x, b, u))
        second = ~better & ((fu <= fw) | (w == x))
        third = ~better & ~second & ((fu <= fv) | (v == x) | (v == w))
        v, fv = np.where(better | second, w, np.where(third, u, v)), np.where(better | second, fw, np.where(third, fu, fv))
        w, fw = np.where(better, x, np.where(second, u, w)), np.where(better, fx, np.where(second, fu, fw))
        x, fx = np.where(better, u, x), np.where(better, fu, fx)
    return x


@F.pandas_udf(DoubleType())
def fisher_test(n11: pd.Series, n12: pd.Series, n21: pd.Series, n22: pd.Series) -> pd.Series:
    """:func:`fisher_exact` of four counts; null where one is."""
    def one(*cells) -> float | None:
        return None if any(pd.isna(c) for c in cells) else fisher_exact(*map(int, cells))

    return pd.Series([one(*c) for c in zip(n11, n12, n21, n22)], dtype=float)

"""Tail probabilities in plain Python, for statistics that are already aggregated."""

from __future__ import annotations

import math


def chi2_sf(x: float, df: int) -> float:
    """P(chi-square with integer ``df`` > x)."""
    if x <= 0:
        return 1.0
    if df % 2:
        total, term = math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
        start = 1
    else:
        total, term = math.exp(-x / 2), x / 2 * math.exp(-x / 2)
        start = 2
    for k in range(start, df - 1, 2):
        total += term
        term *= x / (k + 2)
    return min(1.0, total)


def _beta_cf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function by Lentz's rule."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * math.copysign(1, 1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_cf(a, b, x) / a
    return 1 - front * _beta_cf(b, a, 1 - x) / b


def t_sf(t: float, df: float) -> float:
    """P(Student t with ``df`` > t)."""
    half = beta_inc(df / 2, 0.5, df / (df + t * t)) / 2
    return half if t > 0 else 1 - half


def pearson_p(r: float, n: int) -> float:
    """Two-sided p of a correlation of n pairs."""
    if n < 3:
        return 1.0
    if abs(r) >= 1:
        return 0.0
    return 2 * t_sf(abs(r) * math.sqrt((n - 2) / (1 - r * r)), n - 2)

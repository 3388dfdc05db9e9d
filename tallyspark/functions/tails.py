"""Tail probabilities as Columns: incomplete gamma and beta functions by series and continued fractions, folded by ``aggregate``.

They stay inside Spark's expressions, so p-values can be taken of statistics by any number of groups. Null or NaN arguments give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of a series or fraction. Series are used below a + 1 and fractions beyond, where they settle long before.
TERMS = 600
#: Fixed values of Lanczos' approximation of the gamma function (g = 7).
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
_TINY = 1e-300


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def log_gamma(x: str | Column) -> Column:
    """Logarithm of the gamma function of a positive number."""
    z = _col(x).cast("double") - 1
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (z + i)
    t = z + 7.5
    return 0.9189385332046727 + (z + 0.5) * F.log(t) - t + F.log(total)


def _steps() -> Column:
    return F.sequence(F.lit(1), F.lit(TERMS))


def _away(x: Column) -> Column:
    return F.when(F.abs(x) < _TINY, F.lit(_TINY)).otherwise(x)


def gamma_tail(a: str | Column, x: str | Column) -> Column:
    """Regularised upper incomplete gamma function Q(a, x) for a > 0; 1 for x <= 0."""
    a, x = _col(a).cast("double"), _col(x).cast("double")
    front = F.exp(a * F.log(x) - x - log_gamma(a))

    def add(acc, n):
        term = acc["t"] * x / (a + n)
        return F.struct(term.alias("t"), (acc["s"] + term).alias("s"))

    series = F.aggregate(_steps(), F.struct((1 / a).alias("t"), (1 / a).alias("s")), add, lambda acc: acc["s"])

    def go(acc, i):
        # Lentz's rule; b grows by 2 a step
        n, b = -i * (i - a), x + 1 - a + 2 * i
        d, c = 1 / _away(n * acc["d"] + b), _away(b + n / acc["c"])
        return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * c * d).alias("h"))

    first = 1 / _away(x + 1 - a)
    fraction = F.aggregate(_steps(), F.struct(F.lit(1 / _TINY).alias("c"), first.alias("d"), first.alias("h")), go, lambda acc: acc["h"])
    found = F.when(x < a + 1, 1 - front * series).otherwise(front * fraction)
    return F.when(a.isNull() | x.isNull() | F.isnan(a) | F.isnan(x), F.lit(None)).when(x <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), found)))


def beta_share(a: str | Column, b: str | Column, x: str | Column) -> Column:
    """Regularised incomplete beta function I_x(a, b) for a, b > 0; 0 below 0 and 1 above 1."""
    a, b, x = (_col(v).cast("double") for v in (a, b, x))
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x))

    def fraction(a, b, x):
        first = 1 / _away(1 - (a + b) * x / (a + 1))

        def go(acc, k):
            i = k + 1
            m = F.floor(i / 2)
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            n = F.when(i % 2 == 0, even).otherwise(odd)
            d, c = 1 / _away(1 + n * acc["d"]), _away(1 + n / acc["c"])
            return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * c * d).alias("h"))

        return F.aggregate(_steps(), F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h")), go, lambda acc: acc["h"])

    found = F.when(x < (a + 1) / (a + b + 2), front * fraction(a, b, x) / a).otherwise(1 - front * fraction(b, a, 1 - x) / b)
    null = a.isNull() | b.isNull() | x.isNull() | F.isnan(a) | F.isnan(b) | F.isnan(x)
    return F.when(null, F.lit(None)).when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), found)))


def chi2_p(x: str | Column, df: str | Column) -> Column:
    """P(chi-square > x); 1 without degrees of freedom."""
    d = _col(df).cast("double")
    return F.when(d <= 0, F.lit(1.0)).otherwise(gamma_tail(d / 2, _col(x) / 2))


def t_p(t: str | Column, df: str | Column) -> Column:
    """Two-sided p of Student's t; null without degrees of freedom."""
    t, d = _col(t).cast("double"), _col(df).cast("double")
    return F.when(d > 0, beta_share(d / 2, F.lit(0.5), d / (d + t * t)))


def correlation_p(r: str | Column, n: str | Column) -> Column:
    """Two-sided p of a correlation of n pairs; 1 under three pairs, 0 of a perfect one."""
    r, n = _col(r).cast("double"), _col(n).cast("double")
    return F.when(r.isNull() | F.isnan(r), F.lit(None)).when(n < 3, F.lit(1.0)).when(F.abs(r) >= 1, F.lit(0.0)).otherwise(beta_share((n - 2) / 2, F.lit(0.5), 1 - r * r))

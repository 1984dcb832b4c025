"""Distribution functions that tests need on the driver, from the standard library alone."""

from __future__ import annotations

import math
from statistics import NormalDist

NORMAL = NormalDist()


def gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its series or its continued fraction."""
    if x <= 0:
        return 0.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return total * scale
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - scale * h


def chi2_sf(x: float, df: float) -> float:
    return 1 - gamma_p(df / 2, x / 2)


def _bisect(f, lo: float, hi: float) -> float:
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def chi2_ppf(p: float, df: float) -> float:
    return _bisect(lambda x: 1 - chi2_sf(x, df) - p, 0, df + 40 * math.sqrt(2 * df) + 40)


def beta_i(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, h = 1e-300, 1.0, 0.0, 1.0
    for i in range(2000):
        m = i // 2
        num = 1.0 if i == 0 else (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        d = 1 / ((1 + num * d) or tiny)
        c = (1 + num / c) or tiny
        h *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (h - 1)


def t_cdf(t: float, df: float) -> float:
    tail = beta_i(df / 2, 0.5, df / (df + t * t)) / 2
    return 1 - tail if t > 0 else tail


def t_ppf(p: float, df: float) -> float:
    return _bisect(lambda x: t_cdf(x, df) - p, -1e6, 1e6)


def ks_sf(statistic: float, n: float, m: float) -> float:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value."""
    x = statistic * math.sqrt(n * m / (n + m))
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * x) ** 2) for k in range(1, 101))))


def _bessel_k_quarter(z: float) -> float:
    """The modified Bessel function of the second kind of order 1/4, by the trapezoidal rule on its integral, which converges fast."""
    step, total, t = 0.02, 0.5, 0.0
    while True:
        t += step
        term = math.exp(-z * (math.cosh(t) - 1)) * math.cosh(t / 4)
        total += term
        if term < 1e-17 * total:
            return total * step * math.exp(-z)


def cvm_cdf(x: float) -> float:
    """The limiting distribution function of the Cramer-von Mises statistic (Csorgo and Faraway, 1996)."""
    if x <= 0:
        return 0.0
    total = 0.0
    for k in range(200):
        y = 4 * k + 1
        z = y * y / (16 * x)
        if z > 350:
            break
        term = math.exp(math.lgamma(k + 0.5) - math.lgamma(k + 1)) / (math.pi**1.5 * math.sqrt(x)) * math.sqrt(y) * math.exp(-z) * _bessel_k_quarter(z)
        total += term
        if abs(term) < 1e-12:
            break
    return min(1.0, total)


def cvm_sf(statistic: float, n: int, m: int) -> float:
    """p-value of the two-sample Cramer-von Mises statistic: its mean and variance for samples of ``n`` and ``m`` (Anderson, 1962) brought to those of the limit."""
    both, k = n + m, n * m
    mean = (1 + 1 / both) / 6
    variance = (both + 1) * (4 * k * both - 3 * (n * n + m * m) - 2 * k) / (45 * both * both * 4 * k)
    if variance <= 0:
        return 1.0
    return 1 - cvm_cdf(1 / 6 + (statistic - mean) / math.sqrt(45 * variance))


# Coefficients of the limiting distribution of the Anderson-Darling statistic (Marsaglia and Marsaglia, 2004).
_ANDERSON_LOW = (2.00012, 0.247105, -0.0649821, 0.0347962, -0.0116720, 0.00168691)
_ANDERSON_HIGH = (1.0776, -2.30695, 0.43424, -0.082433, 0.008056, -0.0003146)


def anderson_sf(statistic: float) -> float:
    """Limiting p-value of the Anderson-Darling statistic, of one sample or of two."""
    if statistic <= 0:
        return 1.0
    if statistic < 2:
        series = sum(c * statistic**i for i, c in enumerate(_ANDERSON_LOW))
        return 1 - math.exp(-1.2337141 / statistic) / math.sqrt(statistic) * series
    return 1 - math.exp(-math.exp(sum(c * statistic**i for i, c in enumerate(_ANDERSON_HIGH))))

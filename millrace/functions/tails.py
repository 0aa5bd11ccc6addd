"""Tail probabilities and quantiles of the normal, t, F, chi-square and Kolmogorov distributions.

Applied to result rows on the driver or in pandas of a few rows, never to data.
"""

from __future__ import annotations

import math

import numpy as np


def normal_sf(z: float) -> float:
    """P(Z > z)."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 1000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * value


def gamma_sf(a: float, x: float) -> float:
    """The upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    value = d
    for i in range(1, 1000):
        top = -i * (i - a)
        b += 2
        d = 1 / ((top * d + b) or tiny)
        c = (b + top / c) or tiny
        value *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * value


def t_sf(t: float, df: float) -> float:
    """Two-sided P(|T| > |t|)."""
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def f_sf(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    return 1.0 if f <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if math.isfinite(f) else 0.0


def chi2_sf(x: float, df: float) -> float:
    """P(X > x)."""
    return gamma_sf(df / 2, x / 2)


def kolmogorov_sf(x: float) -> float:
    """P(K > x) of the limiting distribution."""
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def quantile(sf, p: float, low: float, high: float) -> float:
    """The point at which a decreasing tail function is p, by bisection."""
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sf(mid) > p else (low, mid)
    return (low + high) / 2


def t_quantile(alpha: float, df: float) -> float:
    """The two-sided critical value of the t distribution."""
    return quantile(lambda t: t_sf(t, df), alpha, 0.0, 1e6)


def normal_quantile(alpha: float) -> float:
    """The two-sided critical value of the normal distribution."""
    return quantile(lambda z: 2 * normal_sf(z), alpha, 0.0, 40.0)


def range_sf(q: float, k: int, df: float) -> float:
    """P(Q > q) of the studentised range of k means, by Gauss and Legendre's quadrature over the spread and the least mean."""
    if q <= 0:
        return 1.0
    x, w = np.polynomial.legendre.leggauss(96)
    z, zw = 9 * x, 9 * w
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cdf = lambda v: 0.5 * np.vectorize(math.erfc)(-v / math.sqrt(2))
    # the spread is a chi variable over the root of its degrees of freedom
    wide = 10 / math.sqrt(2 * df) if df > 12 else 4.0
    low, high = max(1e-9, 1 - wide), 1 + wide
    s, sw = (high - low) / 2 * x + (high + low) / 2, (high - low) / 2 * w
    density = np.exp(df / 2 * math.log(df / 2) + math.log(2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2)
    inner = np.array([k * np.sum(zw * phi * np.maximum(cdf(z) - cdf(z - q * t), 0) ** (k - 1)) for t in s])
    return float(min(1.0, max(0.0, 1 - np.sum(sw * density * inner))))


def mixed_over_poisson(mean: float, tail) -> float:
    """The mean of tail(j) over a Poisson variable j."""
    middle = int(mean)
    reach = int(12 * math.sqrt(mean) + 30)
    return sum(math.exp(-mean + j * math.log(mean) - math.lgamma(j + 1)) * tail(j) for j in range(max(0, middle - reach), middle + reach)) if mean > 0 else tail(0)


def noncentral_chi2_power(df: float, noncentrality: float, alpha: float = 0.05) -> float:
    """The chance that a chi-square statistic with this noncentrality is above the critical value."""
    critical = quantile(lambda x: chi2_sf(x, df), alpha, 0.0, 1e7)
    return min(1.0, mixed_over_poisson(noncentrality / 2, lambda j: chi2_sf(critical, df + 2 * j)))


def noncentral_f_power(d1: float, d2: float, noncentrality: float, alpha: float = 0.05) -> float:
    """The chance that an F statistic with this noncentrality is above the critical value."""
    critical = quantile(lambda f: f_sf(f, d1, d2), alpha, 0.0, 1e7)
    x = d1 * critical / (d1 * critical + d2)
    return min(1.0, mixed_over_poisson(noncentrality / 2, lambda j: 1 - beta_inc(d1 / 2 + j, d2 / 2, x)))

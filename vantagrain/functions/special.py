"""Distribution functions that neither Spark nor the standard library has.

All take and return floats on the driver; they are applied to summaries of a
few numbers, never to rows.
"""

from __future__ import annotations

import math
from statistics import NormalDist

_NORMAL = NormalDist()


def norm_cdf(x: float) -> float:
    return _NORMAL.cdf(x)


def norm_ppf(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:  # power series
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return min(1.0, total * front)
    tiny = 1e-300  # continued fraction for the upper tail
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return max(0.0, 1 - front * h)


def chi2_sf(x: float, df: float) -> float:
    return 1.0 if x <= 0 else 1 - gamma_p(df / 2, x / 2)


def chi2_ppf(p: float, df: float) -> float:
    return _invert(lambda x: gamma_p(df / 2, x / 2), p, 0.0, max(10.0, 10 * df))


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * beta_i(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def t_ppf(p: float, df: float) -> float:
    if p < 0.5:
        return -t_ppf(1 - p, df)
    return _invert(lambda x: t_cdf(x, df), p, 0.0, 10.0)


def _invert(cdf, p: float, lo: float, hi: float) -> float:
    """The point at which an increasing function reaches p, by bisection."""
    while cdf(hi) < p:
        lo, hi = hi, 2 * hi
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
        if hi - lo <= 1e-15 * max(1.0, abs(hi)):
            break
    return (lo + hi) / 2


def kolmogorov_sf(x: float) -> float:
    """Tail of the limit distribution of the scaled two-sample KS statistic."""
    if x <= 0:
        return 1.0
    if x < 1:  # the dual series converges faster here
        s = sum(math.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * x * x)) for k in range(1, 40))
        return 1 - math.sqrt(2 * math.pi) / x * s
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def wilson(successes: float, n: float, level: float = 0.95) -> tuple[float, float]:
    """Wilson interval of a share; (0, 1) without trials."""
    if n <= 0:
        return 0.0, 1.0
    z = norm_ppf(0.5 + level / 2)
    p = successes / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return max(0.0, mid - half), min(1.0, mid + half)


def residual_risk(attack: float, control: float) -> float:
    """Share of the attack's success beyond what the control explains."""
    return 0.0 if control >= 1 else max(0.0, (attack - control) / (1 - control))


def neg_binomial_pmf(k: int, size: float, prob: float) -> float:
    return math.exp(math.lgamma(k + size) - math.lgamma(size) - math.lgamma(k + 1) + size * math.log(prob) + k * math.log1p(-prob))

"""Tail probabilities of the t, F, chi-square and normal distributions.

Used on result-sized numbers only (one per regression term or rule), so plain
Python is enough. Regularised incomplete beta and gamma functions by their
continued fractions.
"""

from __future__ import annotations

import math
from statistics import NormalDist

_TINY = 1e-300
_EPS = 1e-15


def _lentz(terms, start: float) -> float:
    """Evaluate start + a1/(b1 + a2/(b2 + ...)) from the pairs (a, b)."""
    f = start or _TINY
    c, d = f, 0.0
    for a, b in terms:
        d = b + a * d or _TINY
        c = b + a / c or _TINY
        d = 1.0 / d
        step = c * d
        f *= step
        if abs(step - 1.0) < _EPS:
            break
    return f


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_inc(b, a, 1.0 - x)
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )

    def terms():
        for m in range(1, 5000):
            k = m // 2
            if m % 2:
                yield -(a + k) * (a + b + k) * x / ((a + m - 1) * (a + m)), 1.0
            else:
                yield k * (b - k) * x / ((a + m - 1) * (a + m)), 1.0

    return math.exp(log_front) / a / _lentz(terms(), 1.0)


def gamma_sf(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        for n in range(1, 10_000):
            term *= x / (a + n)
            total += term
            if term < total * _EPS:
                break
        return 1.0 - front * total
    terms = ((-n * (n - a), x + 2 * n + 1.0 - a) for n in range(1, 10_000))
    return front / _lentz(terms, x + 1.0 - a)


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|) of Student's t."""
    if df <= 0 or math.isnan(t):
        return math.nan
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def f_sf(f: float, df1: float, df2: float) -> float:
    """P(F > f)."""
    if df1 <= 0 or df2 <= 0 or math.isnan(f):
        return math.nan
    if f <= 0:
        return 1.0
    return beta_inc(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f))


def chi2_sf(x: float, df: float) -> float:
    return gamma_sf(df / 2.0, x / 2.0)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def fisher_greater(both: int, covered: int, positive: int, total: int) -> float:
    """One-sided exact test: P(at least ``both`` positives among ``covered`` draws).

    The hypergeometric tail is summed outwards from ``both`` by the ratio of
    neighbouring terms, so large counts need no factorials.
    """
    if both <= max(0, covered + positive - total):
        return 1.0
    top = min(covered, positive)

    def log_choose(n, k):
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    mean = covered * positive / total
    if both <= mean:  # the long side: one minus the lower tail
        low = max(0, covered + positive - total)
        k = both - 1
        term = math.exp(
            log_choose(positive, k) + log_choose(total - positive, covered - k)
            - log_choose(total, covered)
        )
        lower = 0.0
        while k >= low and term > lower * 1e-17:
            lower += term
            term *= k * (total - positive - covered + k) / ((positive - k + 1) * (covered - k + 1))
            k -= 1
        return max(0.0, min(1.0, 1.0 - lower))
    k = both
    term = math.exp(
        log_choose(positive, k) + log_choose(total - positive, covered - k)
        - log_choose(total, covered)
    )
    upper = 0.0
    while k <= top and term > upper * 1e-17:
        upper += term
        term *= (positive - k) * (covered - k) / ((k + 1) * (total - positive - covered + k + 1))
        k += 1
    return min(1.0, upper)

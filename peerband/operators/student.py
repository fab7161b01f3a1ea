"""Tail and quantile of Student's t, for the handful of model coefficients."""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 10_000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return total


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    scale = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return scale * _beta_fraction(a, b, x) / a
    return 1.0 - scale * _beta_fraction(b, a, 1.0 - x) / b


def two_sided_p(t: float, df: float) -> float:
    """P(|T| > |t|)."""
    return beta_share(df / 2.0, 0.5, df / (df + t * t))


def critical_value(df: float, confidence: float = 0.95) -> float:
    """t with P(|T| > t) = 1 - confidence, by bisection."""
    low, high = 0.0, 1.0
    while two_sided_p(high, df) > 1.0 - confidence:
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        if two_sided_p(mid, df) > 1.0 - confidence:
            low = mid
        else:
            high = mid
        if high - low < 1e-13 * high:
            break
    return (low + high) / 2.0

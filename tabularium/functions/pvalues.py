"""Closed-form p-values for the handful of scalar test statistics an aggregate yields."""

from __future__ import annotations

import math


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi2_one_df(x: float) -> float:
    return math.erfc(math.sqrt(max(x, 0.0) / 2.0))


def kolmogorov(d: float, n: float, m: float) -> float:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value."""
    if d <= 0:
        return 1.0
    lam = d * math.sqrt(n * m / (n + m))
    total = sum((-1) ** (k - 1) * math.exp(-2.0 * (k * lam) ** 2) for k in range(1, 101))
    return min(1.0, max(0.0, 2.0 * total))


def student_t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|) by numerical integration of the density in the angle variable.

    With t = sqrt(df)*tan(a) the tail is an integral of cos(a)^(df-1), smooth on a finite range.
    """
    if df <= 0 or math.isnan(t):
        return float("nan")
    if df > 1e6:
        return normal_two_sided(t)
    start = math.atan(abs(t) / math.sqrt(df))
    steps = 2000
    width = (math.pi / 2 - start) / steps
    heights = [math.cos(start + i * width) ** (df - 1) if i < steps else (1.0 if df == 1 else 0.0) for i in range(steps + 1)]
    simpson = heights[0] + heights[-1] + 4 * sum(heights[1:-1:2]) + 2 * sum(heights[2:-1:2])
    constant = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return min(1.0, 2.0 * constant * simpson * width / 3)

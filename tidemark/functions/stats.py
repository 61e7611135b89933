"""Tails, quantiles and sample sizes from closed forms; scalars, for results of a few rows."""

from __future__ import annotations

import math
from statistics import NormalDist

NORMAL = NormalDist()


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c = 1e-300, 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 1000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised: I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) and df > 0 else math.nan


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def required_sample_size(effect: float, sd: float, power: float = 0.8, alpha: float = 0.05, variance_inflation: float | None = None, icc: float = 0.0, cluster_size: float = 1.0) -> float:
    """Events, both arms together, that find ``effect`` with the power. Clustering enters as a measured inflation of the
    variance or, without one, as the design effect of clusters of a size with an intra-cluster correlation."""
    if effect == 0 or sd <= 0:
        return math.inf
    if variance_inflation is None:
        variance_inflation = 1 + (cluster_size - 1) * icc
    z = NORMAL.inv_cdf(1 - alpha / 2) + NORMAL.inv_cdf(power)
    return 2 * (2 * (z * sd / effect) ** 2) * variance_inflation


def achieved_power(effect: float, se: float, alpha: float = 0.05) -> float:
    """Chance that another sample of this design rejects; NaN where the effect or its error is not finite, or there is none."""
    if not (math.isfinite(effect) and math.isfinite(se) and se > 0):
        return math.nan
    return NORMAL.cdf(abs(effect) / se - NORMAL.inv_cdf(1 - alpha / 2))


def effective_sample_size(n: int, cluster_sizes: list[int], icc: float) -> float:
    """What n clustered events are worth in independent ones; 0 of nothing."""
    if not n or not cluster_sizes:
        return 0.0
    return n / max(1 + (sum(cluster_sizes) / len(cluster_sizes) - 1) * icc, 1e-9)

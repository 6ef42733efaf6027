"""Special functions as Spark expressions."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def lgamma(x: Column, shift: int = 8) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series at ``x + shift``, less the logarithms of the steps there."""
    z = x + shift
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    steps = x
    for k in range(1, shift):
        steps = steps * (x + k)
    return series - F.log(steps)


def log_binomial(n: Column, k: Column) -> Column:
    """Logarithm of n over k; 0 where k is not below n."""
    n, k = n.cast("double"), k.cast("double")
    return F.when(k >= n, 0.0).otherwise(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1))


def log_factorial(n: Column) -> Column:
    return lgamma(n.cast("double") + 1)


def xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(0.0)


EXACT = 300_000  # steps of the recurrence


def _tilted(m: int, n: int) -> tuple[float, float]:
    """``t`` where parts weighted by ``exp(-t * part)`` have the mean sum ``m``, and the variance of the sum there: Newton's steps in a bracket that halves where they leave it."""

    def moments(t: float) -> tuple[float, float]:
        k = np.arange(1, min(n, int(700 / t) + 1) + 1, dtype=np.float64)
        w = 1 / np.expm1(k * t)
        return float((k * w).sum()), float((k * k * w * (1 + w)).sum())

    low, high = n / (m + n * (n + 1) / 2), math.pi / math.sqrt(m)
    low, high = min(low, high) / 2, max(low, high) * 2
    t = math.sqrt(low * high)
    for _ in range(100):
        mean, variance = moments(t)
        low, high = (t, high) if mean > m else (low, t)
        step = t + (mean - m) / variance
        last, t = t, step if low < step < high else (low + high) / 2
        if abs(t - last) < 1e-13 * t:
            break
    return t, moments(t)[1]


@lru_cache(maxsize=1 << 16)
def log_partitions(m: int, n: int, exact_to: int = 0) -> float:
    """Logarithm of the number of partitions of m into at most n parts.

    By the recurrence over largest parts where that takes ``EXACT`` steps at most, or m is ``exact_to`` at most. Otherwise it is the number of ways to sum
    1 to n, each any number of times, to m: the saddle point of their generating function, where the sum has mean m and is nearly normal.
    """
    if m <= 0 or n <= 0:
        return 0.0 if m == 0 else -math.inf
    n = min(n, m)
    if n == 1:
        return 0.0
    if m * n <= EXACT or m <= exact_to:
        ways = [1] + [0] * m
        for part in range(1, n + 1):
            for total in range(part, m + 1):
                ways[total] += ways[total - part]
        return math.log(ways[m])
    if n == 2:
        return math.log(m // 2 + 1)
    t, variance = _tilted(m, n)
    k = np.arange(1, min(n, int(700 / t) + 1) + 1, dtype=np.float64)
    return m * t - float(np.log(-np.expm1(-k * t)).sum()) - 0.5 * math.log(2 * math.pi * variance)

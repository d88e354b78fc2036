"""Tail probabilities on the driver for the handful of statistics a report holds: incomplete beta and gamma functions."""

from __future__ import annotations

from math import exp, lgamma, log, sqrt


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d or tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / ((1.0 + num * d) or tiny)
            c = (1.0 + num / c) or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def gamma_inc_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = out = 1.0 / a
        k = a
        while abs(term) > abs(out) * 1e-16:
            k += 1
            term *= x / k
            out += term
        return 1.0 - out * exp(-x + a * log(x) - lgamma(a))
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * exp(-x + a * log(x) - lgamma(a))


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_upper(x: float, df: float) -> float:
    return gamma_inc_upper(df / 2, x / 2)


def f_quantile(p: float, d1: float, d2: float) -> float:
    """The value that an F variate stays below with probability ``p``, by bisection."""
    low, high = 0.0, 1.0
    while 1 - f_upper(high, d1, d2) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - f_upper(mid, d1, d2) < p else (low, mid)
    return (low + high) / 2


def normal_quantile(p: float) -> float:
    """Inverse of the normal distribution by bisection on its tail."""
    from math import erfc

    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.5 * erfc(-mid / sqrt(2)) < p else (low, mid)
    return (low + high) / 2

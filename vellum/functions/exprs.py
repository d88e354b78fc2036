"""Column builders shared by the operators: guarded arithmetic, distributions and portable hashing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, low: float, high: float) -> Column:
    """``c`` limited to [low, high]; NULL stays NULL and NaN stays NaN, which bare least/greatest would turn into a bound."""
    return F.when(F.isnan(c.cast("double")) | c.isNull(), c).otherwise(F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL for a zero denominator."""
    return F.try_divide(a, b)


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Product-moment correlation from sums; NULL for a constant input, where bare ``corr`` raises."""
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    # sums of squares of a constant leave rounding noise: relative to their size it counts as no variance
    flat = (vx <= 1e-12 * sxx) | (vy <= 1e-12 * syy)
    return F.when(flat, None).otherwise(ratio(sxy - sx * sy / n, F.sqrt(vx) * F.sqrt(vy)))


def pearson_agg(x: Column, y: Column, w: Column | None = None) -> Column:
    """Aggregate: correlation of the rows where both are present, with integer weights if given."""
    both = x.isNotNull() & y.isNotNull()
    w = F.when(both, F.lit(1.0) if w is None else w.cast("double"))
    return pearson(F.sum(w), F.sum(w * x), F.sum(w * y), F.sum(w * x * x), F.sum(w * y * y), F.sum(w * x * y))


def erf(x: Column) -> Column:
    """Error function to about 1e-15: Taylor series near zero, continued fraction of the complement beyond."""
    a = F.abs(x)
    square = a * a
    series = F.lit(0.0)
    for n in reversed(range(1, 40)):
        series = 2.0 * square / (2 * n + 1) * (1.0 + series)
    near = 1.1283791670955126 * a * F.exp(-square) * (1.0 + series)
    fraction = a
    for n in reversed(range(1, 40)):
        fraction = a + (n / 2.0) / fraction
    far = 1.0 - F.exp(-square) / (1.7724538509055159 * fraction)
    return F.signum(x) * F.when(a < 2.5, near).when(a < 6.0, far).otherwise(1.0)


def normal_cdf(z: Column) -> Column:
    return 0.5 * (1.0 + erf(z / 1.4142135623730951))


def hash_int(key: Column) -> Column:
    """The first eight hex digits of MD5 as an integer in [0, 2^32): the same in every engine."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")


def hash_uniform(key: Column) -> Column:
    return hash_int(key) / F.lit(4294967296.0)


def stable_seed(payload: Column) -> Column:
    """32-bit seed of a canonical payload: the first four SHA-256 bytes, big-endian, independent of process and engine."""
    return F.conv(F.substring(F.sha2(payload.cast("binary"), 256), 1, 8), 16, 10).cast("bigint")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; NULL for a zero vector."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return ratio(dot, norm(a) * norm(b))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def logistic_scale(positive: Column, negative: Column) -> Column:
    """Two prompt scores squashed to a rating of 1 to 7."""
    return 6.0 / (1.0 + F.exp(-5.0 * (positive - negative))) + 1.0


def softmax_scale(a: Column, b: Column) -> Column:
    """The share of ``a`` in the softmax of two scores, as a rating of 1 to 7."""
    return 6.0 / (1.0 + F.exp(b - a)) + 1.0


def entropy_from_counts(counts: Column, epsilon: float = 1e-10) -> Column:
    """Shannon entropy in nats of an array of counts, smoothed by ``epsilon`` per bin and renormalised."""
    smooth = F.transform(counts, lambda c: c.cast("double") + epsilon)
    whole = F.aggregate(smooth, F.lit(0.0), lambda s, c: s + c)
    return -F.aggregate(smooth, F.lit(0.0), lambda s, c: s + c / whole * F.ln(c / whole))

"""Column builders: keyed uniforms, log-sum-exp, the gamma family, the Jukes-Cantor kernel, entropies."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_uniform(*keys: Column | str | int) -> Column:
    """A uniform in [0, 1) that depends on the keys alone: the first 32 bits of the md5 of the keys, joined by colons."""
    text = F.concat_ws(":", *(k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform_sql(*keys: str) -> str:
    """The same uniform for DuckDB; keys are SQL expressions."""
    joined = "concat_ws(':', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in keys) + ")"
    return f"(CAST('0x' || substr(md5({joined}), 1, 8) AS UBIGINT) / 4294967296.0::DOUBLE)"


def logsumexp(x: Column, top: Column) -> Column:
    """log(sum(exp(x))) as an aggregate, given the group's maximum ``top``; -inf where all of x is -inf."""
    return F.when(F.first(top) == float("-inf"), F.lit(float("-inf"))).otherwise(F.first(top) + F.log(F.sum(F.exp(x - top))))


def jc_same(t: Column, k: int = 4) -> Column:
    """The Jukes-Cantor probability to end in the same of ``k`` states after branch length ``t``."""
    return F.lit(1.0 / k) + F.lit((k - 1.0) / k) * F.exp(-t * (k / (k - 1.0)))


def jc_other(t: Column, k: int = 4) -> Column:
    """The probability to end in one given other state."""
    return F.lit(1.0 / k) - F.lit(1.0 / k) * F.exp(-t * (k / (k - 1.0)))


def jc_distance(p: Column, k: int = 4) -> Column:
    """The distance at which a share ``p`` of sites differs; infinite at or beyond saturation."""
    b = (k - 1.0) / k
    return F.when(p >= b, F.lit(float("inf"))).otherwise(-b * F.log(1 - p / b))


def binary_entropy(p: Column) -> Column:
    """In bits; 0 at 0 and 1."""
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(-(p * F.log(p) + (1 - p) * F.log(1 - p)) / math.log(2))


def _bound(x: Column, f) -> Column:  # noqa: ANN001
    """``f(x)`` with x computed once, however often f reads it."""
    return F.transform(F.array(x), f)[0]


def _series(coefficients: tuple[float, ...], z: Column) -> Column:
    """The sum of coefficients[k] * z ** k."""
    out = F.lit(coefficients[-1])
    for c in coefficients[-2::-1]:
        out = out * z + F.lit(c)
    return out


def log_gamma(x: Column) -> Column:
    """log of the gamma function for x > 0, to double precision and of any size: Stirling's series from 10 on, and the
    recurrence below. Null for null, infinite at 0; nan below."""

    def told(v: Column) -> Column:
        up = F.when(v < 10, v + 10).otherwise(v)
        rising = F.lit(1.0)
        for k in range(10):
            rising = rising * (v + k)
        tail = lambda w: (w - 0.5) * F.log(w) - w + 0.5 * math.log(2 * math.pi) + _series((1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156), 1 / (w * w)) / w
        return F.when(v < 0, F.lit(float("nan"))).when(v == 0, F.lit(float("inf"))).otherwise(_bound(up, tail) - F.when(v < 10, F.log(rising)).otherwise(0.0))

    return _bound(x.cast("double"), told)


def digamma(x: Column) -> Column:
    """The derivative of ``log_gamma`` for x > 0."""

    def told(v: Column) -> Column:
        low = v < 10
        below = sum((1 / (v + k) for k in range(1, 10)), 1 / v)
        tail = lambda w: F.log(w) - 0.5 / w - _series((1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132, -691 / 32760, 1 / 12), 1 / (w * w)) / (w * w)
        return _bound(F.when(low, v + 10).otherwise(v), tail) - F.when(low, below).otherwise(0.0)

    return _bound(x.cast("double"), told)


def trigamma(x: Column) -> Column:
    """The derivative of ``digamma`` for x > 0."""

    def told(v: Column) -> Column:
        low = v < 10
        below = sum((1 / ((v + k) * (v + k)) for k in range(1, 10)), 1 / (v * v))
        tail = lambda w: 1 / w + 0.5 / (w * w) + _series((1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730, 7 / 6), 1 / (w * w)) / (w * w * w)
        return _bound(F.when(low, v + 10).otherwise(v), tail) + F.when(low, below).otherwise(0.0)

    return _bound(x.cast("double"), told)

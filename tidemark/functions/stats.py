"""Student's t by the regularised incomplete beta function, which Spark doesn't have: as column expressions, and in Python."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (Lentz's method)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    f = d
    for m in range(1, 1000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + term * d) or tiny)
            c = (1 + term / c) or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def student_two_sided(r: float | None, n: int) -> float | None:
    """p-value of a correlation r of n pairs; null where r is missing or n is below 3, 0 for a perfect one."""
    if r is None or math.isnan(r) or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    t2 = r * r * df / (1 - r * r)
    return incomplete_beta(df / 2, 0.5, df / (df + t2))


def _gamma_ratio(a: Column) -> Column:
    """Gamma(a + 1/2) / Gamma(a): the asymptotic series at a + 30, taken back by the recurrence."""
    y = a + 30
    out = F.sqrt(y) * (1 - 1 / (8 * y) + 1 / (128 * y * y) + 5 / (1024 * y * y * y) - 21 / (32768 * y * y * y * y))
    for i in range(30):
        out = out * (a + i) / (a + i + 0.5)
    return out


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function by Lentz's method; it takes about the root of the larger parameter in steps."""

    def step(s: Column, i: Column) -> Column:
        m = F.floor(i / 2)
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        term = F.when(i % 2 == 0, even).otherwise(odd)
        d, c = 1 / (1 + term * s["d"]), 1 + term / s["c"]
        return F.struct(c.alias("c"), d.alias("d"), (s["f"] * c * d).alias("f"))

    first = 1 / (1 - (a + b) * x / (a + 1))
    steps = F.sequence(F.lit(2), F.ceil(100 + 6 * F.sqrt(F.greatest(a, b))).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("f")), step)["f"]


def two_sided(r: Column, n: Column) -> Column:
    """student_two_sided as an expression: the regularised incomplete beta function of 1 - r^2 with (n - 2) / 2 and 1/2."""
    df = (n - 2).cast("double")
    x = 1 - r * r
    turned = x > (df / 2 + 1) / (df / 2 + 2.5)
    a, b, z = F.when(turned, 0.5).otherwise(df / 2), F.when(turned, df / 2).otherwise(0.5), F.when(turned, r * r).otherwise(x)
    front = _gamma_ratio(df / 2) / math.sqrt(math.pi) * F.exp(df / 2 * F.log(x) + F.log(F.abs(r))) / a
    part = front * _fraction(a, b, z)
    p = F.when(turned, 1 - part).otherwise(part)
    return F.when(r.isNull() | F.isnan(r) | (n < 3), F.lit(None).cast("double")).when(F.abs(r) >= 1, 0.0).when(r == 0, 1.0).otherwise(p)

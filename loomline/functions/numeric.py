"""Numeric expressions that keep their rounding and stability rules in one place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log2cosh(x: Column) -> Column:
    """log(2 cosh x) without overflow."""
    return F.abs(x) + F.log1p(F.exp(-2.0 * F.abs(x)))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def log_sigmoid(z: Column) -> Column:
    return F.least(z, F.lit(0.0)) - F.log1p(F.exp(-F.abs(z)))


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounded half up, with a slack of 1e-6 of the last digit."""
    s = float(10**digits)
    return F.floor(x * s + 0.5 + 1e-6) / s


def half_away(x: Column, digits: int = 0) -> Column:
    """Rounded as DuckDB's ``round`` does: the product with the power of ten, a double, goes half away from zero.

    Spark's ``round`` goes by the decimal digits instead, so 323 / 640 = 0.5046875 ends in 8 there and in 7 here.
    """
    s = float(10**digits)
    return F.round(x * s) / s


def half_even_clamped(x: Column, low: int = 0, high: int = 10) -> Column:
    return F.greatest(F.least(F.bround(x, 0), F.lit(float(high))), F.lit(float(low))).cast("int")


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return F.log(q / (1.0 - q))


def bin_index(p: Column, bins: int = 10) -> Column:
    """Equal-width bin of a probability; edges are the doubles ``i * (1 / bins)``, so 0.3 lies in bin 2."""
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    return sum(((p >= F.lit(e)).cast("int") for e in edges[1:]), (p >= F.lit(edges[0])).cast("int"))


def guarded_corr(x: Column, y: Column) -> Column:
    """Aggregate Pearson correlation; 0 where either side is constant (``corr`` itself fails there)."""
    both = F.stddev_pop(x) * F.stddev_pop(y)
    return F.coalesce(F.covar_pop(x, y) / F.when(both != 0, both), F.lit(0.0))


def md5_number(text: Column) -> Column:
    """The first eight hexadecimal digits of the MD5, as a number."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def unit_vector(v: Column) -> Column:
    """An array of numbers at length one; of length zero as it is."""
    n = F.sqrt(cosine(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(v)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two arrays in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

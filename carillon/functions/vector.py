"""Vector scalars over array columns, in double precision and JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def finite(v: Column) -> Column:
    """Whether there are numbers, and all of them are finite; null counts as no."""
    bad = F.exists(doubles(v), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad, F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null for empty vectors, unlike lengths, a number that isn't finite, or a norm of zero."""
    na, nb = l2_norm(a), l2_norm(b)
    good = finite(a) & finite(b) & (F.size(a) == F.size(b))
    return F.when(good, F.try_divide(dot(a, b), F.nullif(na * nb, F.lit(0.0))))


def unit(v: Column) -> Column:
    """The vector at length one; null where that can't be."""
    n = l2_norm(v)
    return F.when(finite(v) & (n > 0), F.transform(doubles(v), lambda x: x / n))


def unit_or_same(v: Column) -> Column:
    """As ``unit``, but a zero vector stays."""
    return F.coalesce(unit(v), doubles(v))


def norm_deviation(v: Column) -> Column:
    return F.abs(l2_norm(v) - 1)


def nonzero(v: Column) -> Column:
    return F.size(F.filter(doubles(v), lambda x: x != 0))


def participation(v: Column) -> Column:
    """(sum of squares) squared over the sum of fourth powers: over how many numbers the energy is spread."""
    two = F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x)
    four = F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x * x * x)
    return F.try_divide(two * two, F.nullif(four, F.lit(0.0)))


def small_energy(v: Column, below: float = 2.0**-14) -> Column:
    """Share of the energy in numbers below half precision's least normal one."""
    all_ = F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x)
    low = F.aggregate(F.filter(doubles(v), lambda x: F.abs(x) < below), F.lit(0.0), lambda s, x: s + x * x)
    return F.try_divide(low, F.nullif(all_, F.lit(0.0)))

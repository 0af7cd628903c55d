"""Column expressions over pairs of vectors (array<double>): similarities and distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def centred(a: Column) -> Column:
    """A vector less its mean, which is taken once."""
    return F.transform(F.array(mean(a)), lambda m: F.transform(a, lambda x: x - m))[0]


def variance(a: Column) -> Column:
    """Population variance."""
    return mean(F.transform(centred(a), lambda x: x * x))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def ssd(a: Column, b: Column) -> Column:
    """Sum of squared differences."""
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r; null if either vector is constant."""
    x, y = centred(a), centred(b)
    spread = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((F.array_min(a) == F.array_max(a)) | (F.array_min(b) == F.array_max(b)), None).otherwise(F.try_divide(dot(x, y), spread))


def ncc_distance(a: Column, b: Column) -> Column:
    """1 - r; NaN if either vector is constant."""
    return F.coalesce(1 - correlation(a, b), F.lit(float("nan")))


def cc_distance(a: Column, b: Column) -> Column:
    """1 - r, where r is 0 if either vector is constant."""
    return 1 - F.coalesce(correlation(a, b), F.lit(0.0))


def sam_distance(a: Column, b: Column) -> Column:
    """The angle between two vectors."""
    c = cosine(a, b)
    return F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0)))


def affinity(distance: Column, beta: float) -> Column:
    return F.exp(-F.lit(float(beta)) * distance)

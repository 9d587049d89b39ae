"""Descriptors as arrays: sums, products and the three predicates for a missing one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def has_nonzero_sum(v: Column) -> Column:
    return total(v) != 0


def has_positive_sum(v: Column) -> Column:
    return total(v) > 0


def has_no_zero(v: Column) -> Column:
    return F.forall(v, lambda x: x != 0)


def similarity_to(v: Column, text: list[float]) -> Column:
    """AG24: cosine to a given embedding; null for a descriptor with a zero in it."""
    size = sum(x * x for x in text) ** 0.5
    return F.when(has_no_zero(v), dot(v, F.array(*[F.lit(float(x)) for x in text])) / (norm(v) * size))


def masked(v: Column, black: Column) -> Column:
    """PR8: a zero descriptor where the mask is black."""
    return F.when(black, F.transform(v, lambda x: x * 0)).otherwise(v)

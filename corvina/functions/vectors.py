"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column, kind: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast(kind) * y.cast(kind)).cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column, kind: str = "double") -> Column:
    return F.sqrt(_dot(a, a, kind))


def cosine_of(a: Column, b: Column, norms: Column, kind: str = "double") -> Column:
    """Cosine, given the product of the norms; 0 where that is 0."""
    return F.when(norms == 0, F.lit(0.0)).otherwise(F.try_divide(_dot(a, b, kind), norms))


def cosine_similarity(a: Column, b: Column, kind: str = "double") -> Column:
    """Cosine; 0 where a norm is 0. ``kind="float"`` multiplies in single precision and adds in double."""
    return cosine_of(a, b, norm(a, kind) * norm(b, kind), kind)


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def nearest_rank(values: Column, p: float) -> Column:
    """sorted[round(p * (n - 1))]; an empty array gives the largest double."""
    at = F.floor(F.lit(p) * (F.size(values) - 1) + 0.5).cast("int") + 1
    return F.when(F.size(values) == 0, F.lit(1.7976931348623157e308)).otherwise(F.element_at(F.array_sort(values), F.greatest(at, F.lit(1))))


def upper_median(values: Column) -> Column:
    return F.element_at(F.array_sort(values), F.expr("1") + F.floor(F.size(values) / 2).cast("int"))

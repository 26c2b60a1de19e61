"""Similarity of array columns, by position, in doubles. Null if either array is null or holds a null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _same(a: Column, b: Column, value: Column) -> Column:
    """value, refused for arrays that are empty or of unequal lengths."""
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("quillon.errors.InvalidArgument: vectors must have one length"))).when(F.size(a) == 0, F.raise_error(F.lit("quillon.errors.InvalidArgument: vectors must not be empty"))).otherwise(value)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), _same(a, b, _dot(a, b)))


def euclidean(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.when(a.isNotNull() & b.isNotNull(), _same(a, b, F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))))


def cosine(a: Column, b: Column) -> Column:
    """Clamped to [-1, 1]; a vector of zeros is refused."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    value = F.when(norm == 0, F.raise_error(F.lit("quillon.errors.InvalidArgument: cosine of a zero vector is undefined"))).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(a, b) / norm)))
    return F.when(a.isNotNull() & b.isNotNull(), _same(a, b, value))


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets of elements; 1 for two empty sets."""
    whole = F.size(F.array_union(a, b))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(whole == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / whole))

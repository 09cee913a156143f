"""Similarity of vectors, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(x: Column, y: Column) -> Column:
    double = "array<double>"
    return F.aggregate(F.zip_with(x.cast(double), y.cast(double), lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def cosine_of(product: Column, norm_x: Column, norm_y: Column) -> Column:
    """From -1 to 1; 0 if either vector has no length."""
    size = norm_x * norm_y
    return F.when(size == 0, F.lit(0.0)).otherwise(F.try_divide(product, size))


def cosine(x: Column, y: Column) -> Column:
    return cosine_of(dot(x, y), norm(x), norm(y))


def normalized_of(product: Column, norm_x: Column, norm_y: Column) -> Column:
    """From 0 to 1; 0 if either vector has no length."""
    size = norm_x * norm_y
    return F.when(size == 0, F.lit(0.0)).otherwise((F.try_divide(product, size) + 1) / 2)


def normalized_cosine(x: Column, y: Column) -> Column:
    return normalized_of(dot(x, y), norm(x), norm(y))

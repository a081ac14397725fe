"""Vectors are arrays of floats; sums run in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def pooled(tokens: Column, how: str = "mean") -> Column:
    """One vector of an array of vectors: the first (cls), or the mean or maximum at each place."""
    if how == "cls":
        return tokens[0]
    places = F.sequence(F.lit(0), F.size(tokens[0]) - 1)
    column = lambda i: F.transform(tokens, lambda t: F.get(t, i).cast("double"))
    if how == "max":
        return F.transform(places, lambda i: F.array_max(column(i)))
    return F.transform(places, lambda i: F.aggregate(column(i), F.lit(0.0), lambda s, x: s + x) / F.size(tokens))

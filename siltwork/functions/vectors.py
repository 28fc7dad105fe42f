"""Expressions over vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """A vector of length 1 in the same direction; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, d: s + d * d))


def packed(v: Column) -> Column:
    return v.cast("array<float>")


def checked(v: Column, dimensions: int) -> Column:
    """The vector, or an error if it has not so many dimensions."""
    return F.when(F.size(v) == dimensions, v).otherwise(F.raise_error(F.format_string("a vector of %d dimensions in an index of " + str(dimensions), F.size(v))).cast("array<float>"))


def hash_embedding(text: Column) -> Column:
    """A deterministic stand-in for an embedding: the first 8 bytes of the text's sha256, as eighths of 0..1."""
    digest = F.sha2(text, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(digest, 2 * i + 1, F.lit(2)), 16, 10).cast("double") / 255)

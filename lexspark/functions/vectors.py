"""Vectors as array columns; all arithmetic in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def magnitude(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two double arrays; 0 where one is all zero."""
    return F.coalesce(F.try_divide(dot(a, b), magnitude(a) * magnitude(b)), F.lit(0.0))


def is_vector(c: Column, dim: int) -> Column:
    """Whether there are `dim` finite components that are not all zero."""
    odd = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(c) == dim) & ~odd & F.exists(c, lambda x: x != 0), F.lit(False))


def hash_slot(word: Column, size: int = 1 << 20) -> Column:
    """The place of a word in a hashed sparse vector."""
    return F.pmod(F.xxhash64(word), F.lit(size)).cast("int")

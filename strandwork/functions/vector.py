"""Vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles, summed from the left."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / n)


def masked_mean(vectors: Column, mask: Column, width: int) -> Column:
    """Unit vector of the mean of those vectors (an array of arrays of one width) whose mask is not 0; zeros if none is."""
    kept = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] != 0)
    zero = F.array_repeat(F.lit(0.0), width)
    total = F.aggregate(kept, zero, lambda s, x: F.zip_with(s, x["v"], lambda a, b: a + b.cast("double")))
    mean = F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))
    length = norm(mean)
    return F.transform(mean, lambda x: F.when(length > 0, x / length).otherwise(0.0))

"""Vectors, proportions and exact tests as columns."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Z95 = 1.959963984540054


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double; null if a vector is."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector of length 1; a zero vector stays one."""
    size = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(size == 0, F.lit(1.0)).otherwise(size))


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of k in n; null for n = 0."""
    k, n = k.cast("double"), n.cast("double")
    p, spread = k / n, 1 + z * z / n
    middle = (p + z * z / (2 * n)) / spread
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / spread
    return F.when(n > 0, F.greatest(middle - half, F.lit(0.0))), F.when(n > 0, F.least(middle + half, F.lit(1.0)))


def mcnemar_p(only_a: int, only_b: int) -> float:
    """Exact two-sided p of the discordant pairs."""
    n, low = only_a + only_b, min(only_a, only_b)
    if not n:
        return 1.0
    tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(low + 1))
    return min(1.0, 2 * tail)


@F.pandas_udf(T.DoubleType())
def mcnemar(only_a: pd.Series, only_b: pd.Series) -> pd.Series:
    return pd.Series([mcnemar_p(int(a), int(b)) for a, b in zip(only_a, only_b, strict=True)])


def nearest_rank(values: Column, share: float) -> Column:
    """Nearest-rank percentile of a sorted array."""
    n = F.size(values)
    return F.get(values, F.greatest(F.ceil(F.lit(share) * n).cast("int"), F.lit(1)) - 1)

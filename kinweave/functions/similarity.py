"""String and set similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def jaro(a: str, b: str) -> float:
    """Share of characters that match within half the longer length, less half of
    those that match out of order."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    window = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    first = []
    for i, c in enumerate(a):
        for j in range(max(0, i - window), min(len(b), i + window + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                first.append(c)
                break
    if not first:
        return 0.0
    second = [c for c, u in zip(b, used) if u]
    m, swaps = len(first), sum(x != y for x, y in zip(first, second)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str, weight: float = 0.1, most: int = 4) -> float:
    """jaro() raised by a shared prefix of up to `most` characters."""
    if weight * most > 1:
        raise ValueError("weight times prefix must not exceed 1")
    j, n = jaro(a, b), 0
    while n < min(most, len(a), len(b)) and a[n] == b[n]:
        n += 1
    return j + n * weight * (1 - j)


@F.pandas_udf(DoubleType())
def jaro_column(a: pd.Series, b: pd.Series) -> pd.Series:
    """For columns of distinct pairs; nulls give null."""
    return pd.Series([None if x is None or y is None else jaro(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def jaro_winkler_column(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; 0 if either is empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / either)

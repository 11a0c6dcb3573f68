"""Slices of a column's range that hold about as many rows each, whatever the distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICES = 1024


def splitters(rows: DataFrame, column: str, slices: int = SLICES) -> list[float]:
    """At most slices - 1 ascending values that cut the column into equal shares, from one mergeable sketch of all rows.

    They come to the driver, so that every later use of them cuts alike.
    """
    shares = [k / slices for k in range(1, slices)]
    got = rows.agg(F.percentile_approx(F.col(column).cast("double"), shares, 10 * slices)).first()[0]
    return sorted({v for v in got or [] if v == v})


def slice_of(value: Column, splits: list[float]) -> Column:
    """How many splitters are at most value, found by halving; null is in slice 0."""
    if not splits:
        return F.lit(0)
    at, value = F.lit(splits), value.cast("double")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(splits).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda p, s: F.when(F.get(at, p + s - 1) <= value, p + s).otherwise(p))

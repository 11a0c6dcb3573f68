"""Interval look-ups as equi-joins on cells of the axis, each interval on the level of its own length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(length: Column) -> Column:
    """The least power of two that is no shorter; an interval touches two cells of that width at most."""
    return F.ceil(F.log2(F.greatest(length, F.lit(2.0**-20)))).cast("int")


def lookup(probes: DataFrame, at: str, intervals: DataFrame, lo: str, hi: str, by: list[str], keep: Column) -> DataFrame:
    """Rows of probes joined to the intervals of the same `by` that `keep` holds for, which must lie within [lo, hi].

    A probe looks once at each level that its group has, so that one long interval among short ones takes two rows and
    makes no crowded cell. Both sides are dealt by (by, level, cell); nothing is counted first.
    """
    i = intervals.where(F.col(hi) >= F.col(lo)).withColumn("__level", _level(F.col(hi) - F.col(lo)))
    depths = i.groupBy(*by).agg(F.collect_set("__level").alias("__levels"))  # as many as lengths have powers of two
    width = F.pow(F.lit(2.0), F.col("__level"))
    i = i.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    p = probes.join(depths, by).withColumn("__level", F.explode("__levels")).drop("__levels")
    return p.withColumn("__cell", F.floor(F.col(at) / width)).join(i, [*by, "__level", "__cell"]).where(keep).drop("__level", "__cell")

"""Pyramids over ordered rows: runs of FAN rows, runs of runs, and a descent by equi-joins that drops what cannot match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alidade.tables import written

#: Rows of a run.
FAN = 8


def placed(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """rows with place, their number from 0 in each group."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(order)).cast("long") - 1)


def levels(leaves: DataFrame, by: list[str], combine: Callable[[DataFrame, list[str]], DataFrame]) -> list[DataFrame]:
    """Tables of nodes (by, place, ...), leaves first, until no group has more than FAN; combine(nodes, keys) makes one
    node of each run."""
    out = [written(leaves, "leaves")]
    n = out[0].agg(F.max("place")).first()[0]
    n = 0 if n is None else n + 1
    while n > FAN:
        out.append(written(combine(out[-1].withColumn("place", F.floor(F.col("place") / FAN)), [*by, "place"]), "nodes"))
        n = -(-n // FAN)
    return out


def descend(probes: DataFrame, nodes: list[DataFrame], by: list[str], test: Column) -> DataFrame:
    """probes with the place of every leaf that passes `test`, as did all runs that it is in.

    A join on the group meets FAN nodes of it at most; below, each run that passed meets its own rows.
    """
    found = probes.join(nodes[-1], by).where(test).select(*probes.columns, "place")
    for below in reversed(nodes[:-1]):
        up = F.floor(F.col("place") / FAN)
        found = found.withColumnRenamed("place", "__run").join(below.withColumn("__run", up), [*by, "__run"]).where(test).select(*probes.columns, "place")
    return found

"""Boxes, grid indexes, sampling grids, rasters in long form, tiles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cell_centres(cells: DataFrame, head: dict) -> DataFrame:
    """cells (row from the top, col, z) with x, y of their centres; head holds numbers or columns."""
    cs = head["cellsize"]
    top = head["yll"] + head["nrows"] * cs
    return cells.withColumns({"x": F.lit(head["xll"] + cs / 2) + F.col("col") * cs, "y": F.lit(top - cs / 2) - F.col("row") * cs})


def tiled(points: DataFrame, size: float = 500.0) -> DataFrame:
    return points.withColumns({"tx": F.floor(F.col("x") / size), "ty": F.floor(F.col("y") / size)})


def bounding_box(points: DataFrame, margin: float = 0.0) -> DataFrame:
    """One row xmin, ymin, xmax, ymax (wider by margin), zmin, zmax."""
    return points.agg(
        (F.min("x") - margin).alias("xmin"), (F.min("y") - margin).alias("ymin"), (F.max("x") + margin).alias("xmax"), (F.max("y") + margin).alias("ymax"), F.min("z").alias("zmin"), F.max("z").alias("zmax")
    )


def box_of(points: DataFrame) -> tuple[float, float, float, float]:
    b = bounding_box(points).first()
    return b["xmin"], b["ymin"], b["xmax"], b["ymax"]


def grid_index(items: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """items (xmin..ymax) once per cell covered, of a grid of ceil(n^(1/4)) rows and columns over box; clamped to it."""
    n = items.count()
    k = max(1, math.ceil(math.sqrt(math.sqrt(n))))
    at = lambda c, lo, hi: F.greatest(F.lit(0), F.least(F.floor((F.col(c) - lo) / (hi - lo) * k), F.lit(k - 1)))
    x = F.sequence(at("xmin", box[0], box[2]), at("xmax", box[0], box[2]))
    y = F.sequence(at("ymin", box[1], box[3]), at("ymax", box[1], box[3]))
    return items.withColumn("cx", F.explode(x)).withColumn("cy", F.explode(y))


def sample_grid(spark: SparkSession, box: tuple[float, float, float, float], spacing: float) -> DataFrame:
    """(row, col, x, y) at a spacing from the lower left corner."""
    cols = int((box[2] - box[0]) // spacing) + 1
    rows = int((box[3] - box[1]) // spacing) + 1
    g = spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("row"), (F.col("id") % cols).alias("col"))
    return g.withColumns({"x": F.lit(box[0]) + F.col("col") * spacing, "y": F.lit(box[1]) + F.col("row") * spacing})


def centred(points: DataFrame) -> DataFrame:
    """points moved so that their box's centre is the origin."""
    c = points.agg(*[((F.min(a) + F.max(a)) / 2).alias(f"c{a}") for a in "xyz"])
    return points.crossJoin(F.broadcast(c)).withColumns({a: F.col(a) - F.col(f"c{a}") for a in "xyz"}).drop("cx", "cy", "cz")  # one row

"""Thinning of points: systematic, random, and by dihedral angle, sparsity and curvature."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alidade.functions.angles import rounded as R
from alidade.operators import surface as s
from alidade.operators.slices import slice_of, splitters
from alidade.tables import written


def numbered(rows: DataFrame, order: str, name: str = "place") -> DataFrame:
    """rows with a 0-based place in `order` (numeric, unique): numbered in parallel within slices of as many rows each."""
    r = rows.withColumn("__cell", slice_of(F.col(order), splitters(rows, order)))
    n = r.groupBy("__cell").agg(F.count("*").alias("__n"))
    first = F.coalesce(F.sum("__n").over(Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.broadcast(n.select("__cell", first.alias("__first")))  # at most SLICES rows
    inside = F.row_number().over(Window.partitionBy("__cell").orderBy(order)) - 1
    return r.withColumn("__in", inside).join(n, "__cell").withColumn(name, F.col("__first") + F.col("__in")).drop("__cell", "__first", "__in")


def placed(rows: DataFrame, order: str, then: list[str], name: str = "place") -> DataFrame:
    """rows with a 1-based place in `order` (without nulls), equal values by `then`: rows of a value, then values."""
    n = written(rows.groupBy(order).agg(F.count("*").alias("__n")).withColumn("__key", F.col(order).cast("double")))
    n = n.withColumn("__cell", slice_of(F.col("__key"), splitters(n, "__key")))
    up_to = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = n.groupBy("__cell").agg(F.sum("__n").alias("__n"))
    cells = F.broadcast(cells.select("__cell", up_to(Window.orderBy("__cell")).alias("__first")))  # at most SLICES rows
    before = n.withColumn("__in", up_to(Window.partitionBy("__cell").orderBy(order))).join(cells, "__cell")
    before = before.select(order, (F.col("__first") + F.col("__in")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(order).orderBy(*then))
    return rows.withColumn("__at", inside).join(before, order).withColumn(name, (F.col("__before") + F.col("__at")).cast("long")).drop("__at", "__before")


def every_nth(points: DataFrame, skip: int, order: str = "seq") -> DataFrame:
    """points with used: every (skip + 1)-th in order."""
    return numbered(points, order, "__place").withColumn("used", F.col("__place") % (skip + 1) == 0).drop("__place")


def targets(points: DataFrame, hull: DataFrame, share: float) -> DataFrame:
    """n, h (hull points), target = int(share n), remaining = target - h; one row."""
    n = points.agg(F.count("*").alias("n")).crossJoin(F.broadcast(hull.agg(F.count("*").alias("h"))))
    return n.select("n", "h", F.floor(F.col("n") * share).alias("target"), (F.floor(F.col("n") * share) - F.col("h")).alias("remaining"))


def dihedral_pick(points: DataFrame, tv: DataFrame, hull: DataFrame, share: float, split: float) -> DataFrame:
    """point_id of the ends of the sharpest edges: edges by descending dihedral angle, both ends of each, while no more
    than the quota int((T - H) / N * split * (T - 2 H)) were taken before the edge. Equal angles go by (pa, pb)."""
    t = targets(points, hull, share).first()
    quota = math.trunc((t["target"] - t["h"]) / t["n"] * split * (t["target"] - 2 * t["h"])) if t["n"] else -1
    if quota < 0:
        return points.select("point_id").limit(0)
    e = s.dihedrals(s.edges(tv), tv).select("pa", "pb", F.coalesce(F.floor(F.col("dihedral") * 1000000 + 0.5), F.lit(-1)).alias("sharp"))
    place = F.struct((-F.col("sharp")).alias("s"), "pa", "pb")
    ends = e.select(F.explode(F.array("pa", "pb")).alias("point_id"), place.alias("place"))
    firsts = ends.join(hull.select("point_id"), "point_id", "left_anti").groupBy("point_id").agg(F.min("place").alias("place"))
    # points of the quota's first edges: how many came with earlier edges is a rank over a histogram of sharpness
    first = written(firsts)
    order = Window.orderBy("s")
    counts = first.groupBy(F.col("place.s").alias("s")).agg(F.count("*").alias("c"))
    cut = counts.withColumn("before", F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    near = first.join(cut.select("s", "before"), first["place.s"] == F.col("s")).where(F.col("before") <= quota)
    inside = F.rank().over(Window.partitionBy("s").orderBy("place")) - 1
    return near.withColumn("taken", F.col("before") + inside).where(F.col("taken") <= quota).select("point_id")


def scores(measures: DataFrame) -> DataFrame:
    """(point_id, score): sparsity times absolute curvature over its greatest value; hull points have none."""
    raw = measures.where("curvature is not null").select("point_id", (F.col("sparsity") * F.abs("curvature")).alias("s"))
    top = raw.agg(F.max("s").alias("top"))
    return raw.crossJoin(F.broadcast(top)).select("point_id", F.coalesce(F.try_divide(F.col("s"), F.col("top")), F.lit(0.0)).alias("score"))


def odds_scaled(p: Column, factor: float) -> Column:
    """p with its odds times factor: what any number of prior corrections come to."""
    return F.coalesce(F.try_divide(F.lit(factor) * p, F.lit(factor) * p + 1.0 - p), F.lit(1.0))


def solve_factor(scored: DataFrame, mean: float, tol: float = 1e-5, grid: int = 64) -> float:
    """The odds factor that brings the mean probability to `mean`: a few aggregates, each over `grid` candidates."""
    low, high = -18.0, 18.0  # of the natural logarithm
    for _ in range(6):
        logs = [low + (high - low) * k / (grid - 1) for k in range(grid)]
        row = scored.agg(*[F.avg(odds_scaled(F.col("score"), math.exp(v))).alias(f"m{k}") for k, v in enumerate(logs)]).first()
        means = list(row)
        if means[0] is None:
            return 1.0
        k = min(range(grid), key=lambda i: abs(means[i] - mean))
        if abs(means[k] - mean) <= tol:
            return math.exp(logs[k])
        low, high = logs[max(0, k - 1)], logs[min(grid - 1, k + 1)]
    return math.exp(logs[k])


def random_p(points: DataFrame, hull: DataFrame, share: float) -> DataFrame:
    """points with p: 1 on the hull, (T - H) / N elsewhere."""
    t = targets(points, hull, share).select((F.col("remaining") / F.col("n")).alias("__p"))
    on = hull.select("point_id", F.lit(1.0).alias("__one"))
    return points.join(on, "point_id", "left").crossJoin(F.broadcast(t)).withColumn("p", F.coalesce("__one", "__p")).drop("__one", "__p")


def smart(points: DataFrame, tv: DataFrame, hull: DataFrame, share: float, split: float, likelihood: Callable[[DataFrame], DataFrame] = scores) -> DataFrame:
    """(point_id, p): 1 on the hull and at picked sharp edges, reweighted scores elsewhere so that the mean meets the rest.

    likelihood makes (point_id, score from 0 to 1) of point measures; points that it leaves out have p = 0,
    scores of hull points and picked ones are not used.
    """
    picked = written(dihedral_pick(points, tv, hull, share, split))
    t = targets(points, hull, share).first()
    measures = s.point_measures(tv, hull)
    pool = written(likelihood(measures).join(picked.union(hull.select("point_id")), "point_id", "left_anti"))
    n = pool.count()
    left = max(0.0, min(1.0, (t["remaining"] - picked.count()) / n)) if n else 0.0
    factor = solve_factor(pool, left) if n else 1.0
    p = pool.select("point_id", odds_scaled(F.col("score"), factor).alias("p"))
    sure = hull.select("point_id").union(picked).distinct().withColumn("sure", F.lit(1.0))
    rows = points.select("point_id").join(sure, "point_id", "left").join(p, "point_id", "left")
    return rows.select("point_id", R(F.coalesce("sure", "p", F.lit(0.0))).alias("p"))


def kept(points: DataFrame, seed: int = 0) -> DataFrame:
    """points (point_id, p) with used: a uniform number hashed from id and seed is at most p."""
    u = F.pmod(F.xxhash64("point_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return points.withColumn("used", u <= F.col("p"))


def random_sample(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows by least hash of id and seed."""
    return points.orderBy(F.xxhash64("point_id", F.lit(seed)), "point_id").limit(n)

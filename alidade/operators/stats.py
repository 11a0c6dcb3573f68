"""Surface statistics, histograms, decimation errors, model fits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alidade.functions.angles import rounded as R
from alidade.operators import surface as s
from alidade.operators.slices import slice_of, splitters
from alidade.tables import written


#: Candidates of a fit that are broadcast: two numbers each.
FEW_CANDIDATES = 100_000


def xyz_stats(points: DataFrame) -> DataFrame:
    """Per axis: low, high, width, centre, mean and exact median.

    The medians are order statistics over counted values, all axes in one pass, so that no task holds a column.
    """
    rows = points.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("v")) for a in "xyz"])).alias("r")).select("r.*")
    low, high, n = F.min("v"), F.max("v"), F.col("n")
    per = rows.groupBy("axis").agg(R(low).alias("low"), R(high).alias("high"), R(high - low).alias("width"), R((high + low) / 2).alias("centre"), R(F.avg("v")).alias("mean"))
    middle = order_statistic(rows, "v", {"below": F.floor((n - 1) / 2), "above": F.floor(n / 2)}, ["axis"])
    middle = middle.select("axis", R((F.col("below") + F.col("above")) / 2).alias("median"))
    return per.join(F.broadcast(middle), "axis", "left")  # three rows


def order_statistic(values: DataFrame, column: str, ranks: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """One row (or one for each of a few keys `by`): n and the values at 0-based ranks (expressions of n), ascending.

    Distinct values are counted first, so the ordering window runs over (value, count) and not over rows; the counts
    are summed in two levels (slices of as many values each, then values in a slice), each in parallel.
    """
    by = by or []
    counts = written(values.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("v")).agg(F.count("*").alias("c")))
    counts = counts.withColumn("cell", slice_of(F.col("v"), splitters(counts, "v")))
    per, before = counts.groupBy(*by, "cell").agg(F.sum("c").alias("m")), (Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("m").over(Window.partitionBy(*by).orderBy("cell").rowsBetween(*before)), F.lit(0))
    per = per.select(*by, "cell", first.alias("first"), F.sum("m").over(Window.partitionBy(*by)).alias("n"))
    below = F.coalesce(F.sum("c").over(Window.partitionBy(*by, "cell").orderBy("v").rowsBetween(*before)), F.lit(0))
    placed = counts.withColumn("below", below).join(F.broadcast(per), [*by, "cell"])  # SLICES rows a key at the most
    placed = placed.withColumn("below", F.col("below") + F.col("first"))
    holds = lambda r: (F.col("below") <= r) & (r < F.col("below") + F.col("c"))
    return placed.groupBy(*by).agg(F.max("n").alias("n"), *[F.max(F.when(holds(r), F.col("v"))).alias(k) for k, r in ranks.items()])


def edge_stats(e: DataFrame) -> DataFrame:
    """Shortest, upper median and longest edge of edges with len2d."""
    n = F.col("n")
    got = order_statistic(e, "len2d", {"shortest": n * 0, "median": F.floor(n / 2), "longest": n - 1})
    return got.select(*[R(F.col(c)).alias(c) for c in ("shortest", "median", "longest")])


def density(points: DataFrame, triangles: DataFrame) -> DataFrame:
    area = (F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))
    p = points.agg(F.count("*").alias("n_points"), area.alias("area"))
    t = triangles.agg(F.count("*").alias("n_triangles"))
    both = p.crossJoin(F.broadcast(t))  # one row each
    return both.select("n_points", "n_triangles", R(F.col("area")).alias("area"), R(F.try_divide(F.col("n_points"), F.col("area"))).alias("density"), R(F.try_divide(F.col("area"), F.col("n_points"))).alias("per_point"))


def extended_stats(tv: DataFrame) -> DataFrame:
    """Means over triangles that a summary may ask for besides: area, slope, aspect, 3-D area."""
    return tv.agg(
        F.avg(s.area2d()).alias("mean_area"),
        F.avg(F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2) / 2).alias("mean_area_3d"),
        F.avg(s.slope_pct()).alias("mean_slope_pct"),
        F.degrees(F.atan2(F.avg(F.sin(F.radians(s.aspect()))), F.avg(F.cos(F.radians(s.aspect()))))).alias("mean_aspect"),
    )


def error_stats(queries: DataFrame, tv: DataFrame) -> DataFrame:
    """Absolute errors of the surface at points (qid, px, py, pz): p25, p75, p95 at rank floor(q n), mean, greatest, rmse."""
    hit = s.locate(queries, tv).select(F.abs(s.elevation(F.col("px"), F.col("py")) - F.col("pz")).alias("e")).where("e is not null")
    n = F.col("n")
    ranks = order_statistic(hit, "e", {f"p{int(q * 100)}": F.floor(n * q) for q in (0.25, 0.75, 0.95)})
    plain = hit.agg(F.avg("e").alias("mean"), F.max("e").alias("greatest"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"))
    return ranks.crossJoin(F.broadcast(plain)).select("n", *[R(F.col(c)).alias(c) for c in ("p25", "p75", "p95", "mean", "greatest", "rmse")])


def _binned(values: DataFrame, column: str, bins: int, low: Column, width: Column, last: int) -> DataFrame:
    b = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.avg(column).alias("mean"))
    b = b.select(low.alias("lo"), width.alias("w"))
    rows = values.crossJoin(F.broadcast(b))  # one row of bounds
    at = F.coalesce(F.floor(F.try_divide(F.col(column) - F.col("lo"), F.col("w"))), F.lit(0))
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.least(at, F.lit(last)).alias("bin")).agg(F.count("*").alias("n"))
    frame = values.sparkSession.range(bins).withColumnRenamed("id", "bin").crossJoin(F.broadcast(b))
    out = frame.join(F.broadcast(counts), "bin", "left")  # at most `bins` rows
    return out.select("bin", (F.col("lo") + F.col("w") * F.col("bin")).alias("min_x"), (F.col("lo") + F.col("w") * (F.col("bin") + 1)).alias("max_x"), F.coalesce("n", F.lit(0)).alias("n"))


def histogram(values: DataFrame, column: str, bins: int, cap: float | None = None) -> DataFrame:
    """(bin, min_x, max_x, n): equal widths from least to greatest value, overflow in the last bin.

    With `cap`, the range ends at cap times the mean and there are bins - 1 bins, the last with all that is larger.
    """
    if cap is None:
        return _binned(values, column, bins, F.col("lo"), (F.col("hi") - F.col("lo")) / bins, bins - 1)
    return _binned(values, column, bins - 1, F.col("lo"), (F.least(F.col("hi"), F.col("mean") * cap) - F.col("lo")) / (bins - 1), bins - 2)


def probability_bins(values: DataFrame, column: str, bins: int) -> DataFrame:
    """bins - 1 widths span the values plus a hair, so that the greatest has a bin of its own."""
    return _binned(values, column, bins, F.col("lo"), (F.col("hi") + 0.00001 - F.col("lo")) / (bins - 1), bins - 1)


def fit_errors(data: DataFrame, candidates: DataFrame, model: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """(a, b, error) per candidate: signed trapezoid area between model(x, a, b) and y over the range of x.

    Rows are put in order within slices of x, whose first rows follow the last one of the slice before; every row meets
    every candidate where it lies, and sums are what is shuffled.
    """
    d = data.select("x", "y", slice_of(F.col("x"), splitters(data, "x")).alias("cell"))
    ends = d.groupBy("cell").agg(F.max(F.struct("x", "y")).alias("end"))
    ends = ends.select("cell", F.lag("end").over(Window.orderBy("cell")).alias("end"))
    before = F.lag(F.struct("x", "y")).over(Window.partitionBy("cell").orderBy("x", "y"))
    d = d.withColumn("before", before).join(F.broadcast(ends), "cell")  # at most SLICES rows
    d = d.withColumn("before", F.coalesce("before", "end")).select("x", "y", F.coalesce("before.x", F.lit(0.0)).alias("x0"), F.col("before.y").alias("y0"))
    few = candidates.limit(FEW_CANDIDATES + 1).count() <= FEW_CANDIDATES
    rows = d.crossJoin(F.broadcast(candidates) if few else candidates)
    err = model(F.col("x"), F.col("a"), F.col("b")) - F.col("y")
    before = F.when(F.col("y0").isNull(), 0.0).otherwise(model(F.col("x0"), F.col("a"), F.col("b")) - F.col("y0"))
    dx = F.col("x") - F.col("x0")
    return rows.groupBy("a", "b").agg(F.try_divide(F.sum(dx * (err + before) / 2), F.sum(dx)).alias("error"))


def fit_grid(spark, a: tuple[float, float], b: tuple[float, float], parts: int) -> DataFrame:
    """parts x parts candidates, the ends included."""
    step = lambda lo, hi, k: F.lit(lo) + k * ((hi - lo) / (parts - 1))
    g = spark.range(parts * parts)
    return g.select(step(*a, F.floor(F.col("id") / parts)).alias("a"), step(*b, F.col("id") % parts).alias("b"))


def fit_best(errors: DataFrame) -> DataFrame:
    """The candidate of least absolute error, ties to the least a, then b."""
    return errors.agg(F.min(F.struct(F.abs("error").alias("size"), "a", "b", "error")).alias("m")).select("m.a", "m.b", "m.error")


def fit(data: DataFrame, model, a: tuple[float, float], b: tuple[float, float], parts: int = 200, depth: int = 5, tol: float = 1e-6) -> dict:
    """Grid search whose range shrinks tenfold around the best candidate, at most depth + 1 levels."""
    spark = data.sparkSession
    for level in range(depth + 1):
        best = fit_best(fit_errors(data, fit_grid(spark, a, b, parts), model)).first()
        if abs(best["error"]) <= tol:
            break
        a, b = ((v - (hi - lo) / 20, v + (hi - lo) / 20) for v, (lo, hi) in ((best["a"], a), (best["b"], b)))
    return {"a": best["a"], "b": best["b"], "error": best["error"], "levels": level + 1}


def summary(points: DataFrame, tv: DataFrame) -> str:
    """Statistics as text, for the console."""
    rows = {r["axis"]: r for r in xyz_stats(points).collect()}  # three rows
    d = density(points, tv).first()
    lines = [f"Points: {d['n_points']:,}  Triangles: {d['n_triangles']:,}  Area: {d['area']:.2f}  Density: {d['density']:.4f}"]
    lines += [f"{a.upper()}: min {rows[a]['low']:.3f} max {rows[a]['high']:.3f} mean {rows[a]['mean']:.3f} median {rows[a]['median']:.3f}" for a in "xyz" if a in rows]
    return "\n".join(lines)


def tolerance_misses(found: DataFrame, expected: DataFrame, key: str, columns: list[str], tol: float = 0.15) -> DataFrame:
    """(key, column): values of `expected` that `found` has not within tol; a NULL on one side only is a miss, a missing row too."""
    e = expected.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    both = e.join(found.select(key, *columns), key, "left")
    miss = lambda c: F.when(~F.coalesce((F.abs(F.col(c) - F.col(f"__{c}")) <= tol), F.col(c).isNull() & F.col(f"__{c}").isNull()), F.lit(c))
    return both.select(key, F.explode(F.array_compact(F.array(*[miss(c) for c in columns]))).alias("column"))

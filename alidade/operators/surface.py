"""Triangulated surfaces: vertices, topology, derived measures, point location."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alidade.functions import vectors as v
from alidade.functions.angles import math_angle
from alidade.operators.components import components
from alidade.tables import written

THETA_MAX = math.radians(79.5)
ANGLE_MAX = 157.0
DIHEDRAL_MAX = 3.0


def grid_key(x: Column, y: Column) -> list[Column]:
    """Key of near-duplicates: coordinates to 0.1, halves to even."""
    return [F.bround(x * 10.0).cast("long").alias("kx"), F.bround(y * 10.0).cast("long").alias("ky")]


def deduplicated(points: DataFrame, order: str = "seq") -> DataFrame:
    """One point per 0.1 key, the last in `order`; partial aggregation, no window."""
    keep = [c for c in points.columns if c != order]
    kx, ky = grid_key(F.col("x"), F.col("y"))
    best = points.groupBy(kx, ky).agg(F.max(F.struct(order, *keep)).alias("p"))
    return best.select("kx", "ky", "p.*")


def with_vertices(triangles: DataFrame, points: DataFrame) -> DataFrame:
    """triangles with x1..z3, upside-down ones with p1 and p2 swapped, those with a repeated vertex left out."""
    t = triangles.where("p1 <> p2 and p2 <> p3 and p3 <> p1")
    for k in (1, 2, 3):
        p = points.select(F.col("point_id").alias(f"p{k}"), *[F.col(a).alias(f"{a}{k}") for a in "xyz"])
        t = t.join(p, f"p{k}")
    flip = (F.col("x2") - F.col("x1")) * (F.col("y3") - F.col("y1")) - (F.col("y2") - F.col("y1")) * (F.col("x3") - F.col("x1")) < 0
    swap = {f"{a}1": F.when(flip, F.col(f"{a}2")).otherwise(F.col(f"{a}1")) for a in ("p", "x", "y", "z")}
    swap |= {f"{a}2": F.when(flip, F.col(f"{a}1")).otherwise(F.col(f"{a}2")) for a in ("p", "x", "y", "z")}
    t = t.withColumns(swap)
    a, b, c = (v.xyz(suffix=str(k)) for k in (1, 2, 3))
    n = v.cross(v.vec(a, b), v.vec(a, c))
    box = {f"{a}min": F.least(*[F.col(f"{a}{k}") for k in (1, 2, 3)]) for a in "xy"} | {f"{a}max": F.greatest(*[F.col(f"{a}{k}") for k in (1, 2, 3)]) for a in "xy"}
    return t.withColumns({"nx": n[0], "ny": n[1], "nz": n[2]} | box)




def normal() -> v.V:
    return F.col("nx"), F.col("ny"), F.col("nz")


def slope_pct() -> Column:
    return F.abs(F.try_divide(100.0 * F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2), F.col("nz")))


def aspect() -> Column:
    """Counter-clockwise from +x, degrees."""
    return math_angle(F.col("nx"), F.col("ny"))


def compass_aspect() -> Column:
    return F.pmod(F.degrees(F.atan2("nx", "ny")) + 360.0, F.lit(360.0))


def slope_double() -> Column:
    """tan(pi/2 - theta), the cotangent of the slope angle; NULL for a level triangle."""
    return F.try_divide(F.col("nz"), F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2))


def area2d() -> Column:
    return F.abs(F.col("nz")) / 2.0


def elevation(px: Column, py: Column) -> Column:
    drop = F.col("nx") * (px - F.col("x1")) + F.col("ny") * (py - F.col("y1"))
    return F.col("z1") - F.try_divide(drop, F.col("nz"))


def interior_angles_2d() -> list[Column]:
    """Degrees at p1, p2, p3 in plan."""
    found = []
    for k in (1, 2, 3):
        i, j = k % 3 + 1, (k + 1) % 3 + 1
        ax, ay, bx, by = (F.col(f"{a}{m}") - F.col(f"{a}{k}") for m in (i, j) for a in "xy")
        found.append(F.degrees(F.atan2(F.abs(ax * by - ay * bx), ax * bx + ay * by)))
    return found


def interior_angles_3d() -> list[Column]:
    """Radians at p1, p2, p3 in space."""
    p = {k: v.xyz(suffix=str(k)) for k in (1, 2, 3)}
    return [v.angle_between(v.vec(p[k], p[k % 3 + 1]), v.vec(p[k], p[(k + 1) % 3 + 1])) for k in (1, 2, 3)]


def incident(triangles: DataFrame) -> DataFrame:
    """(point_id, tri_id): one row per vertex of each triangle."""
    return triangles.select("tri_id", F.explode(F.array("p1", "p2", "p3")).alias("point_id"))


def edges(triangles: DataFrame) -> DataFrame:
    """(pa < pb, tri_a, tri_b): adjacency by one aggregation on the ordered pair; tri_b is NULL on a border."""
    sides = F.array(*[F.struct(F.least(a, b).alias("pa"), F.greatest(a, b).alias("pb")) for a, b in (("p1", "p2"), ("p2", "p3"), ("p3", "p1"))])
    e = triangles.select("tri_id", F.explode(sides).alias("e")).groupBy("e.pa", "e.pb").agg(F.min("tri_id").alias("tri_a"), F.max("tri_id").alias("tri_b"))
    return e.withColumn("tri_b", F.when(F.col("tri_a") != F.col("tri_b"), F.col("tri_b")))


def edges_with_validity(triangles: DataFrame) -> DataFrame:
    """edges with va, vb: whether each adjacent triangle is valid, from one aggregation."""
    sides = F.array(*[F.struct(F.least(a, b).alias("pa"), F.greatest(a, b).alias("pb")) for a, b in (("p1", "p2"), ("p2", "p3"), ("p3", "p1"))])
    t = F.struct("tri_id", "is_valid")
    e = triangles.select(F.explode(sides).alias("e"), t.alias("t")).groupBy("e.pa", "e.pb").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    two = F.col("a.tri_id") != F.col("b.tri_id")
    return e.select("pa", "pb", F.col("a.tri_id").alias("tri_a"), F.when(two, F.col("b.tri_id")).alias("tri_b"), F.col("a.is_valid").alias("va"), F.when(two, F.col("b.is_valid")).alias("vb"))


def is_valid_edge() -> Column:
    return F.col("tri_b").isNotNull() & (F.col("va") | F.col("vb"))


def is_hull_edge() -> Column:
    return F.col("va").cast("int") + F.coalesce(F.col("vb").cast("int"), F.lit(0)) == 1


def hull_points(triangles: DataFrame) -> DataFrame:
    """Distinct end points of hull edges."""
    e = edges_with_validity(triangles).where(is_hull_edge())
    return e.select(F.explode(F.array("pa", "pb")).alias("point_id")).distinct()


def exterior(triangles: DataFrame) -> DataFrame:
    """tri_id of triangles on the border."""
    return edges(triangles).where("tri_b is null").select(F.col("tri_a").alias("tri_id")).distinct()


def edge_lengths(e: DataFrame, points: DataFrame) -> DataFrame:
    for k in "ab":
        e = e.join(points.select(F.col("point_id").alias(f"p{k}"), *[F.col(c).alias(f"{c}{k}") for c in "xyz"]), f"p{k}")
    return e.withColumn("len2d", v.base_length(F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya")))


def dihedrals(e: DataFrame, tv: DataFrame) -> DataFrame:
    """e with dihedral: angle between the normals of both triangles, NULL on a border."""
    for k in "ab":
        n = tv.select(F.col("tri_id").alias(f"tri_{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("nx", "ny", "nz")])
        e = e.join(n, f"tri_{k}", "left")
    a, b = (tuple(F.col(f"{c}{k}") for c in ("nx", "ny", "nz")) for k in "ab")
    return e.withColumn("dihedral", v.angle_between(a, b)).drop(*[f"{c}{k}" for c in ("nx", "ny", "nz") for k in "ab"])


def flawed(tv: DataFrame, theta=THETA_MAX, angle=ANGLE_MAX, dihedral=DIHEDRAL_MAX, predicate: Column | None = None) -> DataFrame:
    """(tri_id, bad): too steep, too flat an angle, or too sharp a fold; or a predicate of the caller's."""
    d = dihedrals(edges(tv), tv).select(F.explode(F.array("tri_a", "tri_b")).alias("tri_id"), "dihedral")
    d = d.where("tri_id is not null").groupBy("tri_id").agg(F.max("dihedral").alias("fold"))
    bad = (v.theta(normal()) > theta) | (F.greatest(*interior_angles_2d()) > angle)
    if predicate is not None:
        return tv.select("tri_id", predicate.alias("bad"))
    return tv.withColumn("__steep", bad).join(d, "tri_id", "left").select("tri_id", (F.col("__steep") | F.coalesce(F.col("fold") > dihedral, F.lit(False))).alias("bad"))


def reached(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """seeds (node) and all nodes that undirected links (a, b) join to them: rounds do not grow with the depth."""
    named = written(components(links))
    hit = named.join(seeds.distinct(), "node", "left_semi").select("root").distinct()
    return named.join(hit, "root", "left_semi").select("node").union(seeds).distinct()


def pruned(tv: DataFrame, **limits) -> DataFrame:
    """tri_id of the triangles taken off the hull: flawed border triangles and flawed ones reached through them."""
    bad = written(flawed(tv, **limits).where("bad").select("tri_id"))
    links = edges(tv).where("tri_b is not null").select(F.col("tri_a").alias("a"), F.col("tri_b").alias("b"))
    for end in "ab":
        links = links.join(bad.select(F.col("tri_id").alias(end)), end, "left_semi")
    seeds = exterior(tv).join(bad, "tri_id", "left_semi").select(F.col("tri_id").alias("node"))
    return reached(seeds, links).select(F.col("node").alias("tri_id"))


def dissolved(tv: DataFrame, points: DataFrame, longest: float, where: Column | None = None) -> DataFrame:
    """tri_id of triangles taken off from outside through edges longer than `longest` (and meeting `where`)."""
    e = edge_lengths(edges(tv), points).where((F.col("len2d") > longest) & (F.lit(True) if where is None else where))
    links = e.where("tri_b is not null").select(F.col("tri_a").alias("a"), F.col("tri_b").alias("b"))
    seeds = e.where("tri_b is null").select(F.col("tri_a").alias("node"))
    return reached(seeds, links).select(F.col("node").alias("tri_id"))


def marked(triangles: DataFrame, gone: DataFrame) -> DataFrame:
    """triangles with is_valid false for those in gone."""
    g = gone.select("tri_id", F.lit(True).alias("__gone")).distinct()
    return triangles.join(g, "tri_id", "left").withColumn("is_valid", F.col("__gone").isNull()).drop("__gone")


def cells(low_x: Column, low_y: Column, high_x: Column, high_y: Column, size: float) -> tuple[Column, Column]:
    """Sequences of grid cells that a box covers."""
    a = F.sequence(F.floor(low_x / size), F.floor(high_x / size))
    return a, F.sequence(F.floor(low_y / size), F.floor(high_y / size))


def cell_size(tv: DataFrame) -> float:
    """Half as large again as the mean box of a triangle: a few triangles per cell, a few cells per triangle."""
    m = tv.agg(F.avg(F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))).alias("m")).first()["m"]
    return 1.5 * m if m else 1.0


def locate(queries: DataFrame, tv: DataFrame, size: float | None = None, how: str = "left") -> DataFrame:
    """queries (qid, px, py) with the triangle that holds each point, NULL off the surface; borders go to the least id.

    An equi-join on grid cells with the containment test behind it: both sides are dealt by cell, so neither is
    broadcast unless small, and a crowded cell can be split by AQE.
    """
    size = size or cell_size(tv)
    cx, cy = cells(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), size)
    t = tv.withColumn("cx", F.explode(cx)).withColumn("cy", F.explode(cy))
    q = queries.withColumns({"cx": F.floor(F.col("px") / size), "cy": F.floor(F.col("py") / size)})
    hit = q.join(t, ["cx", "cy"]).where(v.inside_triangle(F.col("px"), F.col("py")))
    cols = [c for c in tv.columns if c != "tri_id"]
    best = hit.groupBy("qid").agg(F.min_by(F.struct("tri_id", *cols), "tri_id").alias("t")).select("qid", "t.*")
    return queries.join(best, "qid", how)


def covering_boxes(queries: DataFrame, tv: DataFrame, size: float | None = None) -> DataFrame:
    """(qid, tri_id) for all triangles whose box holds the point."""
    size = size or cell_size(tv)
    cx, cy = cells(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), size)
    t = tv.withColumn("cx", F.explode(cx)).withColumn("cy", F.explode(cy))
    q = queries.withColumns({"cx": F.floor(F.col("px") / size), "cy": F.floor(F.col("py") / size)})
    return q.join(t, ["cx", "cy"]).where("px between xmin and xmax and py between ymin and ymax").select("qid", "tri_id")


def point_results(queries: DataFrame, tv: DataFrame, size: float | None = None) -> DataFrame:
    """queries (qid, px, py) with tri_id, elevation, slope_pct, aspect and compass_aspect, NULL off the surface.

    Slopes and aspects are worked out once per triangle; the left join on cells keeps points off the surface, so one
    aggregation per point (borders go to the least id) is all that follows.
    """
    size = size or cell_size(tv)
    cx, cy = cells(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), size)
    corners = [f"{a}{k}" for k in (1, 2, 3) for a in "xy"]
    t = tv.select("tri_id", *corners, "z1", "nx", "ny", "nz", slope_pct().alias("slope_pct"), aspect().alias("aspect"), compass_aspect().alias("compass_aspect"), F.explode(cx).alias("tx"), cy.alias("ty"))
    t = t.withColumn("ty", F.explode("ty"))
    # a probe asked for several times comes back as often: each carries its own number
    q = queries.withColumns({"__probe": F.monotonically_increasing_id(), "cx": F.floor(F.col("px") / size), "cy": F.floor(F.col("py") / size)})
    hit = q.join(t, (q["cx"] == t["tx"]) & (q["cy"] == t["ty"]) & v.inside_triangle(F.col("px"), F.col("py")), "left")
    row = F.struct("tri_id", elevation(F.col("px"), F.col("py")).alias("elevation"), "slope_pct", "aspect", "compass_aspect")
    best = hit.groupBy("__probe", "qid", "px", "py").agg(F.min(F.when(F.col("tri_id").isNotNull(), row)).alias("r"))
    return best.select("qid", "px", "py", "r.*")


def point_measures(tv: DataFrame, hull: DataFrame) -> DataFrame:
    """(point_id, angle_sum, sparsity, is_hull, curvature): curvature is the angle defect, NULL on the hull."""
    a = interior_angles_3d()
    rows = tv.select(F.explode(F.array(*[F.struct(F.col(f"p{k}").alias("point_id"), a[k - 1].alias("angle"), area2d().alias("area")) for k in (1, 2, 3)])).alias("r")).select("r.*")
    per = rows.groupBy("point_id").agg(F.sum("angle").alias("angle_sum"), (F.sum("area") / 3.0).alias("sparsity"))
    per = per.join(hull.select("point_id", F.lit(True).alias("h")), "point_id", "left").withColumn("is_hull", F.coalesce("h", F.lit(False))).drop("h")
    return per.withColumn("curvature", F.when(~F.col("is_hull"), 2 * math.pi - F.col("angle_sum")))

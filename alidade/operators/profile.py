"""Vertical profiles: curves from VPIs, evaluation at both sides, scaling, adding, ray and surface intersections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alidade.functions.angles import azimuth, nullable_sum, pmod, root_by_false_position
from alidade.operators import alignment as al
from alidade.operators import pyramid
from alidade.operators import surface as s
from alidade.operators.ranges import lookup
from alidade.tables import written

CURVE = ["profile_id", "seq", "begin_sta", "end_sta", "begin_el", "g1", "g2", "is_gap"]


def curves(vpis: DataFrame) -> DataFrame:
    """Tangents and parabolic curves from (profile_id, station, elevation, vc_length): pieces of positive length.

    Each VPI's curve takes half its length on both sides; the tangent to the next VPI runs between the two curves.
    """
    w = Window.partitionBy("profile_id").orderBy("station")
    n = lambda c: F.lead(c).over(w)
    v = vpis.withColumns({"s2": n("station"), "e2": n("elevation"), "l2": n("vc_length"), "g_in": F.try_divide(F.col("elevation") - F.lag("elevation").over(w), F.col("station") - F.lag("station").over(w))})
    v = v.withColumn("g", F.try_divide(F.col("e2") - F.col("elevation"), F.col("s2") - F.col("station")))
    half, half2 = F.col("vc_length") / 2, F.coalesce(F.col("l2"), F.lit(0.0)) / 2
    curve = F.struct((F.col("station") - half).alias("begin_sta"), (F.col("station") + half).alias("end_sta"), (F.col("elevation") - F.col("g_in") * half).alias("begin_el"), F.col("g_in").alias("g1"), F.col("g").alias("g2"))
    tangent = F.struct((F.col("station") + half).alias("begin_sta"), (F.col("s2") - half2).alias("end_sta"), (F.col("elevation") + F.col("g") * half).alias("begin_el"), F.col("g").alias("g1"), F.col("g").alias("g2"))
    parts = v.select("profile_id", F.explode(F.array(curve, tangent)).alias("p")).select("profile_id", "p.*").where("end_sta > begin_sta and g1 is not null and g2 is not null")
    return numbered(parts.withColumn("is_gap", F.lit(False)))


def numbered(parts: DataFrame) -> DataFrame:
    w = Window.partitionBy("profile_id").orderBy("begin_sta")
    return parts.withColumn("seq", F.row_number().over(w)).select(*CURVE)


def polyline(soe: DataFrame) -> DataFrame:
    """Tangents between consecutive (profile_id, station, elevation)."""
    return curves(soe.withColumn("vc_length", F.lit(0.0)))


def constant(spark, profile_id, begin: float = 0.0, end: float = 1e12, elevation: float = 0.0) -> DataFrame:
    return spark.createDataFrame([(profile_id, 1, float(begin), float(end), float(elevation), 0.0, 0.0, False)], "profile_id long, seq int, begin_sta double, end_sta double, begin_el double, g1 double, g2 double, is_gap boolean")


def rate() -> Column:
    return F.try_divide(F.col("g2") - F.col("g1"), F.col("end_sta") - F.col("begin_sta"))


def elevation_at(sta: Column) -> Column:
    d = sta - F.col("begin_sta")
    return F.when(~F.col("is_gap"), F.col("begin_el") + F.col("g1") * d + d * d * rate() / 2)


def slope_at(sta: Column) -> Column:
    return F.when(~F.col("is_gap"), F.col("g1") + rate() * (sta - F.col("begin_sta")))


def k_value() -> Column:
    """Length per percent of grade change; NULL on a tangent."""
    return F.try_divide(F.lit(0.01), rate())


def back_ahead(stations: DataFrame, vcurves: DataFrame) -> DataFrame:
    """stations (profile_id, sid, sta) with elevation, slope and k from both sides (NULL off the profile) and
    is_single: both elevations there and equal within 5e-5. k is 0 on a PINC: both sides there, slopes unlike, at a joint."""
    one = F.struct(elevation_at(F.col("sta")).alias("el"), slope_at(F.col("sta")).alias("g"), k_value().alias("k"))
    # both sides from one look-up: a station on a joint meets two curves
    both = lookup(stations, "sta", vcurves, "begin_sta", "end_sta", ["profile_id"], (F.col("sta") >= F.col("begin_sta")) & (F.col("sta") <= F.col("end_sta")))
    hit = both.groupBy("profile_id", "sid").agg(F.max(F.when(F.col("sta") > F.col("begin_sta"), one)).alias("b"), F.max(F.when(F.col("sta") < F.col("end_sta"), one)).alias("a"), F.count("*").alias("meets"))
    out = stations.join(hit, ["profile_id", "sid"], "left")
    pinc = (F.col("meets") == 2) & (F.abs(F.col("b.g") - F.col("a.g")) > 1e-12)
    k = lambda c: F.when(pinc, 0.0).otherwise(F.col(f"{c}.k"))
    return out.select(
        "profile_id", "sid", "sta", F.col("b.el").alias("el_back"), F.col("a.el").alias("el_ahead"), F.col("b.g").alias("g_back"), F.col("a.g").alias("g_ahead"), k("b").alias("k_back"), k("a").alias("k_ahead"),
        F.coalesce(F.abs(F.col("b.el") - F.col("a.el")) < 5e-5, F.lit(False)).alias("is_single"),
    )


def elevations(stations: DataFrame, vcurves: DataFrame, extend: bool = False) -> DataFrame:
    """(profile_id, sid, sta, elevation): from ahead, or from behind where nothing is ahead; NULL off the profile, or
    the end's elevation if the profile is unconstrained (`extend`)."""
    v = back_ahead(stations, vcurves).select("profile_id", "sid", "sta", F.coalesce("el_ahead", "el_back").alias("elevation"))
    if not extend:
        return v
    ends = vcurves.groupBy("profile_id").agg(F.min("begin_sta").alias("b"), F.max("end_sta").alias("e"), F.min_by("begin_el", "begin_sta").alias("eb"), F.max_by(elevation_at(F.col("end_sta")), "end_sta").alias("ee"))
    v = v.join(ends, "profile_id", "left")
    return v.select("profile_id", "sid", "sta", F.coalesce("elevation", F.when(F.col("sta") < F.col("b"), F.col("eb")).when(F.col("sta") > F.col("e"), F.col("ee"))).alias("elevation"))


def scaled(vcurves: DataFrame, factor: float) -> DataFrame:
    return vcurves.withColumns({c: F.col(c) * factor for c in ("begin_el", "g1", "g2")})


def added(a: DataFrame, b: DataFrame, factor: float = 1.0, tasks: int | None = None) -> DataFrame:
    """a + factor * b per profile_id: pieces between all joints of both; where only one is there it alone counts,
    and a piece that neither covers is a gap. The joints are dealt to so many tasks, if given."""
    b = scaled(b, factor)
    joints = a.select("profile_id", F.explode(F.array("begin_sta", "end_sta")).alias("s")).union(b.select("profile_id", F.explode(F.array("begin_sta", "end_sta")).alias("s")))
    joints = (joints.repartition(tasks, "profile_id") if tasks else joints).distinct()
    w = Window.partitionBy("profile_id").orderBy("s")
    parts = joints.withColumn("e", F.lead("s").over(w)).where("e is not null")
    mids = parts.select("profile_id", F.col("s").alias("sid"), "e", ((F.col("s") + F.col("e")) / 2).alias("sta"))

    def side(c: DataFrame, tag: str) -> DataFrame:
        hit = lookup(mids, "sta", c.where("not is_gap"), "begin_sta", "end_sta", ["profile_id"], (F.col("sta") >= F.col("begin_sta")) & (F.col("sta") < F.col("end_sta")))
        return hit.select("profile_id", "sid", elevation_at(F.col("sid")).alias(f"el{tag}"), slope_at(F.col("sid")).alias(f"p{tag}"), slope_at(F.col("e")).alias(f"q{tag}"))

    m = mids.join(side(a, "a"), ["profile_id", "sid"], "left").join(side(b, "b"), ["profile_id", "sid"], "left")
    el, g1, g2 = (nullable_sum(F.col(f"{c}a"), F.col(f"{c}b")) for c in ("el", "p", "q"))
    rows = m.select("profile_id", F.col("sid").alias("begin_sta"), F.col("e").alias("end_sta"), el.alias("begin_el"), g1.alias("g1"), g2.alias("g2"))
    return numbered(rows.withColumn("is_gap", F.col("begin_el").isNull()))


def to_vpis(vcurves: DataFrame) -> DataFrame:
    """(profile_id, station, elevation): joints of a profile of tangents; ValueError if it has curves."""
    if not vcurves.where("abs(g1 - g2) > 1e-12").isEmpty():
        raise ValueError("the profile has vertical curves")
    first = vcurves.select("profile_id", F.col("begin_sta").alias("station"), F.col("begin_el").alias("elevation"))
    last = vcurves.groupBy("profile_id").agg(F.max("end_sta").alias("station"), F.max_by(elevation_at(F.col("end_sta")), "end_sta").alias("elevation"))
    return first.union(last)


def with_vpi(vpis: DataFrame, profile_id, station: float, elevation: float) -> DataFrame:
    """vpis with one more, in station order; ValueError if the profile has one there."""
    here = (F.col("profile_id") == F.lit(profile_id)) & (F.abs(F.col("station") - station) < 5e-5)
    if not vpis.where(here).isEmpty():
        raise ValueError("there is a VPI at this station")
    one = vpis.limit(0).sparkSession.range(1).select(F.lit(profile_id).cast(vpis.schema["profile_id"].dataType).alias("profile_id"), F.lit(float(station)).alias("station"), F.lit(float(elevation)).alias("elevation"), F.lit(0.0).alias("vc_length"))
    return vpis.select("profile_id", "station", "elevation", "vc_length").union(one)


def with_points(vpis: DataFrame, more: DataFrame) -> DataFrame:
    """VPIs with those of `more` (profile_id, station, elevation) before, behind or between them; the tangents are cut there.

    ValueError if a profile has vertical curves, or a VPI within 5e-5 of a new one.
    """
    if not vpis.where("vc_length != 0").isEmpty():
        raise ValueError("the profile has vertical curves")
    cols = ["profile_id", "station", "elevation", "vc_length"]
    all_ = vpis.select(*cols).union(more.withColumn("vc_length", F.lit(0.0)).select(*cols))
    w = Window.partitionBy("profile_id").orderBy("station")
    if not all_.withColumn("__gap", F.col("station") - F.lag("station").over(w)).where("__gap < 5e-5").isEmpty():
        raise ValueError("there is a VPI at this station")
    return all_


def with_segments(vcurves: DataFrame, more: DataFrame) -> DataFrame:
    """vcurves and raw pieces (profile_id, begin_sta, end_sta, begin_el, g1, g2, is_gap); a gap has no elevation or slope."""
    cols = ["profile_id", "begin_sta", "end_sta", "begin_el", "g1", "g2", "is_gap"]
    gap = {c: F.when(~F.col("is_gap"), F.col(c)) for c in ("begin_el", "g1", "g2")}
    return numbered(vcurves.select(*cols).union(more.withColumns(gap).select(*cols)))


def ray_hits(rays: DataFrame, vcurves: DataFrame) -> DataFrame:
    """(profile_id, ray_id, sta, el, place): where rays (profile_id, ray_id, s0, e0, m, advance +-1) meet the profile,
    nearest first.

    Curves come from a pyramid of least and greatest elevations over runs of them: a ray that passes above or below a run,
    or starts beyond it, goes no deeper.
    """
    c = written(pyramid.placed(vcurves.where("not is_gap"), ["profile_id"], "begin_sta"), "curves")
    end = elevation_at(F.col("end_sta"))
    turn = F.try_divide(-F.col("g1"), rate())  # where a parabola is level
    level = F.when((turn > 0) & (turn < F.col("end_sta") - F.col("begin_sta")), F.col("begin_el") + F.col("g1") * turn / 2)
    leaves = c.select("profile_id", "place", F.col("begin_sta").alias("ns0"), F.col("end_sta").alias("ns1"), F.least("begin_el", end, level).alias("nlow"), F.greatest("begin_el", end, level).alias("nhigh"))
    combine = lambda nodes, keys: nodes.groupBy(*keys).agg(F.min("ns0").alias("ns0"), F.max("ns1").alias("ns1"), F.min("nlow").alias("nlow"), F.max("nhigh").alias("nhigh"))
    # the ray's part over the run, on its own side
    back, on = F.when(F.col("advance") > 0, F.greatest("ns0", "s0")).otherwise(F.col("ns0")), F.when(F.col("advance") > 0, F.col("ns1")).otherwise(F.least("ns1", "s0"))
    e_back, e_on = (F.col("e0") + F.col("m") * (s - F.col("s0")) for s in (back, on))
    hair = 1e-9 * (1 + F.abs(e_back) + F.abs(e_on))
    test = (back <= on) & (F.least(e_back, e_on) - hair <= F.col("nhigh")) & (F.greatest(e_back, e_on) + hair >= F.col("nlow"))
    hit = pyramid.descend(rays, pyramid.levels(leaves, ["profile_id"], combine), ["profile_id"], test)
    r = hit.join(c, ["profile_id", "place"]).drop("place")
    # in d from the curve's begin: rate/2 d^2 + (g1 - m) d + (begin_el - ray elevation there) = 0
    a, b = rate() / 2, F.col("g1") - F.col("m")
    c = F.col("begin_el") - (F.col("e0") + F.col("m") * (F.col("begin_sta") - F.col("s0")))
    r = r.withColumns({"qa": a, "qb": b, "qc": c}).withColumn("disc", F.col("qb") * F.col("qb") - 4 * F.col("qa") * F.col("qc"))
    flat = F.abs("qa") < 1e-15
    root = F.sqrt(F.when(F.col("disc") >= 0, F.col("disc")))
    line = F.array(F.try_divide(-F.col("qc"), F.col("qb")))
    curve = F.array(F.try_divide(-F.col("qb") - root, 2 * F.col("qa")), F.try_divide(-F.col("qb") + root, 2 * F.col("qa")))
    hit = r.withColumn("d", F.explode(F.array_distinct(F.when(flat, line).otherwise(curve)))).where("d is not null and d >= 0 and d < end_sta - begin_sta")
    hit = hit.withColumn("sta", F.col("begin_sta") + F.col("d")).where("(sta - s0) * advance >= 0")
    hit = hit.withColumn("el", F.col("e0") + F.col("m") * (F.col("sta") - F.col("s0")))
    w = Window.partitionBy("profile_id", "ray_id").orderBy(F.floor(F.abs(F.col("sta") - F.col("s0")) * 1e6 + 0.5))
    return hit.withColumn("place", F.row_number().over(w)).select("profile_id", "ray_id", "sta", "el", "place")


def two_slopes_x(x1: Column, y1: Column, m1: Column, x2: Column, y2: Column, m2: Column) -> Column:
    """x at which two sloped lines meet; NULL if parallel."""
    return F.try_divide(y2 - y1 + m1 * x1 - m2 * x2, m1 - m2)


#: Share of a cell by which walks are widened, so that a crossing on a cell's border is found from both sides.
_HAIR = 1e-9
#: Most degrees that a piece of an arc or spiral turns; its tangent then meets a given direction once at most.
_TURN = 30.0


def _walk(df: DataFrame, size: float, wide: Column | float = 0.0) -> DataFrame:
    """df (wx0, wy0, wx1, wy1) with the cells gx, gy that the line between the two points passes within `wide`: columns first,
    then the rows that the line has in each column. Cells grow with its length, not with its box."""
    hair = wide + F.lit(size * _HAIR)
    df = df.withColumns({"wl": F.least("wx0", "wx1") - hair, "wr": F.greatest("wx0", "wx1") + hair})
    df = df.withColumn("gx", F.explode(F.sequence(F.floor(F.col("wl") / size), F.floor(F.col("wr") / size))))
    dx, dy = F.col("wx1") - F.col("wx0"), F.col("wy1") - F.col("wy0")
    at = lambda x: F.col("wy0") + F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - F.col("wx0")) / dx)) * dy
    steep = F.abs(dx) <= F.abs(dy) * 1e-12
    left, right = at(F.col("gx") * size - hair), at((F.col("gx") + 1) * size + hair)
    low = F.when(steep, F.least("wy0", "wy1")).otherwise(F.least(left, right))
    high = F.when(steep, F.greatest("wy0", "wy1")).otherwise(F.greatest(left, right))
    df = df.withColumns({"wl": low - hair, "wr": high + hair})
    return df.withColumn("gy", F.explode(F.sequence(F.floor(F.col("wl") / size), F.floor(F.col("wr") / size)))).drop("wl", "wr", "wx0", "wy0", "wx1", "wy1")


def _pieces(curved: DataFrame, size: float, point: Callable) -> DataFrame:
    """Arcs or spirals in pieces [l0, l1] of about a cell's length, walked along their chords, as wide as they bulge."""
    n = F.greatest(F.lit(1.0), F.ceil(F.col("length") / size), F.ceil(F.abs("turn") * 2 / _TURN))
    df = curved.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n") - 1).cast("long"))))
    df = df.withColumns({"l0": F.col("length") * F.col("i") / F.col("n"), "l1": F.col("length") * (F.col("i") + 1) / F.col("n")}).drop("i", "n")
    (ax, ay), (bx, by) = point(F.col("l0")), point(F.col("l1"))
    # a chord's arc rises by length^2 * curvature / 8 at most; a spiral's curvature ends at twice its mean
    bulge = (F.col("l1") - F.col("l0")) ** 2 * F.try_divide(F.radians(F.abs("turn")) * 2, F.col("length")) / 8
    return _walk(df.withColumns({"wx0": ax, "wy0": ay, "wx1": bx, "wy1": by}), size, bulge)


def _crossings(kind: str, segments: DataFrame, edges: DataFrame, size: float) -> DataFrame:
    """(align_id, station, elevation) of crossings of segments of one kind with edges, which may repeat."""
    ex, ey = F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya")

    def hit(t: Column, u: Column) -> Column:  # distance along the segment and part of the edge
        return F.struct(t.alias("l"), u.alias("u"))

    if kind == "line":
        g = _walk(segments.withColumns({"wx0": F.col("x0"), "wy0": F.col("y0"), "wx1": F.col("x1"), "wy1": F.col("y1")}), size)
        dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
        m = g.join(edges, ["gx", "gy"]).withColumn("det", dx * ey - dy * ex).where("det != 0")
        t = ((F.col("xa") - F.col("x0")) * ey - (F.col("ya") - F.col("y0")) * ex) / F.col("det")
        u = ((F.col("xa") - F.col("x0")) * dy - (F.col("ya") - F.col("y0")) * dx) / F.col("det")
        m = m.withColumn("h", hit(t * F.col("length"), u)).where("h.l >= 0 and h.l <= length")
    elif kind == "arc":
        m = _pieces(segments, size, al.arc_point).join(edges, ["gx", "gy"])
        # |a + u e - c|^2 = r^2
        fx, fy = F.col("xa") - F.col("cx"), F.col("ya") - F.col("cy")
        m = m.withColumns({"qa": ex * ex + ey * ey, "qb": ex * fx + ey * fy, "qc": fx * fx + fy * fy - F.col("radius") * F.col("radius")})
        m = m.withColumn("disc", F.col("qb") * F.col("qb") - F.col("qa") * F.col("qc")).where("disc >= 0 and qa > 0")
        m = m.withColumn("u", F.explode(F.array(*[(-F.col("qb") + sign * F.sqrt("disc")) / F.col("qa") for sign in (-1, 1)]))).where("u >= 0 and u <= 1")
        start = azimuth(F.col("x0") - F.col("cx"), F.col("y0") - F.col("cy"))
        way = pmod((azimuth(fx + F.col("u") * ex, fy + F.col("u") * ey) - start) * F.col("dir"), 360.0)
        m = m.withColumn("h", hit(F.try_divide(way, F.abs("turn")) * F.col("length"), F.col("u"))).where("h.l >= 0 and h.l <= length")
    else:
        course = al.FlatEnd
        m = _pieces(segments.withColumns(course.columns()), size, course.point).join(edges, ["gx", "gy"])
        m = m.withColumns({"e0": (F.col("flat_x") - F.col("xa")) * ey - (F.col("flat_y") - F.col("ya")) * ex, "eo": F.col("on_x") * ey - F.col("on_y") * ex, "er": F.col("right_x") * ey - F.col("right_y") * ex})

        def aside(l: Column) -> Column:  # of the edge's line, in its length
            return F.col("e0") + course.along(l, F.col("eo"), F.col("er"))

        # the piece runs along the edge's direction at one place at most; on both sides of it there is one crossing or none
        middle = F.least(F.col("l1"), F.greatest(F.col("l0"), F.coalesce(course.parallel(ex, ey), F.col("l0"))))
        m = m.withColumn("lm", F.explode(F.array(middle))).withColumns(  # exploded, so that it is worked out once
            {"f0": aside(F.col("l0")), "fm": aside(F.col("lm")), "f1": aside(F.col("l1"))}
        )
        m = m.where("least(f0, fm, f1) <= 0 and greatest(f0, fm, f1) >= 0")
        part = lambda a, b: F.struct(F.col(f"l{a}").alias("a"), F.col(f"l{b}").alias("b"), (F.col(f"f{a}") * F.col(f"f{b}") <= 0).alias("crossed"))
        m = m.withColumn("s", F.explode(F.array(part("0", "m"), part("m", "1")))).where("s.crossed and s.b > s.a").withColumns({"a": F.col("s.a"), "b": F.col("s.b")})
        m = m.withColumn("l", F.explode(F.array_compact(F.array(root_by_false_position(aside, F.col("a"), F.col("b"), F.lit(0.0))))))
        x, y = course.point(F.col("l"))
        m = m.withColumns({"px": x, "py": y})
        m = m.withColumn("h", hit(F.col("l"), ((F.col("px") - F.col("xa")) * ex + (F.col("py") - F.col("ya")) * ey) / (ex * ex + ey * ey)))
    m = m.where("h.u >= 0 and h.u <= 1")
    return m.select("align_id", (F.col("begin_sta") + F.col("h.l")).alias("station"), (F.col("za") + F.col("h.u") * (F.col("zb") - F.col("za"))).alias("elevation"))


def cut(tv, points: DataFrame, segments: DataFrame, size: float) -> DataFrame:
    """(align_id, station, elevation): crossings of valid surface edges and an alignment, one per 1e-4 of station.

    Edges and segments walk the cells of a grid and meet there by an equi-join, then by the crossing itself: of two lines,
    of an edge with an arc's circle within its sweep, or of an edge's line with a spiral, whose pieces are parted where they
    run along the edge so that each part crosses it once at most. Only kinds of segments that occur are in the plan.
    """
    e = s.edge_lengths(s.edges(tv), points)
    e = _walk(e.withColumns({"wx0": F.col("xa"), "wy0": F.col("ya"), "wx1": F.col("xb"), "wy1": F.col("yb")}), size).select("gx", "gy", "xa", "ya", "za", "xb", "yb", "zb")
    g = written(segments.where("x0 is not null"))
    found = None
    for kind in sorted(r.kind for r in g.select("kind").distinct().collect()):  # line, arc, spiral
        more = _crossings(kind, g.where(F.col("kind") == kind), e, size)
        found = more if found is None else found.unionByName(more)
    if found is None:
        return segments.sparkSession.createDataFrame([], "align_id long, station double, elevation double")
    best = found.groupBy("align_id", F.floor(F.col("station") * 10000 + 1e-6).alias("key")).agg(F.min(F.struct("station", "elevation")).alias("p"))
    return best.select("align_id", "p.station", "p.elevation")


def cut_at(tv, stations_xy: DataFrame) -> DataFrame:
    """stations (align_id, sid, sta, x, y) with the surface's elevation there, NULL off it."""
    q = stations_xy.where("x is not null").select(F.struct("align_id", "sid", "sta").alias("qid"), F.col("x").alias("px"), F.col("y").alias("py"))
    hit = s.locate(q, tv)
    return hit.select("qid.*", s.elevation(F.col("px"), F.col("py")).alias("elevation"))

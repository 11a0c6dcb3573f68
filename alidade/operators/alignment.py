"""Horizontal alignments: element chains, stationing, station <-> coordinates, regions, station text."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alidade.functions import vectors as v
from alidade.functions.angles import azimuth, deflection, pmod, radius, root_by_false_position
from alidade.operators import pyramid
from alidade.operators.ranges import lookup
from alidade.tables import written

KIND_TOLERANCE = 5e-5


def kind(d_in: Column, d_out: Column) -> Column:
    """line, arc or spiral from the degrees of curve at both ends."""
    return F.when(F.abs(d_in - d_out) < KIND_TOLERANCE, F.when(F.abs(d_in) < KIND_TOLERANCE, "line").otherwise("arc")).otherwise("spiral")


def spiral_xy(length: Column, theta: Column) -> tuple[Column, Column]:
    """Along and right of the flat end's tangent, for a signed angle theta in radians (five terms each)."""
    t2 = theta * theta
    x = length * (1 - t2 * (1 / 10 - t2 * (1 / 216 - t2 * (1 / 9360 - t2 / 685440))))
    y = length * theta * (1 / 3 - t2 * (1 / 42 - t2 * (1 / 1320 - t2 * (1 / 75600 - t2 / 6894720))))
    return x, y


def spiral_elements(length: Column, degree: Column) -> dict[str, Column]:
    """theta (deg), x, y, u, v of an Euler spiral from a tangent to a curve of `degree`."""
    th = F.radians(length * degree / 200.0)
    x, y = spiral_xy(length, th)
    return {"theta": F.degrees(th), "x": x, "y": y, "u": x - F.try_divide(y, F.tan(th)), "v": F.try_divide(y, F.sin(th))}


def _along(az: Column, along: Column, right: Column) -> tuple[Column, Column]:
    a = F.radians(az)
    return along * F.sin(a) + right * F.cos(a), along * F.cos(a) - right * F.sin(a)


def turned(k: Column, length: Column, d_in: Column, d_out: Column) -> Column:
    """Deflection of an element in degrees, right positive."""
    return F.when(k == "line", 0.0).when(k == "arc", length * d_in / 100.0).otherwise(length * (d_in + d_out) / 200.0)


def _vector(k: Column, length: Column, d_in: Column, d_out: Column, az: Column, turn: Column) -> tuple[Column, Column]:
    """From an element's begin to its end."""
    r = F.abs(radius(d_in))
    chord = F.coalesce(2 * r * F.sin(F.radians(F.abs(turn) / 2)), length)
    ax, ay = _along(az + turn / 2, chord, F.lit(0.0))
    sx, sy = spiral_xy(length, F.radians(turn))
    opens = F.abs(d_in) < KIND_TOLERANCE  # from the tangent into the curve; else out of it, laid out from its end
    ox, oy = _along(az, sx, sy)
    cx, cy = _along(az + turn, sx, -sy)
    lx, ly = _along(az, length, F.lit(0.0))
    pick = lambda line, arc, o, c: F.when(k == "line", line).when(k == "arc", arc).when(opens, o).otherwise(c)
    return pick(lx, ax, ox, cx), pick(ly, ay, oy, cy)


def chain(elements: DataFrame, heads: DataFrame) -> DataFrame:
    """Segments from (align_id, seq, degree_in, length, degree_out) and (align_id, x, y, station, azimuth_deg).

    Azimuths are a running sum of deflections, begin points one of chord vectors, stations one of lengths: three
    windows over an alignment's elements, no recursion. Spirals between two curves (both degrees non-zero and
    unlike) have no layout here and get NULL coordinates, as do the elements behind them.
    """
    w = Window.partitionBy("align_id").orderBy("seq")
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    e = elements.join(heads, "align_id")
    e = e.withColumn("kind", kind(F.col("degree_in"), F.col("degree_out")))
    e = e.withColumn("turn", turned(F.col("kind"), F.col("length"), F.col("degree_in"), F.col("degree_out")))
    e = e.withColumn("az0", pmod(F.col("azimuth_deg") + F.coalesce(F.sum("turn").over(prior), F.lit(0.0)), 360.0))
    e = e.withColumn("az1", pmod(F.col("az0") + F.col("turn"), 360.0))
    dx, dy = _vector(F.col("kind"), F.col("length"), F.col("degree_in"), F.col("degree_out"), F.col("az0"), F.col("turn"))
    e = e.withColumns({"dx": dx, "dy": dy})
    run = lambda c: F.coalesce(F.sum(c).over(prior), F.lit(0.0))
    e = e.withColumns({"x0": F.col("x") + run("dx"), "y0": F.col("y") + run("dy"), "begin_sta": F.col("station") + run("length")})
    e = e.withColumns({"x1": F.col("x0") + F.col("dx"), "y1": F.col("y0") + F.col("dy"), "end_sta": F.col("begin_sta") + F.col("length"), "dir": F.signum(F.col("turn"))})
    r = F.when(F.col("kind") == "arc", F.abs(radius(F.col("degree_in"))))
    cx, cy = v.at_azimuth(F.col("x0"), F.col("y0"), F.col("az0") + 90.0 * F.col("dir"), F.col("radius"))
    e = e.withColumn("radius", r).withColumns({"cx": cx, "cy": cy})
    last = F.row_number().over(Window.partitionBy("align_id").orderBy(F.col("seq").desc())) == 1
    keep = ["align_id", "seq", "kind", "degree_in", "degree_out", "length", "turn", "dir", "az0", "az1", "x0", "y0", "x1", "y1", "begin_sta", "end_sta", "radius", "cx", "cy"]
    return e.withColumn("is_last", last).select(*keep, "is_last")


def lines_from_points(points: DataFrame) -> DataFrame:
    """Segments, in the shape of chain, of polylines (align_id, seq, x, y): each point to the next. Stations run from the
    points' begin_sta, if there is such a column, else from 0."""
    w = Window.partitionBy("align_id").orderBy("seq")
    p = points.withColumns({"x1": F.lead("x").over(w), "y1": F.lead("y").over(w)}).where("x1 is not null")
    p = p.withColumns({"length": v.base_length(F.col("x1") - F.col("x"), F.col("y1") - F.col("y")), "az0": azimuth(F.col("x1") - F.col("x"), F.col("y1") - F.col("y"))})
    start = F.first("begin_sta").over(w) if "begin_sta" in points.columns else F.lit(0.0)
    begin = start + F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    p = p.withColumn("begin_sta", begin)
    last = F.row_number().over(Window.partitionBy("align_id").orderBy(F.col("seq").desc())) == 1
    none = F.lit(None).cast("double")
    return p.select(
        "align_id", "seq", F.lit("line").alias("kind"), F.lit(0.0).alias("degree_in"), F.lit(0.0).alias("degree_out"), "length", F.lit(0.0).alias("turn"), F.lit(0.0).alias("dir"),
        "az0", F.col("az0").alias("az1"), F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1", "begin_sta", (F.col("begin_sta") + F.col("length")).alias("end_sta"),
        none.alias("radius"), none.alias("cx"), none.alias("cy"), last.alias("is_last"),
    )


def arc_from_points(x0: Column, y0: Column, x1: Column, y1: Column, az: Column, r: Column) -> dict[str, Column]:
    """Arc from begin, end, incoming azimuth and radius: centre, direction, sweep, length, and the end on the circle."""
    side = v.side(x1, y1, x0, y0, x0 + F.sin(F.radians(az)), y0 + F.cos(F.radians(az)))
    d = F.when(side <= 0, 1.0).otherwise(-1.0)
    cx, cy = v.at_azimuth(x0, y0, az + 90.0 * d, r)
    a0, a1 = azimuth(x0 - cx, y0 - cy), azimuth(x1 - cx, y1 - cy)
    sweep = pmod((a1 - a0) * d, 360.0)
    ex, ey = v.at_azimuth(cx, cy, a1, r)
    return {"cx": cx, "cy": cy, "dir": d, "turn": d * sweep, "length": F.radians(sweep) * r, "x1": ex, "y1": ey}


def arc_from_bulge(x0: Column, y0: Column, x1: Column, y1: Column, bulge: Column) -> dict[str, Column]:
    """Arc of a polyline vertex: sweep 4 atan |b|, positive bulge to the left."""
    sweep = 4.0 * F.atan(F.abs(bulge))
    chord = v.base_length(x1 - x0, y1 - y0)
    r = F.try_divide(chord, 2 * F.sin(sweep / 2))
    turn = F.degrees(sweep) * -F.signum(bulge)
    az0 = pmod(azimuth(x1 - x0, y1 - y0) - turn / 2, 360.0)
    return {"az0": az0, "turn": turn, "radius": r, "length": sweep * r}


def arc_from_centre(x0: Column, y0: Column, cx: Column, cy: Column, x1: Column, y1: Column, d: Column, outside: Column) -> dict[str, Column]:
    """Arc from begin, centre and end: the shorter way round, or (`outside`) the way that turns to d, right 1, left -1.

    All NULL if both ends are not on one circle, within 0.00014.
    """
    r, r1 = v.base_length(x0 - cx, y0 - cy), v.base_length(x1 - cx, y1 - cy)
    a0, a1 = azimuth(x0 - cx, y0 - cy), azimuth(x1 - cx, y1 - cy)
    turn = F.when(F.abs(r - r1) <= 0.00014, F.when(outside, d * pmod((a1 - a0) * d, 360.0)).otherwise(deflection(a0, a1)))
    side = F.signum(turn)
    return {"radius": F.when(turn.isNotNull(), r), "turn": turn, "length": F.radians(F.abs(turn)) * r, "az0": pmod(a0 + 90.0 * side, 360.0), "az1": pmod(a1 + 90.0 * side, 360.0)}


def stationed(pieces: DataFrame, begin: float = 0.0) -> DataFrame:
    """Segments in the shape of chain from pieces in order (align_id, seq, x0, y0, x1, y1, az0, turn, length, radius, cx, cy);
    a piece without radius is a line. Stations run on from `begin`."""
    w = Window.partitionBy("align_id").orderBy("seq")
    arc = F.col("radius").isNotNull()
    d = F.signum("turn")
    deg = F.when(arc, d * F.try_divide(F.lit(18000.0), math.pi * F.col("radius"))).otherwise(0.0)
    s = pieces.withColumns({"kind": F.when(arc, "arc").otherwise("line"), "dir": d, "degree_in": deg, "degree_out": deg, "az1": pmod(F.col("az0") + F.col("turn"), 360.0)})
    s = s.withColumn("begin_sta", begin + F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumns({"end_sta": F.col("begin_sta") + F.col("length"), "is_last": F.lead("seq").over(w).isNull()})
    keep = ["align_id", "seq", "kind", "degree_in", "degree_out", "length", "turn", "dir", "az0", "az1", "x0", "y0", "x1", "y1", "begin_sta", "end_sta", "radius", "cx", "cy", "is_last"]
    return s.select(*keep)


def from_bulges(sides: DataFrame) -> DataFrame:
    """Segments of polylines whose sides (align_id, seq, x0, y0, x1, y1, bulge) are lines (bulge 0) and arcs."""
    x0, y0, x1, y1, bulge = (F.col(c) for c in ("x0", "y0", "x1", "y1", "bulge"))
    arc = arc_from_bulge(x0, y0, x1, y1, bulge)
    bent = F.abs(bulge) > 1e-12
    dx, dy = x1 - x0, y1 - y0
    p = sides.withColumns({
        "az0": F.when(bent, arc["az0"]).otherwise(azimuth(dx, dy)), "turn": F.when(bent, arc["turn"]).otherwise(0.0),
        "length": F.when(bent, arc["length"]).otherwise(v.base_length(dx, dy)), "radius": F.when(bent, arc["radius"]),
    })
    cx, cy = v.at_azimuth(x0, y0, F.col("az0") + 90.0 * F.signum("turn"), F.col("radius"))
    return stationed(p.withColumns({"cx": cx, "cy": cy}))


def from_pieces(pieces: DataFrame, tol: float = 1.5e-4) -> DataFrame:
    """Segments of alignments given as pieces in any order: (align_id, pid, x0, y0, x1, y1, cx, cy, d, outside).

    A piece without centre is a line, else an arc as in arc_from_centre. Raises as ordered_pieces does.
    """
    x0, y0, x1, y1, cx, cy = (F.col(c) for c in ("x0", "y0", "x1", "y1", "cx", "cy"))
    arc = arc_from_centre(x0, y0, cx, cy, x1, y1, F.col("d"), F.col("outside"))
    bent, dx, dy = cx.isNotNull(), x1 - x0, y1 - y0
    p = ordered_pieces(pieces, tol, "align_id").withColumns({
        "az0": F.when(bent, arc["az0"]).otherwise(azimuth(dx, dy)), "turn": F.when(bent, arc["turn"]).otherwise(0.0),
        "length": F.when(bent, arc["length"]).otherwise(v.base_length(dx, dy)), "radius": F.when(bent, arc["radius"]), "seq": F.col("place"),
    })
    return stationed(p)


def alignments_box(segments: DataFrame) -> DataFrame:
    """One row: xmin, ymin, xmax, ymax of all segments, the bulges of arcs included."""
    b = arc_box()
    return segments.agg(F.min(b["xmin"]).alias("xmin"), F.min(b["ymin"]).alias("ymin"), F.max(b["xmax"]).alias("xmax"), F.max(b["ymax"]).alias("ymax"))


def spiral_anchor() -> Column:
    """Station of the row's spiral at its flat end: its begin if it opens from a tangent, its end if it closes to one;
    NULL for spirals between curves and for what is no spiral."""
    spiral = F.col("kind") == "spiral"
    return F.when(spiral & (F.abs("degree_in") < KIND_TOLERANCE), F.col("begin_sta")).when(spiral & (F.abs("degree_out") < KIND_TOLERANCE), F.col("end_sta"))


def arc_point(l: Column) -> tuple[Column, Column]:
    """x and y at distance l along the row's arc."""
    start = azimuth(F.col("x0") - F.col("cx"), F.col("y0") - F.col("cy"))
    return v.at_azimuth(F.col("cx"), F.col("cy"), start + F.col("turn") * l / F.col("length"), F.col("radius"))


class FlatEnd:
    """Spirals seen from their flat ends: columns to add to the rows, and the course in terms of them."""

    @staticmethod
    def columns() -> dict[str, Column]:
        """The flat end's place, the unit vectors onward and to the right, the way from there to l (spiral_from +
        spiral_way * l), and the angle there by the square of the way."""
        opens = F.abs(F.col("degree_in")) < KIND_TOLERANCE
        either = lambda a, b: F.when(opens, a).otherwise(b)
        az = F.radians(either(F.col("az0"), F.col("az1")))
        way = either(F.lit(1.0), F.lit(-1.0))
        return {
            "flat_x": either(F.col("x0"), F.col("x1")), "flat_y": either(F.col("y0"), F.col("y1")),
            "on_x": way * F.sin(az), "on_y": way * F.cos(az), "right_x": F.cos(az), "right_y": -F.sin(az),
            "spiral_from": either(F.lit(0.0), F.col("length")), "spiral_way": way, "spiral_bend": F.radians("turn") / (F.col("length") * F.col("length")),
        }

    @staticmethod
    def along(l: Column, onward: Column, right: Column) -> Column:
        """onward * (distance along the flat tangent at l) + right * (distance beside it)."""
        way = F.col("spiral_from") + F.col("spiral_way") * l
        x, y = spiral_xy(way, F.col("spiral_bend") * way * way)
        return onward * x + right * y

    @classmethod
    def point(cls, l: Column) -> tuple[Column, Column]:
        return F.col("flat_x") + cls.along(l, F.col("on_x"), F.col("right_x")), F.col("flat_y") + cls.along(l, F.col("on_y"), F.col("right_y"))

    @staticmethod
    def aside(l: Column, onward: Column, right: Column) -> tuple[Column, Column]:
        """How far a place, given by its distances along the flat tangent and beside it, lies along the course at l (seen from
        the flat end), and how far to the right of it."""
        way = F.col("spiral_from") + F.col("spiral_way") * l
        th = F.col("spiral_bend") * way * way
        x, y = spiral_xy(way, th)
        return (onward - x) * F.cos(th) + (right - y) * F.sin(th), (right - y) * F.cos(th) - (onward - x) * F.sin(th)

    @staticmethod
    def parallel(dx: Column, dy: Column) -> Column:
        """l at which the spiral runs along the direction (dx, dy), one way or the other; NULL if nowhere.

        The angle from the flat tangent grows with the square of the way. Of several such places on a spiral of half a
        turn and more, the one nearest to the flat end is given.
        """
        way, bend = F.col("spiral_way"), F.col("spiral_bend")
        # on a spiral that is run against its course, the angle seen from the flat end turns the other way
        need = pmod(F.degrees(F.atan2(dx, dy) - F.atan2(-F.col("right_y"), F.col("right_x"))) * F.signum(bend * way), 180.0)
        back = F.sqrt(F.radians(need) / F.abs(bend))
        return F.when(back <= F.col("length"), (back - F.col("spiral_from")) * way)


def _apart(a: Column, b: Column) -> Column:
    """Angle between two azimuths, 0 to 180."""
    return 180 - F.abs(pmod(a - b, 360.0) - 180)


def _courses(segments: DataFrame) -> list[DataFrame]:
    """Pyramid over segments (align_id, place): boxes and, around a middle azimuth, the azimuths that occur in them."""
    box = arc_box()
    bulge = F.when(F.col("kind") == "spiral", F.col("length") * F.radians(F.abs("turn")) / 4).otherwise(F.lit(0.0))  # length^2 * curvature / 8
    leaves = segments.select(
        "align_id", "place", (box["xmin"] - bulge).alias("bx0"), (box["xmax"] + bulge).alias("bx1"), (box["ymin"] - bulge).alias("by0"), (box["ymax"] + bulge).alias("by1"),
        pmod(F.col("az0") + F.col("turn") / 2, 360.0).alias("mid"), (F.abs("turn") / 2).alias("swing"),
    )

    def combine(nodes: DataFrame, keys: list[str]) -> DataFrame:
        parts = F.collect_list(F.struct("mid", "swing")).alias("parts")  # FAN of them
        sums = [F.sum(F.sin(F.radians("mid"))).alias("sx"), F.sum(F.cos(F.radians("mid"))).alias("sy")]
        g = nodes.groupBy(*keys).agg(F.min("bx0").alias("bx0"), F.max("bx1").alias("bx1"), F.min("by0").alias("by0"), F.max("by1").alias("by1"), *sums, parts)
        g = g.withColumn("mid", pmod(F.degrees(F.atan2("sx", "sy")), 360.0))
        swing = F.array_max(F.transform("parts", lambda p: _apart(p["mid"], F.col("mid")) + p["swing"]))
        return g.select(*keys, "bx0", "bx1", "by0", "by1", "mid", swing.alias("swing"))

    return pyramid.levels(leaves, ["align_id"], combine)


def _projecting(points: DataFrame, segments: DataFrame) -> DataFrame:
    """points (align_id, px, py, ...) beside the segments that they may project on.

    A point projects where the way to it is square to the course. Over a run of segments the part of that way along the
    course has both signs, or the run goes: of a box's middle, give or take its radius, in the directions that occur.
    """
    segments = written(pyramid.placed(segments.where("x0 is not null"), ["align_id"], "seq"), "segments")
    vx, vy = F.col("px") - (F.col("bx0") + F.col("bx1")) / 2, F.col("py") - (F.col("by0") + F.col("by1")) / 2
    far, radius_ = v.base_length(vx, vy), v.base_length(F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0")) / 2
    angle = _apart(F.degrees(F.atan2(vx, vy)), F.col("mid"))
    hair = 1e-6 + 1e-9 * far
    ahead = far * F.cos(F.radians(F.greatest(F.lit(0.0), angle - F.col("swing")))) + radius_ >= -hair
    behind = far * F.cos(F.radians(F.least(F.lit(180.0), angle + F.col("swing")))) - radius_ <= hair
    hit = pyramid.descend(points, _courses(segments), ["align_id"], ahead & behind)
    return hit.join(segments, ["align_id", "place"]).drop("place")


def spiral_to_station(points: DataFrame, segments: DataFrame) -> DataFrame:
    """points (align_id, pid, px, py) with the spirals that they project on: seq, sta, off (right positive).

    Candidates come from a pyramid over the spirals. The foot is where the way to the point is square to the spiral, found
    by false position along it.
    """
    p = _projecting(points.select("align_id", "pid", "px", "py"), segments.where("kind = 'spiral'")).withColumns(FlatEnd.columns())
    dx, dy = F.col("px") - F.col("flat_x"), F.col("py") - F.col("flat_y")
    p = p.withColumns({"onward": dx * F.col("on_x") + dy * F.col("on_y"), "right": dx * F.col("right_x") + dy * F.col("right_y")})

    def off(l: Column) -> tuple[Column, Column]:
        return FlatEnd.aside(l, F.col("onward"), F.col("right"))

    hair = 1e-6  # so that the feet at both ends are found whatever the rounding
    foot = root_by_false_position(lambda l: off(l)[0], F.lit(-hair), F.col("length") + hair, F.lit(0.0))
    p = p.withColumn("l", F.explode(F.array_compact(F.array(foot))))  # exploded, so that no filter repeats the search
    return p.select("align_id", "pid", "seq", (F.col("begin_sta") + F.col("l")).alias("sta"), off(F.col("l"))[1].alias("off"))


def arc_box() -> dict[str, Column]:
    """Box of the row's segment: its ends, and for an arc the compass points within its sweep."""
    a0 = azimuth(F.col("x0") - F.col("cx"), F.col("y0") - F.col("cy"))
    sweep = F.abs(F.col("turn"))
    hit = lambda card: (F.col("kind") == "arc") & (pmod((F.lit(float(card)) - a0) * F.col("dir"), 360.0) <= sweep)
    return {
        "xmin": F.least("x0", "x1", F.when(hit(270), F.col("cx") - F.col("radius"))),
        "xmax": F.greatest("x0", "x1", F.when(hit(90), F.col("cx") + F.col("radius"))),
        "ymin": F.least("y0", "y1", F.when(hit(180), F.col("cy") - F.col("radius"))),
        "ymax": F.greatest("y0", "y1", F.when(hit(0), F.col("cy") + F.col("radius"))),
    }


def _at(l: Column, offset: Column) -> tuple[Column, Column, Column]:
    """x, y and azimuth at distance l along the row's segment, offset to the right."""
    k = F.col("kind")
    lx, ly = _along(F.col("az0"), l, offset)
    swept = F.col("dir") * F.abs(F.col("degree_in")) * l / 100.0
    a0 = azimuth(F.col("x0") - F.col("cx"), F.col("y0") - F.col("cy"))
    ax, ay = v.at_azimuth(F.col("cx"), F.col("cy"), a0 + swept, F.col("radius") - F.col("dir") * offset)
    opens = F.abs(F.col("degree_in")) < KIND_TOLERANCE
    back = F.when(opens, l).otherwise(F.col("length") - l)  # from the flat end
    th = F.radians(F.col("turn")) * F.coalesce(F.try_divide(back, F.col("length")), F.lit(0.0)) ** 2
    sx, sy = spiral_xy(back, th)
    ox, oy = _along(F.col("az0"), sx, sy)
    cx, cy = _along(F.col("az1"), -sx, sy)  # seen from the end, the way back
    base_x, base_y = F.when(opens, F.col("x0") + ox).otherwise(F.col("x1") + cx), F.when(opens, F.col("y0") + oy).otherwise(F.col("y1") + cy)
    s_az = F.when(opens, F.col("az0") + F.degrees(th)).otherwise(F.col("az1") - F.degrees(th))
    px, py = _along(s_az, F.lit(0.0), offset)
    az = F.when(k == "line", F.col("az0")).when(k == "arc", F.col("az0") + swept).otherwise(s_az)
    x = F.when(k == "line", F.col("x0") + lx).when(k == "arc", ax).otherwise(base_x + px)
    y = F.when(k == "line", F.col("y0") + ly).when(k == "arc", ay).otherwise(base_y + py)
    return x, y, pmod(az, 360.0)


def station_to_xy(stations: DataFrame, segments: DataFrame, compat: bool = False) -> DataFrame:
    """stations (align_id, sid, sta, offset) with seq, x, y, azimuth; NULL off the alignment's ends.

    The end station belongs to the last segment; with `compat` it is off the end.
    """
    at = (F.col("sta") >= F.col("begin_sta")) & ((F.col("sta") < F.col("end_sta")) | (F.lit(not compat) & F.col("is_last") & (F.col("sta") == F.col("end_sta"))))
    hit = lookup(stations, "sta", segments, "begin_sta", "end_sta", ["align_id"], at)
    x, y, az = _at(F.col("sta") - F.col("begin_sta"), F.col("offset"))
    hit = hit.select("align_id", "sid", F.col("seq"), x.alias("x"), y.alias("y"), az.alias("azimuth"))
    return stations.join(hit, ["align_id", "sid"], "left")


def stations_at(segments: DataFrame, step: float) -> DataFrame:
    """(align_id, sid, sta): begin, every step behind it, and the end."""
    per = segments.groupBy("align_id").agg(F.min("begin_sta").alias("b"), F.max("end_sta").alias("e"))
    n = F.ceil((F.col("e") - F.col("b")) / step - 1e-9)
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(0)))).alias("sid")
    rows = per.select("align_id", "b", "e", k)
    return rows.select("align_id", "sid", F.least(F.col("b") + F.col("sid") * step, F.col("e")).alias("sta"))


def xy_to_station(points: DataFrame, segments: DataFrame) -> DataFrame:
    """points (align_id, pid, px, py) with every segment that they project on: seq, sta, off, place by |off|.

    Candidates come from a pyramid over the alignment's segments, so that their number follows that of the feet. Spirals
    are left out, as in the chain of lines and arcs that station listing works on; spiral_to_station projects on those.
    """
    p = _projecting(points, segments.where("kind != 'spiral'"))
    dx, dy = F.col("px") - F.col("x0"), F.col("py") - F.col("y0")
    a = F.radians(F.col("az0"))
    l_line, o_line = dx * F.sin(a) + dy * F.cos(a), dx * F.cos(a) - dy * F.sin(a)
    dist = v.base_length(F.col("px") - F.col("cx"), F.col("py") - F.col("cy"))
    turn = deflection(azimuth(F.col("x0") - F.col("cx"), F.col("y0") - F.col("cy")), azimuth(F.col("px") - F.col("cx"), F.col("py") - F.col("cy")))
    wide = F.when((F.abs(F.col("turn")) > 180) & (turn * F.col("dir") < 0), turn + 360.0 * F.col("dir")).otherwise(turn)
    l_arc = F.try_divide(F.col("length") * wide, F.col("turn"))
    o_arc = F.col("dir") * (F.col("radius") - dist)
    line = F.col("kind") == "line"
    p = p.withColumns({"l": F.when(line, l_line).when(F.col("kind") == "arc", l_arc), "off": F.when(line, o_line).when(F.col("kind") == "arc", o_arc)})
    hit = p.where("l >= 0 and l <= length").select("align_id", "pid", "seq", (F.col("begin_sta") + F.col("l")).alias("sta"), "off")
    w = Window.partitionBy("align_id", "pid").orderBy(F.floor(F.abs("off") * 1e6 + 0.5), "seq")
    return hit.withColumn("place", F.row_number().over(w))


def with_true_stations(regions: DataFrame) -> DataFrame:
    """regions (align_id, region, begin_sta, end_sta) with true_begin: the running length of the regions before."""
    w = Window.partitionBy("align_id").orderBy("region").rowsBetween(Window.unboundedPreceding, -1)
    return regions.withColumn("true_begin", F.coalesce(F.sum(F.col("end_sta") - F.col("begin_sta")).over(w), F.lit(0.0)))


def to_region_station(true_stations: DataFrame, regions: DataFrame) -> DataFrame:
    """(align_id, sid, true_sta) with region, sta and extended (the part beyond the last region's end)."""
    r = with_true_stations(regions).withColumn("true_end", F.col("true_begin") + F.col("end_sta") - F.col("begin_sta"))
    last = r.groupBy("align_id").agg(F.max_by(F.struct("region", "begin_sta", "end_sta", "true_begin", "true_end"), "region").alias("z"))
    hit = lookup(true_stations, "true_sta", r, "true_begin", "true_end", ["align_id"], (F.col("true_sta") >= F.col("true_begin")) & (F.col("true_sta") < F.col("true_end")))
    hit = hit.select("align_id", "sid", "region", (F.col("begin_sta") + F.col("true_sta") - F.col("true_begin")).alias("sta"))
    out = true_stations.join(hit, ["align_id", "sid"], "left").join(last, "align_id", "left")
    over = F.col("region").isNull() & (F.col("true_sta") >= F.col("z.true_end"))
    return out.select(
        "align_id", "sid", "true_sta",
        F.when(over, F.col("z.region")).otherwise(F.col("region")).alias("region"),
        F.when(over, F.col("z.end_sta")).otherwise(F.col("sta")).alias("sta"),
        F.when(over, F.col("true_sta") - F.col("z.true_end")).otherwise(F.lit(0.0)).alias("extended"),
    )


def region_stations(rows: DataFrame, segments: DataFrame, regions: DataFrame) -> DataFrame:
    """rows (align_id, station, ...) with region, sta and extended by the table of regions; stations run along the alignment
    from its begin, whatever it is called there. Alignments without regions keep their stations and have NULL regions."""
    begins = segments.groupBy("align_id").agg(F.min("begin_sta").alias("__begin"))
    keyed = rows.join(begins, "align_id").withColumn("__true", F.col("station") - F.col("__begin"))
    asked = keyed.select("align_id", F.col("__true").alias("sid"), F.col("__true").alias("true_sta")).distinct()
    found = to_region_station(asked, regions).select("align_id", F.col("sid").alias("__true"), "region", "sta", "extended")
    out = keyed.join(found, ["align_id", "__true"], "left").withColumn("sta", F.coalesce("sta", "station"))
    return out.drop("__true", "__begin")


def end_checks(segments: DataFrame, ends: DataFrame) -> DataFrame:
    """(align_id, miss, azimuth_miss, station_miss): how far the chain's end is from where ends (align_id, x, y, station,
    azimuth_deg) say; the azimuth's in degrees, signed; NULL where nothing is said or there is no chain."""
    last = segments.where("is_last").select("align_id", "x1", "y1", "az1", "end_sta")
    miss = v.base_length(F.col("x1") - F.col("x"), F.col("y1") - F.col("y"))
    turn = pmod(F.col("az1") - F.col("azimuth_deg") + 180.0, 360.0) - 180.0
    return ends.join(last, "align_id", "left").select("align_id", miss.alias("miss"), turn.alias("azimuth_miss"), (F.col("end_sta") - F.col("station")).alias("station_miss"))


def station_text(sta: Column, region: Column | None = None, extended: Column | None = None) -> Column:
    """12+34.56, with ' R 2' for a region and ' [ext.]' off the ends."""
    cents = F.floor(F.abs(sta) * 100 + 0.5).cast("long")
    text = F.concat(F.when(sta < 0, "-").otherwise(""), F.floor(cents / 10000).cast("string"), F.lit("+"), F.format_string("%05.2f", (cents % 10000) / 100.0))
    if region is not None:
        text = F.concat(text, F.coalesce(F.concat(F.lit(" R "), region.cast("string")), F.lit("")))
    if extended is not None:
        text = F.concat(text, F.when(F.coalesce(extended, F.lit(0.0)) != 0, " [ext.]").otherwise(""))
    return text


def station_value(text: Column) -> Column:
    """Of '12+34.56' (region and marks ignored); NULL if it is no station."""
    head = F.split(F.trim(text), " ")[0]
    return F.regexp_replace(head, r"\+", "").try_cast("double")


def event_points(segments: DataFrame) -> DataFrame:
    """(align_id, place, x, y): the first begin and every end."""
    first = segments.where("seq = 0 or begin_sta is not null").groupBy("align_id").agg(F.min_by(F.struct("x0", "y0"), "seq").alias("p")).select("align_id", F.lit(-1).cast("long").alias("place"), F.col("p.x0").alias("x"), F.col("p.y0").alias("y"))
    return first.union(segments.select("align_id", F.col("seq").cast("long"), "x1", "y1"))


def rollup(segments: DataFrame) -> DataFrame:
    """Per alignment: begin, end, length, number of segments, last arc's deflection."""
    arc = F.max(F.when(F.col("kind") == "arc", F.struct("seq", "turn")))["turn"]
    return segments.groupBy("align_id").agg(F.min("begin_sta").alias("begin_sta"), F.max("end_sta").alias("end_sta"), F.sum("length").alias("length"), F.count("*").alias("n"), arc.alias("last_arc_turn"))


def ordered_pieces(pieces: DataFrame, tol: float = 1.5e-4, by: str | None = None) -> DataFrame:
    """pieces (pid, x0, y0, x1, y1) with place from 0: each begins where the one before ends, within tol.

    With `by`, a column, each of its values is a chain of its own with its own pid. Ends are matched on keys of tol-sized
    cells and their neighbours. Positions come by pointer doubling: log2 rounds of an equi-join, each written. ValueError
    unless there is exactly one first piece and all pieces are reached, in each chain.
    """
    from alidade.tables import drop, written

    # broadcasts would bring the rows of each round through the driver
    merged = lambda rows: rows.hint("merge")
    own = pieces.withColumn("__by", F.col(by) if by else F.lit(0))
    cell = lambda x, y, i, j: [F.floor(F.col(x) / tol) + i, F.floor(F.col(y) / tol) + j]
    begins = own.select("__by", F.col("pid").alias("next"), F.col("x0").alias("bx"), F.col("y0").alias("by"), *[c.alias(n) for c, n in zip(cell("x0", "y0", 0, 0), ("kx", "ky"))])
    around = F.array(*[F.struct(*[c.alias(n) for c, n in zip(cell("x1", "y1", i, j), ("kx", "ky"))]) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    ends = own.select("__by", "pid", "x1", "y1", F.explode(around).alias("k")).select("__by", "pid", "x1", "y1", "k.*")
    near = (F.abs(F.col("x1") - F.col("bx")) <= tol) & (F.abs(F.col("y1") - F.col("by")) <= tol) & (F.col("pid") != F.col("next"))
    after = written(ends.join(merged(begins), ["__by", "kx", "ky"]).where(near).select("__by", "pid", "next").distinct())
    first = own.select("__by", "pid").join(merged(after.select("__by", F.col("next").alias("pid"))), ["__by", "pid"], "left_anti")
    counts = own.select("__by", F.lit(1).alias("n"), F.lit(0).alias("links"), F.lit(0).alias("firsts"))
    counts = counts.union(after.select("__by", F.lit(0), F.lit(1), F.lit(0))).union(first.select("__by", F.lit(0), F.lit(0), F.lit(1)))
    counts = counts.groupBy("__by").agg(*[F.sum(c).alias(c) for c in ("n", "links", "firsts")])
    bad = counts.where("firsts != 1 or links != n - 1").first()
    if bad:
        raise ValueError(f"{bad['firsts']} first pieces and {bad['links']} joints for {bad['n']} pieces")
    # jump = the piece 2^k before, place = how many pieces were passed
    state = own.select("__by", "pid").join(merged(after.select("__by", F.col("next").alias("pid"), F.col("pid").alias("jump"))), ["__by", "pid"], "left")
    state = written(state.withColumn("place", F.when(F.col("jump").isNotNull(), 1).otherwise(0).cast("long")))
    while not state.where("jump is not null").isEmpty():
        far = state.select("__by", F.col("pid").alias("jump"), F.col("jump").alias("jump2"), F.col("place").alias("more"))
        before, state = state, written(state.join(merged(far), ["__by", "jump"], "left").select("__by", "pid", F.col("jump2").alias("jump"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place")))
        drop(before)
    return own.join(merged(state.select("__by", "pid", "place")), ["__by", "pid"]).drop("__by")


class Editor:
    """Freehand alignment building: begin with two points, append arcs and tangents, take back the last."""

    def __init__(self, x0: float, y0: float, x1: float, y1: float):
        self.parts: list[dict] = []
        self.reset(x0, y0, x1, y1)

    def reset(self, x0, y0, x1, y1):
        self.parts = [{"kind": "line", "x0": x0, "y0": y0, "x1": x1, "y1": y1, "az0": math.degrees(math.atan2(x1 - x0, y1 - y0)) % 360, "turn": 0.0, "radius": None, "length": math.hypot(x1 - x0, y1 - y0)}]

    def _end(self):
        p = self.parts[-1]
        return p["x1"], p["y1"], (p["az0"] + p["turn"]) % 360

    def append_arc(self, x: float, y: float):
        """Tangent to the last part, through (x, y)."""
        x0, y0, az = self._end()
        chord = math.hypot(x - x0, y - y0)
        d = (math.degrees(math.atan2(x - x0, y - y0)) - az + 180) % 360 - 180
        if chord == 0 or abs(d) < 1e-12:
            raise ValueError("the point lies on the tangent")
        r = chord / (2 * abs(math.sin(math.radians(d))))
        self.parts.append({"kind": "arc", "x0": x0, "y0": y0, "x1": x, "y1": y, "az0": az, "turn": 2 * d, "radius": r, "length": math.radians(abs(2 * d)) * r})

    def append_tangent(self, x: float, y: float):
        """A line to (x, y); an arc before it is swept on or back until it is tangent to that line."""
        last = self.parts[-1]
        if last["kind"] == "arc":
            s = math.copysign(1, last["turn"])
            a = math.radians(last["az0"] + 90 * s)
            cx, cy = last["x0"] + last["radius"] * math.sin(a), last["y0"] + last["radius"] * math.cos(a)
            far = math.hypot(x - cx, y - cy)
            if far < last["radius"]:
                raise ValueError("the point lies inside the arc's circle")
            to = math.degrees(math.atan2(x - cx, y - cy))
            touch = to - s * math.degrees(math.acos(last["radius"] / far))
            begin = math.degrees(math.atan2(last["x0"] - cx, last["y0"] - cy))
            sweep = ((touch - begin) * s) % 360
            last |= {"turn": s * sweep, "length": math.radians(sweep) * last["radius"], "x1": cx + last["radius"] * math.sin(math.radians(touch)), "y1": cy + last["radius"] * math.cos(math.radians(touch))}
        x0, y0, _ = self._end()
        self.parts.append({"kind": "line", "x0": x0, "y0": y0, "x1": x, "y1": y, "az0": math.degrees(math.atan2(x - x0, y - y0)) % 360, "turn": 0.0, "radius": None, "length": math.hypot(x - x0, y - y0)})

    def remove_last(self):
        if len(self.parts) > 1:
            self.parts.pop()

    def rows(self) -> list[dict]:
        """Segments with seq and stations."""
        sta, out = 0.0, []
        for k, p in enumerate(self.parts):
            out.append(p | {"seq": k, "begin_sta": sta, "end_sta": sta + p["length"]})
            sta += p["length"]
        return out


def in_sweep(px: Column, py: Column) -> Column:
    """Whether the direction from the row's arc centre to a point lies within the arc's sweep."""
    a0 = azimuth(F.col("x0") - F.col("cx"), F.col("y0") - F.col("cy"))
    a1 = azimuth(px - F.col("cx"), py - F.col("cy"))
    return pmod((a1 - a0) * F.col("dir"), 360.0) <= F.abs(F.col("turn"))


def moved(segments: DataFrame, dx: float, dy: float) -> DataFrame:
    """segments shifted by a vector."""
    shift = {c: F.col(c) + d for d, cs in ((dx, ("x0", "x1", "cx")), (dy, ("y0", "y1", "cy"))) for c in cs}
    return segments.withColumns(shift)


def long_chords(segments: DataFrame) -> DataFrame:
    """(align_id, seq, chord, chord_az): from each segment's begin to its end."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return segments.select("align_id", "seq", v.base_length(dx, dy).alias("chord"), azimuth(dx, dy).alias("chord_az"))


def cross_sections(stations: DataFrame, segments: DataFrame, left: float, right: float) -> DataFrame:
    """stations (align_id, sid, sta) with the ends of a section across: lx, ly at -left and rx, ry at +right."""
    ends = None
    for tag, off in (("l", -abs(left)), ("r", abs(right))):
        p = station_to_xy(stations.select("align_id", "sid", "sta").withColumn("offset", F.lit(float(off))), segments)
        p = p.select("align_id", "sid", *([] if ends is not None else ["sta"]), F.col("x").alias(f"{tag}x"), F.col("y").alias(f"{tag}y"))
        ends = p if ends is None else ends.join(p, ["align_id", "sid"])
    return ends

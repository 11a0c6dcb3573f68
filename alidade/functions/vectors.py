"""Points and vectors as triples of columns, rays, boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from alidade.functions.angles import pmod

V = tuple[Column, Column, Column]


def xyz(prefix: str = "", suffix: str = "") -> V:
    return tuple(F.col(f"{prefix}{a}{suffix}") for a in "xyz")


def vec(start: V, end: V) -> V:
    return tuple(e - s for s, e in zip(start, end))


def cross(a: V, b: V) -> V:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def dot(a: V, b: V) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def length(a: V) -> Column:
    return F.sqrt(dot(a, a))


def base_length(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def theta(n: V) -> Column:
    """Angle from the vertical."""
    return F.atan2(F.sqrt(n[0] * n[0] + n[1] * n[1]), n[2])


def angle_between(a: V, b: V) -> Column:
    """In radians; NULL if a vector has no length, 0 where rounding leaves the cosine outside [-1, 1]."""
    c = F.try_divide(dot(a, b), length(a) * length(b))
    return F.when(c.isNotNull(), F.coalesce(F.nanvl(F.acos(c), F.lit(0.0)), F.lit(0.0)))


def at_azimuth(x: Column, y: Column, az_deg: Column, dist: Column) -> tuple[Column, Column]:
    return x + dist * F.sin(F.radians(az_deg)), y + dist * F.cos(F.radians(az_deg))


def rotated(dx: Column, dy: Column, right: bool) -> tuple[Column, Column]:
    return (dy, -dx) if right else (-dy, dx)


def ray_intersection(ax: Column, ay: Column, a_az: Column, bx: Column, by: Column, b_az: Column) -> dict[str, Column]:
    """u, x, y and status ('ok', 'parallel', 'behind'): where two rays meet, NULL unless ok."""
    adx, ady = F.sin(F.radians(a_az)), F.cos(F.radians(a_az))
    bdx, bdy = F.sin(F.radians(b_az)), F.cos(F.radians(b_az))
    det = bdx * ady - bdy * adx
    flat = F.abs(det) < 1e-12
    u = F.when(~flat, F.try_divide((by - ay) * bdx - (bx - ax) * bdy, det))
    w = F.when(~flat, F.try_divide((by - ay) * adx - (bx - ax) * ady, det))
    status = F.when(flat, "parallel").when((u < -1e-9) | (w < -1e-9), "behind").otherwise("ok")
    ok = status == "ok"
    return {"u": F.when(ok, u), "x": F.when(ok, ax + u * adx), "y": F.when(ok, ay + u * ady), "status": status}


def in_box(x: Column, y: Column, box: tuple | None) -> Column:
    """Closed on all sides; no box lets every point pass."""
    if box is None:
        return F.lit(True)
    return x.between(F.lit(float(box[0])), F.lit(float(box[2]))) & y.between(F.lit(float(box[1])), F.lit(float(box[3])))


def in_box3(x: Column, y: Column, z: Column, box: tuple | None) -> Column:
    """As in_box, with (xmin, ymin, xmax, ymax, zmin, zmax)."""
    if box is None:
        return F.lit(True)
    return in_box(x, y, box) & z.between(F.lit(float(box[4])), F.lit(float(box[5])))


def ray_offset(px: Column, py: Column, x0: Column, y0: Column, az_deg: Column) -> Column:
    """Distance of a point from the line of a ray, right of its direction positive."""
    a = F.radians(az_deg)
    return (px - x0) * F.cos(a) - (py - y0) * F.sin(a)


def ray_line(x0: Column, z0: Column, slope: Column, advance: Column) -> dict[str, Column]:
    """m and b of z = m x + b for a sloped ray that advances to greater (1) or lesser (-1) x; NULL slope is vertical."""
    m = slope * advance
    return {"m": m, "b": z0 - x0 * m}


def ray_elevation(x: Column, x0: Column, z0: Column, slope: Column) -> Column:
    """Elevation of a sloped ray at x; NULL where it is vertical or the run has not the sign of the slope."""
    run = x - x0
    return F.when(F.signum(run) == F.signum(slope), z0 + run * slope)


def boxes_overlap(a: V, b: V) -> Column:
    """a and b are (xmin, ymin, xmax, ymax); touching boxes overlap."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def same_point(a: V, b: V) -> Column:
    """Within 0.006 horizontally and 0.0025 vertically."""
    return (base_length(a[0] - b[0], a[1] - b[1]) < 0.006) & (F.abs(a[2] - b[2]) < 0.0025)


def side(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (px - bx) * (ay - by) - (ax - bx) * (py - by)


def inside_triangle(px: Column, py: Column) -> Column:
    """Of the row's triangle x1..y3, borders included, whatever its orientation."""
    c = [F.col(f"{a}{k}") for k in (1, 2, 3) for a in "xy"]
    s = [side(px, py, *c[0:4]), side(px, py, *c[2:6]), side(px, py, *c[4:6], *c[0:2])]
    neg = [v < 0 for v in s]
    return (neg[0] == neg[1]) & (neg[1] == neg[2])


def turn_modulo(v: Column) -> Column:
    return pmod(v, 360.0)


def same_truncated(x1: Column, y1: Column, x2: Column, u1: Column, w1: Column, u2: Column) -> Column:
    """Whether whole parts of three coordinates agree (a quick edge match)."""
    whole = lambda c: c.cast("bigint")
    return (whole(x1) == whole(u1)) & (whole(y1) == whole(w1)) & (whole(x2) == whole(u2))

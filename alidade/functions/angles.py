"""Angles, azimuths, deflections, degree of curve and slopes. Azimuths are degrees clockwise from +y."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TURN = 360.0


def rounded(v: Column, places: int = 6) -> Column:
    """floor(v * 10^p + 0.5) / 10^p: the same in every engine, unlike round()."""
    k = float(10**places)
    return F.floor(v * k + 0.5).cast("double") / k


def pmod(v: Column, m: float) -> Column:
    return v - F.floor(v / m) * m


def dms_to_degrees(d: Column, m: Column, s: Column) -> Column:
    """Degrees, minutes and seconds; the sign of the degrees holds for all three."""
    sign = F.when(d < 0, -1.0).otherwise(1.0)
    return sign * (F.abs(d) + m / 60.0 + s / 3600.0)


def normalised(rad: Column) -> Column:
    """To (-pi, pi]."""
    return F.atan2(F.sin(rad), F.cos(rad))


def scaled_remainder(value: Column, unit: float) -> Column:
    """What is left of value after the nearest whole number of units (halves away from zero), in units."""
    turns = value / unit
    whole = F.when(turns >= 0, F.floor(turns + 0.5)).otherwise(F.ceil(turns - 0.5))
    return turns - whole


def into_range(deg: Column, low: float, high: float) -> Column:
    """deg shifted by whole spans into [low, high]; a value on the upper end stays there."""
    span = high - low
    off = deg - low
    steps = F.floor(off / span)
    moved = low + off - steps * span
    return F.when((deg >= low) & (deg <= high), deg).otherwise(moved)


def azimuth(dx: Column, dy: Column) -> Column:
    """0 at +y, clockwise, [0, 360)."""
    return pmod(90.0 - F.degrees(F.atan2(dy, dx)), TURN)


def math_angle(dx: Column, dy: Column) -> Column:
    """0 at +x, counter-clockwise, [0, 360)."""
    return pmod(F.degrees(F.atan2(dy, dx)), TURN)


def reverse(az: Column) -> Column:
    return pmod(az + 180.0, TURN)


def quadrant(az: Column) -> Column:
    return (F.floor(pmod(az, TURN) / 90.0) + 1).cast("int")


def plus_deflection(az: Column, deflection: Column) -> Column:
    return pmod(az + deflection, TURN)


def deflection(from_az: Column, to_az: Column) -> Column:
    """Signed turn from one azimuth to another, in (-180, 180]; right is positive."""
    d = pmod(to_az - from_az, TURN)
    return F.when(d > 180.0, d - TURN).otherwise(d)


def azimuth_difference(a: Column, b: Column) -> Column:
    """a - b in [-90, 270): a result of the fourth quadrant turns negative, others keep their sign."""
    d = pmod(a - b, TURN)
    return F.when(d >= 270.0, d - TURN).otherwise(d)


def deflection_complement(d: Column) -> Column:
    """The turn the other way round to the same direction."""
    return F.when(d >= 0, d - TURN).otherwise(d + TURN)


def radius(degree: Column) -> Column:
    """Of a curve of `degree` degrees per 100 units of arc; NULL for a straight line."""
    return F.try_divide(F.lit(18000.0), F.lit(math.pi) * degree)


def degree_of_curve(r: Column) -> Column:
    return F.try_divide(F.lit(18000.0), F.lit(math.pi) * r)


def slope(run: Column, rise: Column) -> Column:
    """rise / run; NULL when vertical."""
    return F.try_divide(rise, run)


def slope_text(s: Column) -> Column:
    """As '2.50%' up to 1:10 and as 'n:1' when steeper; 'Vertical' for NULL."""
    ratio = F.concat(F.format_string("%.1f", F.try_divide(F.lit(1.0), F.abs(s))), F.lit(":1"))
    return F.when(s.isNull(), "Vertical").when(F.abs(s) <= 0.1, F.concat(F.format_string("%.2f", s * 100.0), F.lit("%"))).otherwise(ratio)


def same_angle(a: Column, b: Column, tol: float = 1e-5) -> Column:
    return F.abs(normalised(a - b)) < tol


def tolerant_compare(a: Column, b: Column, tol: float) -> Column:
    """-1, 0 or 1; values closer than tol are equal."""
    return F.when(F.abs(a - b) < tol, 0).when(a > b, 1).otherwise(-1)


def nullable_sum(a: Column, b: Column) -> Column:
    """Sum of what is there; NULL if neither is."""
    return F.when(a.isNull() & b.isNull(), F.lit(None).cast("double")).otherwise(F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))


def reciprocal_sum(a: Column, b: Column) -> Column:
    """1 / (1/a + 1/b), as parallel resistors add; a missing side leaves the other."""
    both = F.try_divide(a * b, a + b)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def y_from_x(x: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """On the line through two points; NULL if it is vertical."""
    return y1 + (x - x1) * F.try_divide(y2 - y1, x2 - x1)


def x_from_y(y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """On the line through two points; NULL if it is level."""
    return x1 + (y - y1) * F.try_divide(x2 - x1, y2 - y1)


def root_by_false_position(f, low: Column, high: Column, target: Column, steps: int = 24) -> Column:
    """x in [low, high] with f(x) = target, for a monotone f given as Column -> Column; NULL if the ends do not bracket it.

    A fixed number of Illinois steps, folded over a literal array, so the plan does not grow with the steps.
    """
    def g(x: Column) -> Column:
        return f(x) - target

    start = F.struct(low.alias("a"), high.alias("b"), g(low).alias("fa"), g(high).alias("fb"))

    def bound(value: Column, body) -> Column:  # so that the value is worked out once, not wherever it stands in the body
        return F.transform(F.array(value), body)[0]

    def step(s: Column, _: Column) -> Column:
        def onward(x: Column, fx: Column) -> Column:
            crossed = fx * s["fb"] < 0
            return F.struct(F.when(crossed, s["b"]).otherwise(s["a"]).alias("a"), x.alias("b"), F.when(crossed, s["fb"]).otherwise(s["fa"] / 2).alias("fa"), fx.alias("fb"))

        x = F.coalesce(F.try_divide(s["a"] * s["fb"] - s["b"] * s["fa"], s["fb"] - s["fa"]), s["b"])
        return bound(x, lambda x: bound(g(x), lambda fx: onward(x, fx)))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["b"])
    return F.when(g(low) * g(high) <= 0, found)

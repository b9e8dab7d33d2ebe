"""Numbers and plane geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(x: Column, least: int = 1) -> Column:
    """The whole part of a number of at least `least`, else null."""
    n = x.try_cast("double").cast("int")
    return F.when(n >= least, n)


def angle_difference(a: Column, b: Column) -> Column:
    """Between directions without sense: modulo 180, at most 90."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180.0 - d)


def normal_angle(a: Column) -> Column:
    return F.pmod(a + 90.0, F.lit(180.0)) - 90.0


def along(dx: Column, dy: Column, angle: Column) -> Column:
    """Length of a step along an axis."""
    return dx * F.cos(F.radians(angle)) + dy * F.sin(F.radians(angle))


def rotated(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    c, s = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    return x * c - y * s, x * s + y * c


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of boxes (left, top, width, height); 0 for empty ones."""
    w = F.greatest(F.lit(0.0), F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1]))
    return F.coalesce(F.try_divide(w * h, a[2] * a[3] + b[2] * b[3] - w * h), F.lit(0.0))


def level_of(lane: Column, root: Column, step: Column) -> Column:
    return F.bround((lane - root) / step).cast("int")


def lane_of(branch: Column, left: Column) -> Column:
    return F.coalesce(F.nanvl(branch.cast("double"), F.lit(None).cast("double")), left.cast("double"))


def clamped(base: float, most: float, *terms: tuple[Column, float]) -> Column:
    """A linear score, at most `most`."""
    total = F.lit(base)
    for x, slope in terms:
        total = total + x * slope
    return F.least(F.lit(most), total)


def clipped_box(left: Column, top: Column, width: Column, height: Column, margin: int, far_x: Column, far_y: Column) -> Column:
    """A box with a margin, kept inside the picture."""
    x, y = F.greatest(F.lit(0), left - margin), F.greatest(F.lit(0), top - margin)
    return F.struct(x.alias("left"), y.alias("top"), F.least(far_x, left + width + margin).alias("right"), F.least(far_y, top + height + margin).alias("bottom"))

"""Axis-aligned boxes and point lists as column expressions. A box is struct(x0, y0, x1, y1)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1"))


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def common_area(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])) * F.greatest(zero, F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))


def clip(a: Column, b: Column) -> Column:
    """The part of a inside b; null without an overlap."""
    x0, y0, x1, y1 = F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"])
    return F.when((x0 < x1) & (y0 < y1), box(x0, y0, x1, y1))


def cover(a: Column, b: Column) -> Column:
    return box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def inflate(b: Column, by: float) -> Column:
    return box(b["x0"] - by, b["y0"] - by, b["x1"] + by, b["y1"] + by)


def inflate_by(b: Column, by: Column) -> Column:
    return box(b["x0"] - by, b["y0"] - by, b["x1"] + by, b["y1"] + by)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for degenerate boxes."""
    common = common_area(a, b)
    total = area(a) + area(b) - common
    return F.when(total > 0, common / total).otherwise(0.0)


def contained(inner: Column, outer: Column) -> Column:
    """Share of the inner box that the outer covers; 0 for a degenerate inner box."""
    return F.when(area(inner) > 0, common_area(inner, outer) / area(inner)).otherwise(0.0)


def covers(b: Column, x: Column, y: Column) -> Column:
    return (x >= b["x0"]) & (x <= b["x1"]) & (y >= b["y0"]) & (y <= b["y1"])


def point_distance(b: Column, x: Column, y: Column) -> Column:
    """0 inside, else the distance to the rectangle."""
    zero = F.lit(0.0)
    return F.hypot(F.greatest(zero, b["x0"] - x, x - b["x1"]), F.greatest(zero, b["y0"] - y, y - b["y1"]))


def path_length(points: Column) -> Column:
    """Length of a list of struct(x, y)."""
    steps = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, d: s + d)


def ring_area(points: Column) -> Column:
    """Area inside a ring that is closed from its last point to its first; 0 under three points."""
    n = F.size(points)
    turns = F.transform(points, lambda p, i: p["x"] * F.get(points, (i + 1) % n)["y"] - F.get(points, (i + 1) % n)["x"] * p["y"])
    return F.when(n < 3, 0.0).otherwise(F.abs(F.aggregate(turns, F.lit(0.0), lambda s, t: s + t)) / 2)


def circle_points(x: Column, y: Column, r: Column, n: int = 48) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((x + r * F.cos(i * (2 * math.pi / n))).alias("x"), (y + r * F.sin(i * (2 * math.pi / n))).alias("y")))


def arc_points(x: Column, y: Column, r: Column, start: Column, end: Column, n: int = 24) -> Column:
    """n points from one angle (degrees) to another; an end before the start goes round."""
    a, b = F.radians(start), F.radians(F.when(end < start, end + 360).otherwise(end))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((x + r * F.cos(a + (b - a) * i / (n - 1))).alias("x"), (y + r * F.sin(a + (b - a) * i / (n - 1))).alias("y")))


def to_pixels(x: Column, y: Column, frame: Column, size: Column) -> tuple[Column, Column]:
    """Uniform scale into a square image of size pixels, centred, with y downward."""
    scale = size / F.greatest(width(frame), height(frame))
    return (
        (x - frame["x0"]) * scale + (size - width(frame) * scale) / 2,
        size - ((y - frame["y0"]) * scale + (size - height(frame) * scale) / 2),
    )


def thousandths(b: Column) -> Column:
    """A box whose ends, ordered and held within 0 and 1000, become parts of 1."""
    held = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1000.0), c)) / 1000
    return box(held(b["x0"]), held(b["y0"]), held(b["x1"]), held(b["y1"]))


def angle(a: Column, b: Column) -> Column:
    """Direction of a segment in degrees, modulo 180."""
    d = F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"]))
    return F.pmod(d, F.lit(180.0))

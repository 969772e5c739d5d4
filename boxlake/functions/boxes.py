"""Measures of boxes and pairs of boxes as column expressions; boxes are structs or prefixes of columns."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keeps quotients of degenerate boxes finite.
EPS = 1e-7
Box = Callable[[str], Column]


def columns(prefix: str = "") -> Box:
    """The box in the columns <prefix>x_min, y_min, x_max, y_max."""
    return lambda name: F.col(prefix + name).cast("double")


def fields(struct: Column) -> Box:
    return lambda name: struct[name].cast("double")


def width(b: Box) -> Column:
    return b("x_max") - b("x_min")


def height(b: Box) -> Column:
    return b("y_max") - b("y_min")


def area(b: Box) -> Column:
    return width(b) * height(b)


def center(b: Box) -> tuple[Column, Column]:
    return (b("x_min") + b("x_max")) / 2, (b("y_min") + b("y_max")) / 2


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a("x_max"), b("x_max")) - F.greatest(a("x_min"), b("x_min"))
    h = F.least(a("y_max"), b("y_max")) - F.greatest(a("y_min"), b("y_min"))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is empty."""
    shared = intersection(a, b)
    return F.coalesce(F.try_divide(shared, area(a) + area(b) - shared), F.lit(0.0))


def ios(a: Box, b: Box) -> Column:
    """Intersection over the smaller area; 0 where that is empty."""
    return F.coalesce(F.try_divide(intersection(a, b), F.least(area(a), area(b))), F.lit(0.0))


def ciou(a: Box, b: Box) -> Column:
    """Complete IoU: IoU less the centres' distance and the difference of aspect ratios."""
    overlap = iou(a, b)
    hull_w = F.greatest(a("x_max"), b("x_max")) - F.least(a("x_min"), b("x_min"))
    hull_h = F.greatest(a("y_max"), b("y_max")) - F.least(a("y_min"), b("y_min"))
    (ax, ay), (bx, by) = center(a), center(b)
    apart = (ax - bx) * (ax - bx) + (ay - by) * (ay - by)
    turn = F.atan(width(a) / height(a)) - F.atan(width(b) / height(b))
    v = F.lit(4 / math.pi**2) * turn * turn
    return overlap - apart / (hull_w * hull_w + hull_h * hull_h + EPS) - v * v / (1 - overlap + v + EPS)


#: Measures by name; callers may pass a function of two boxes instead.
MEASURES: dict[str, Callable[[Box, Box], Column]] = {"iou": iou, "ciou": ciou, "ios": ios}


def measure(name: str | Callable[[Box, Box], Column]) -> Callable[[Box, Box], Column]:
    if callable(name):
        return name
    if name not in MEASURES:
        raise ValueError(f"measure must be one of {sorted(MEASURES)} or a function, not {name!r}")
    return MEASURES[name]


def clipped(c: Column) -> Column:
    return F.greatest(c, F.lit(0))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.transform(F.array(value), use)[0]


def polygon_area(points: Column) -> Column:
    """Area of a polygon, an array of structs x, y, by the shoelace sum; 0 with fewer than 3 points."""

    def shoelace(p: Column) -> Column:
        n = F.size(p)
        return F.abs(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + p[i]["x"] * p[(i + 1) % n]["y"] - p[(i + 1) % n]["x"] * p[i]["y"])) / 2

    return bound(points, lambda p: F.when(F.size(p) >= 3, shoelace(p)).otherwise(0.0))


def rotated_corners(cx: Column, cy: Column, w: Column, h: Column, angle: Column) -> Column:
    """Corners of a rotated box (angle in radians, from the x axis towards the y axis), in order."""
    c, s = F.cos(angle), F.sin(angle)
    corner = lambda i, j: F.struct((cx + i * w / 2 * c - j * h / 2 * s).alias("x"), (cy + i * w / 2 * s + j * h / 2 * c).alias("y"))
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))


def clipped_polygon(subject: Column, window: Column) -> Column:
    """The part of a convex polygon inside another, whose corners are in the same turn (x to y): each
    edge of the window cuts off what lies on its outer side."""
    none = F.array().cast("array<struct<x:double,y:double>>")

    def cut(poly: Column, k: Column) -> Column:
        a, b = window[k], window[(k + 1) % F.size(window)]
        side = lambda p: (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])

        def edge(i: Column) -> Column:
            p, q = poly[i], poly[(i + 1) % F.size(poly)]
            t = F.try_divide(side(p), side(p) - side(q))
            cross = F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y"))
            own = F.when(side(p) >= 0, F.array(p)).otherwise(none)
            return F.when((side(p) >= 0) != (side(q) >= 0), F.concat(own, F.array(cross))).otherwise(own)

        return F.when(F.size(poly) == 0, none).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), F.size(poly) - 1), edge)))

    return F.aggregate(F.sequence(F.lit(0), F.size(window) - 1), subject, cut)

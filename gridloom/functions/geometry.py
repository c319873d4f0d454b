"""Boxes and points as column expressions. A box is four columns or struct fields x, y, w, h."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = Sequence[Column]


def box(of: str | Column = "", names: Sequence[str] = ("x", "y", "w", "h")) -> list[Column]:
    """Columns of a box: of a struct column, or named with a prefix."""
    if isinstance(of, Column):
        return [of[n] for n in names]
    return [F.col(f"{of}{n}") for n in names]


def area(b: Box) -> Column:
    return b[2] * b[3]


def center(start: Column, extent: Column) -> Column:
    return start + F.floor(extent / 2)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 for disjoint boxes and where the union is empty."""
    wide = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    high = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    common = (wide * high).cast("double")
    union = area(a) + area(b) - common
    return F.when((wide < 0) | (high < 0) | (union <= 0), 0.0).otherwise(common / F.when(union > 0, union))


def overlaps(a: Box, b: Box, threshold: float = 0.5) -> Column:
    return iou(a, b) > threshold


def line_intersection(rho1: Column, theta1: Column, rho2: Column, theta2: Column) -> Column:
    """Point (px, py) where two lines in normal form meet; null if they are nearly parallel."""
    det = F.cos(theta1) * F.sin(theta2) - F.sin(theta1) * F.cos(theta2)
    px = (F.sin(theta2) * rho1 - F.sin(theta1) * rho2) / det
    py = (F.cos(theta1) * rho2 - F.cos(theta2) * rho1) / det
    return F.when(F.abs(det) >= 1e-10, F.struct(px.alias("px"), py.alias("py")))


def corner_angles(points: Sequence[tuple[Column, Column]]) -> list[Column]:
    """Angles in degrees at the corners of a polygon, in order."""
    out = []
    for i, (x, y) in enumerate(points):
        (ax, ay), (bx, by) = points[i - 1], points[(i + 1) % len(points)]
        dot = (ax - x) * (bx - x) + (ay - y) * (by - y)
        size = F.sqrt((ax - x) * (ax - x) + (ay - y) * (ay - y)) * F.sqrt((bx - x) * (bx - x) + (by - y) * (by - y))
        out.append(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (size + 1e-10))))))
    return out


def plausible_quad(points: Sequence[tuple[Column, Column]], low: float = 60.0, high: float = 120.0) -> Column:
    ok = F.lit(True)
    for angle in corner_angles(points):
        ok = ok & angle.between(low, high)
    return ok


def ordered_corners(points: Column) -> Column:
    """Corners tl, tr, br, bl of an array of structs (x, y): least and greatest x + y, least and greatest y - x; the
    first of equals."""
    spot = lambda key: F.transform(points, lambda p, i: F.struct(key(p).alias("k"), i.alias("i")))
    first = lambda s: points[F.array_min(s)["i"]]
    by_sum, by_diff = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    return F.struct(
        first(spot(by_sum)).alias("tl"), first(spot(by_diff)).alias("tr"),
        first(spot(lambda p: -by_sum(p))).alias("br"), first(spot(lambda p: -by_diff(p))).alias("bl"),
    )


def clamped(c: Column) -> Column:
    """A normalized coordinate, held within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def pixel(share: Column, extent: Column) -> Column:
    return (share * extent).cast("long")

"""Geometric annotations as Column expressions.

An annotation is (shape, coordinates array<double>, label, metadata): RECTANGLE
[x_min, y_min, x_max, y_max], ELLIPSE [cx, cy, rx, ry], POLYGON [x0, y0, x1, y1, ...].
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RECTANGLE, ELLIPSE, POLYGON = "RECTANGLE", "ELLIPSE", "POLYGON"
#: Points of an exported ellipse.
ELLIPSE_POINTS = 36


def _at(c: Column, i: int) -> Column:
    return F.get(c, F.lit(i))


def _nth(c: Column, odd: int) -> Column:
    return F.filter(c, lambda x, i: i % 2 == odd)


def is_valid(shape: Column, coords: Column) -> Column:
    """Four numbers for rectangles and ellipses, three points or more for polygons; null for anything null."""
    n = F.size(coords)
    return F.when(coords.isNull(), F.lit(None)).when(shape.isin(RECTANGLE, ELLIPSE), n == 4).when(shape == POLYGON, (n >= 6) & (n % 2 == 0)).otherwise(F.lit(False))


def checked(shape: Column, coords: Column) -> Column:
    """The coordinates, or an error that names the shape."""
    text = F.concat(F.initcap(F.lower(shape)), F.when(shape == POLYGON, F.lit(" needs at least 3 points")).otherwise(F.lit(" needs 4 coordinates")))
    return F.when(is_valid(shape, coords), coords).otherwise(F.raise_error(F.coalesce(text, F.lit("Annotation without shape"))).cast("array<double>"))


def center(shape: Column, coords: Column) -> Column:
    """struct<x, y>: midpoint, the ellipse's centre, or the mean of the polygon's vertices; null if invalid."""
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.when(
        is_valid(shape, coords),
        F.when(shape == RECTANGLE, pair((_at(coords, 0) + _at(coords, 2)) / 2, (_at(coords, 1) + _at(coords, 3)) / 2))
        .when(shape == ELLIPSE, pair(_at(coords, 0), _at(coords, 1)))
        .otherwise(pair(mean(_nth(coords, 0)), mean(_nth(coords, 1)))),
    )


def bounding_box(shape: Column, coords: Column) -> Column:
    """[x_min, y_min, x_max, y_max]; the ellipse's is cut to whole numbers; null if invalid."""
    x, y, a, b = (_at(coords, i) for i in range(4))
    cut = lambda v: v.cast("bigint").cast("double")
    xs, ys = _nth(coords, 0), _nth(coords, 1)
    return F.when(
        is_valid(shape, coords),
        F.when(shape == RECTANGLE, coords)
        .when(shape == ELLIPSE, F.array(cut(x - a), cut(y - b), cut(x + a), cut(y + b)))
        .otherwise(F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))),
    )


def padded_box(shape: Column, coords: Column, padding: float = 0, h: Column | None = None, w: Column | None = None) -> Column:
    """Bounding box with padding, clamped to an image of h x w if given."""
    b = bounding_box(shape, coords)
    lo = [_at(b, 0) - padding, _at(b, 1) - padding]
    hi = [_at(b, 2) + padding, _at(b, 3) + padding]
    if h is not None and w is not None:
        lo = [F.greatest(v, F.lit(0.0)) for v in lo]
        hi = [F.least(hi[0], w.cast("double")), F.least(hi[1], h.cast("double"))]
    return F.when(b.isNotNull(), F.array(*lo, *hi))


def ellipse_of_box(box: Column) -> Column:
    """[cx, cy, rx, ry] within a box."""
    x0, y0, x1, y1 = (_at(box, i) for i in range(4))
    return F.when(box.isNotNull(), F.array((x0 + x1) / 2, (y0 + y1) / 2, (x1 - x0) / 2, (y1 - y0) / 2))


def box_from_center(cx: Column, cy: Column, half: Column, h: Column, w: Column) -> dict[str, Column]:
    """Box of ``half`` around (row cx, column cy), clamped to the image."""
    zero = F.lit(0)
    return {
        "x_min": F.greatest(cy - half, zero),
        "y_min": F.greatest(cx - half, zero),
        "x_max": F.least(cy + half + 1, w),
        "y_max": F.least(cx + half + 1, h),
    }


def point_in_polygon(r: Column, c: Column, points: list[tuple[float, float]]) -> Column:
    """Even-odd rule for (row, column) vertices."""
    hits = F.lit(0)
    for (a, b), (d, e) in zip(points, [*points[1:], points[0]]):
        if a == d:
            continue
        crosses = ((F.lit(a) > r) != (F.lit(d) > r)) & (c < F.lit(e - b) * (r - a) / (d - a) + b)
        hits = hits + F.when(crosses, 1).otherwise(0)
    return hits % 2 == 1


def inside_vertices(r: Column, c: Column, xs: Column, ys: Column) -> Column:
    """Even-odd rule for a polygon held in columns (arrays of x and y)."""
    n = F.size(xs)
    def crosses(i: Column) -> Column:
        j = F.pmod(i + 1, n)
        xa, ya, xb, yb = F.get(xs, i), F.get(ys, i), F.get(xs, j), F.get(ys, j)
        return ((ya > r) != (yb > r)) & (c < (xb - xa) * (r - ya) / (yb - ya) + xa)

    return F.when(n >= 3, F.size(F.filter(F.sequence(F.lit(0), n - 1), crosses)) % 2 == 1).otherwise(F.lit(False))


def in_disk(r: Column, c: Column, cy: Column, cx: Column, radius: float) -> Column:
    return (r - cy) * (r - cy) + (c - cx) * (c - cx) < float(radius * radius)


def segmentation(shape: Column, coords: Column) -> Column:
    """COCO outline [x, y, ...]: the polygon, four corners clockwise, or points on the ellipse."""
    x, y, a, b = (_at(coords, i) for i in range(4))
    angle = lambda i: i * (2 * 3.141592653589793 / ELLIPSE_POINTS)
    ring = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(ELLIPSE_POINTS - 1)), lambda i: F.array(x + a * F.cos(angle(i)), y + b * F.sin(angle(i)))))
    return F.when(is_valid(shape, coords), F.when(shape == POLYGON, coords).when(shape == RECTANGLE, F.array(x, y, a, y, a, b, x, b)).otherwise(ring))

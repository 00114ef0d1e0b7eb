"""Boxes, polygons and planes as column expressions; all stay inside generated code.

A box is four columns named x1, y1, x2, y2, with a prefix where two boxes meet.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def truncated(x: Column) -> Column:
    """Toward zero, as a long."""
    return x.cast("long")


def foot(b: Sequence[Column]) -> tuple[Column, Column]:
    """Middle of the lower edge, in whole pixels; the sum is halved toward zero."""
    return truncated((b[0] + b[2]) / 2), b[3]


def extent(b: Sequence[Column]) -> tuple[Column, Column]:
    """Width and height, 1 at least."""
    return F.greatest(F.lit(1), b[2] - b[0]), F.greatest(F.lit(1), b[3] - b[1])


def center(b: Sequence[Column]) -> tuple[Column, Column]:
    return (b[0] + b[2]) * 0.5, (b[1] + b[3]) * 0.5


def clamped(b: Sequence[Column], width: int, height: int) -> tuple[Column, ...]:
    """The box inside a frame, at least one pixel wide and high while the frame allows it."""
    inside = [F.greatest(F.lit(0), F.least(truncated(v), F.lit(side - 1))) for v, side in zip(b, (width, height) * 2, strict=True)]
    ends = [F.when(high <= low, F.least(F.lit(side - 1), low + 1)).otherwise(high) for low, high, side in zip(inside[:2], inside[2:], (width, height), strict=True)]
    return (*inside[:2], *ends)


def crop(b: Sequence[Column], width: int, height: int) -> tuple[Column, ...]:
    """The part of a clamped box within its margins. Its first condition, more than one pixel each way, is croppable()."""
    x1, y1, x2, y2 = clamped(b, width, height)
    side = truncated((x2 - x1) * F.lit(C.MARGIN_SIDE))
    top, bottom = (truncated((y2 - y1) * F.lit(m)) for m in (C.MARGIN_TOP, C.MARGIN_BOTTOM))
    return clamped((x1 + side, y1 + top, x2 - side, y2 - bottom), width, height)


def croppable(b: Sequence[Column], width: int, height: int) -> Column:
    x1, y1, x2, y2 = clamped(b, width, height)
    return (x2 - x1 > 1) & (y2 - y1 > 1)


def iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Intersection over union; sides of the areas count 1 at least, an empty intersection 0."""
    across = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    down = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    areas = [w * h for w, h in (extent(a), extent(b))]
    shared = across * down
    return shared / (areas[0] + areas[1] - shared)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Euclidean; null if any coordinate is."""
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def in_polygon(x: Column, y: Column, polygon: Sequence[Sequence[float]] | None) -> Column:
    """Even-odd rule on whole coordinates, edges included; without a polygon everything is inside."""
    if polygon is None:
        return F.lit(True)
    points = [(int(px), int(py)) for px, py in polygon]
    on_edge, crossings = F.lit(False), F.lit(0)
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
        turn = (x - ax) * (by - ay) - (y - ay) * (bx - ax)
        on_edge |= (turn == 0) & x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by), max(ay, by))
        if ay != by:
            left = turn < 0 if by > ay else turn > 0
            crossings += (((F.lit(ay) > y) != (F.lit(by) > y)) & left).cast("int")
    return on_edge | (crossings % 2 == 1)


def fixes_plane(points: Column) -> Column:
    """Whether four points (array of pairs, null if not valid) are no three on a line."""
    p = lambda i, k: F.get(F.get(points, F.lit(i)), F.lit(k))
    turn = lambda a, b, c: (p(b, 0) - p(a, 0)) * (p(c, 1) - p(a, 1)) - (p(b, 1) - p(a, 1)) * (p(c, 0) - p(a, 0))
    return F.coalesce((turn(0, 1, 2) != 0) & (turn(0, 1, 3) != 0) & (turn(0, 2, 3) != 0) & (turn(1, 2, 3) != 0), F.lit(False))


def fit_homography(source: Sequence[Sequence[float]] | None, target: Sequence[Sequence[float]] | None) -> list[float] | None:
    """Nine coefficients of the plane map that takes four points to four points; None if they do not fix one."""
    if source is None or target is None or np.shape(source) != (4, 2) or np.shape(target) != (4, 2):
        return None
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    system = np.array(rows, float)
    if np.linalg.matrix_rank(system) < 8 or np.linalg.cond(system) > 1e12:
        return None
    return [*np.linalg.solve(system, np.array(right, float)).tolist(), 1.0]


def project(x: Column, y: Column, h: Sequence[float] | Column | None) -> tuple[Column, Column]:
    """Floorplan coordinates of an image point, whole, toward zero; null without a map or on its horizon."""
    if h is None:
        return F.lit(None).cast("long"), F.lit(None).cast("long")
    k = [F.lit(v) for v in h] if not isinstance(h, Column) else [h[i] for i in range(9)]
    w = k[6] * x + k[7] * y + k[8]
    depth = F.when(F.abs(w) > 1e-12, w)
    return tuple(truncated((k[i] * x + k[i + 1] * y + k[i + 2]) / depth) for i in (0, 3))


def on_map(x: Column, y: Column, width: int = C.MAP_WIDTH, height: int = C.MAP_HEIGHT) -> tuple[Column, Column]:
    """Moved to the nearest place of the floorplan."""
    return F.greatest(F.lit(0), F.least(x, F.lit(width - 1))), F.greatest(F.lit(0), F.least(y, F.lit(height - 1)))

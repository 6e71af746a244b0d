"""Box and point geometry as column expressions; a box is (x0, y0, x1, y1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box_around(x: Column, y: Column, half: float = 5.0) -> Box:
    return x - half, y - half, x + half, y + half


def box_iou(a: Box, b: Box, least_union: float = 1e-6) -> Column:
    """Overlap over union, 0 where the union is not over ``least_union``."""
    zero = F.lit(0.0)
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), zero)
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), zero)
    inter = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return F.when(union > least_union, inter / union).otherwise(zero)


def box_gap(a: Box, b: Box) -> Column:
    zero = F.lit(0.0)
    dx = F.greatest(F.greatest(a[0], b[0]) - F.least(a[2], b[2]), zero)
    dy = F.greatest(F.greatest(a[1], b[1]) - F.least(a[3], b[3]), zero)
    return F.sqrt(dx * dx + dy * dy)


def boxes_adjacent(a: Box, b: Box, pad: float) -> Column:
    """Padded boxes overlap."""
    return (a[0] - pad < b[2]) & (b[0] - pad < a[2]) & (a[1] - pad < b[3]) & (b[1] - pad < a[3])


def at_border(x: Column, y: Column, width: float, height: float, share: float = 0.03) -> Column:
    return (x < share * width) | (x > (1 - share) * width) | (y < share * height) | (y > (1 - share) * height)


def zone(x: Column, y: Column, width: float, height: float, n: int) -> Column:
    """Cell of an n x n grid whose edges are truncated to whole pixels."""

    def cell(v: Column, size: float) -> Column:
        out = F.lit(0)
        for k in range(1, n):
            out = out + (v >= int(k * size / n)).cast("int")
        return out

    return (cell(y, height) * n + cell(x, width)).cast("long")

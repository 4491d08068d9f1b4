"""Boxes (x0, y0, x1, y1) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union; 0 where boxes only touch."""
    width = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    height = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    both = width * height
    return F.when((width <= 0) | (height <= 0), 0.0).otherwise(both / (area(a) + area(b) - both))


def box_union(x0: str, y0: str, x1: str, y1: str) -> list[Column]:
    """Aggregates that bound a group of boxes."""
    return [F.min(x0).alias(x0), F.min(y0).alias(y0), F.max(x1).alias(x1), F.max(y1).alias(y1)]


def flipped(y0: Column, y1: Column, height: Column) -> tuple[Column, Column]:
    """A box's edges from the other origin."""
    return height - y1, height - y0

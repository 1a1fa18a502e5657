"""Functions of points in the plane, given as two double columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KM_PER_DEGREE = 111.0


def distance(x: Column, y: Column, centre: tuple[float, float]) -> Column:
    return F.hypot(x - F.lit(float(centre[0])), y - F.lit(float(centre[1])))


def within(x: Column, y: Column, centre: tuple[float, float], radius: float) -> Column:
    """Inclusive Euclidean distance; the bounding box comes first, as Parquet's statistics can skip by it."""
    cx, cy, r = float(centre[0]), float(centre[1]), float(radius)
    return x.between(cx - r, cx + r) & y.between(cy - r, cy + r) & (distance(x, y, centre) <= r)


def degrees(km: float) -> float:
    return round(km / KM_PER_DEGREE, 6)

"""Radius and nearest-neighbour queries over points, exact, with an optional grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.spatial import distance, within
from .relational import top


def radius(df: DataFrame, centre: tuple[float, float], r: float, x: str = "x", y: str = "y") -> DataFrame:
    """Rows within r of centre, rim included."""
    return df.filter(within(F.col(x), F.col(y), centre, r))


def nearest(df: DataFrame, centre: tuple[float, float], k: int, key: str, x: str = "x", y: str = "y", order_by: list | None = None) -> DataFrame:
    """The k nearest rows with their `distance`, ties by key. One task keeps k rows per partition, so nothing is sorted as a whole."""
    if k < 1:
        raise ValueError("k is at least 1")
    measured = df.withColumn("distance", distance(F.col(x), F.col(y), centre))
    return top(measured.filter(F.col("distance").isNotNull()), [F.col("distance"), F.col(key)], k, 0, order_by)


class GridIndex:
    """Points stored by grid cell, so that a query reads the cells that it touches and no others.

    Coordinates must be numbers and the cell's side positive; a folder that holds a grid already is an error.
    """

    def __init__(self, df: DataFrame, path: str, cell: float, x: str = "x", y: str = "y"):
        if not cell > 0 or not all(isinstance(df.schema[c].dataType, NumericType) for c in (x, y)):
            raise ValueError("a grid needs numbers as coordinates and a positive cell")
        self.path, self.cell, self.x, self.y, self.spark, self.version = path.rstrip("/"), float(cell), x, y, df.sparkSession, 0
        self.write(self.placed(df), "error")

    def placed(self, df: DataFrame) -> DataFrame:
        at = lambda c: F.floor(F.col(c) / self.cell).cast("long")
        return df.withColumns({"cell_x": at(self.x), "cell_y": at(self.y)})

    def write(self, placed: DataFrame, mode: str) -> None:
        # Rows of a stripe of cells meet in as many files as they need; min/max statistics skip by cell_y.
        spread = placed.repartitionByRange("cell_x", "cell_y", F.xxhash64(self.x, self.y)).sortWithinPartitions("cell_x", "cell_y")
        spread.write.mode(mode).parquet(f"{self.path}/v-{self.version}")

    def add(self, df: DataFrame) -> None:
        """More rows go to files of their own; the others stay as they are."""
        self.write(self.placed(df).select(self.table().columns), "append")

    def remove(self, condition: Column) -> None:
        """Take out the rows that meet the condition, in a new version; rows for which it is null stay."""
        kept = self.table().filter(~F.coalesce(condition, F.lit(False)))
        self.version += 1
        self.write(kept, "error")

    def table(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v-{self.version}")

    def radius(self, centre: tuple[float, float], r: float) -> DataFrame:
        low, high = [math.floor((c - r) / self.cell) for c in centre], [math.floor((c + r) / self.cell) for c in centre]
        near = self.table().filter(F.col("cell_x").between(low[0], high[0]) & F.col("cell_y").between(low[1], high[1]))
        return radius(near, centre, r, self.x, self.y).drop("cell_x", "cell_y")

    def nearest(self, centre: tuple[float, float], k: int, key: str) -> DataFrame:
        """Widen a circle until it holds k rows, then take the k nearest of it; a circle over everything ends it."""
        bounds = self.table().agg(F.min(self.x), F.max(self.x), F.min(self.y), F.max(self.y)).first()
        reach = max((abs(b - c) for b, c in zip(bounds, (centre[0], centre[0], centre[1], centre[1])) if b is not None), default=0.0)
        r = self.cell
        while r < 2 * reach and self.radius(centre, r).limit(k).count() < k:
            r *= 2
        return nearest(self.radius(centre, max(r, 2 * reach) if r >= 2 * reach else r), centre, k, key, self.x, self.y)

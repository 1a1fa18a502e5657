"""Parquet tables with a key: create, insert, delete, serial keys, reorganise, export."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.relational import condition
from ..plans.results import export_csv
from . import csv_load
from .scratch import publish, remove


def with_serial(df: DataFrame, *order: str | Column, start: int = 1, name: str = "id") -> DataFrame:
    """Number the rows from `start` in the given order, spread over ranges of it instead of in one task.

    Rows are sorted into ranges and written with their range's number, as Spark draws the ranges anew whenever they
    are computed; the ranges' counts, a row each, tell where each begins.
    """
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = publish(ranged, "serial")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("_before", before).select("_part", "_before")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(starts, "_part").withColumn(name, (F.col("_before") + place + (start - 1)).cast("int")).drop("_part", "_before")


def first_by_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Of rows with one key, the first in order. The least row per key is found before the shuffle, so hot keys are cheap."""
    rest = [c for c in df.columns if c not in order]
    packed = F.struct(*order, *rest)
    return df.groupBy(F.col(key).alias("_key")).agg(F.min(packed).alias("_row")).select("_row.*").select(*df.columns)


class Table:
    """A Parquet table whose versions are folders; a change writes a new version, and readers of the old one go on."""

    def __init__(self, spark: SparkSession, path: str, key: str | None = None):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.version: str | None = None
        self.serial = False
        self.sizes: dict[str, int] = {}
        self.derived: list[str] = []

    def create(self, rows: DataFrame) -> Table:
        """A table of the rows; a key that is null or stands twice is a ValueError."""
        if self.key and not rows.groupBy(self.key).agg(F.count(F.lit(1)).alias("n")).filter(F.col(self.key).isNull() | (F.col("n") > 1)).isEmpty():
            raise ValueError("the key is null or stands twice")
        return self.replace(rows)

    def declare(self, specs: list[csv_load.ColumnSpec]) -> Table:
        """An empty table of declared columns. Without a primary key it gets a serial one: id, or row_id where id is taken."""
        keys = [c.name for c in specs if c.primary_key]
        if len(keys) > 1 or len({c.name for c in specs}) < len(specs):
            raise ValueError("one key and different names are needed")
        self.serial = not keys
        self.key = keys[0] if keys else next(n for n in ("id", "row_id") if n not in {c.name for c in specs})
        self.sizes = {c.name: c.size for c in specs if c.kind == "VARCHAR"}
        fields = [f"{self.key} int"] * self.serial + [f"{c.name} {c.spark_type}" for c in specs]
        return self.replace(self.spark.createDataFrame([], ", ".join(fields)))

    def load_csv(self, path: str) -> dict:
        """Append a CSV file's rows; a table that is not there yet is created with the types, key and point that the file shows.

        Rows with bad cells, and keys that stand earlier in the file or in the table, are rejected: the summary has
        the counts and the first reasons. Point columns that the file lacks are made of its coordinates.
        """
        found = csv_load.read_csv(self.spark, path)
        if self.version is None:
            specs = csv_load.infer_schema(found)
            pair = csv_load.point_pair(found, specs)
            self.declare([*specs, *([csv_load.ColumnSpec(pair["column"], "POINT")] if pair else [])])
            specs = [*specs, *([csv_load.ColumnSpec(pair["column"], "POINT")] if pair else [])]
        else:
            kinds = {"int": "INT", "double": "FLOAT", "boolean": "BOOL", "string": "TEXT"}
            specs = [csv_load.ColumnSpec(n, "VARCHAR" if n in self.sizes else kinds.get(t, "POINT"), self.sizes.get(n), n == self.key) for n, t in self.rows().dtypes if not (self.serial and n == self.key)]
            names = set(map(csv_load.identifier, found.header))
            lacking = [c.name for c in specs if c.kind == "POINT" and c.name not in names]
            sides = [next((n for n in kind if n in names), None) for kind in (csv_load.LATITUDE, csv_load.LONGITUDE)]
            pair = {"column": lacking[0], "lat": sides[0], "lng": sides[1]} if lacking and all(sides) else None
        result = csv_load.load(found, specs, None if self.serial else self.rows(), pair)
        accepted = result.accepted
        if self.serial:
            accepted = with_serial(accepted, "line", start=self.next_serial(), name=self.key)
        accepted = publish(accepted.select(self.rows().columns), "loaded")
        accepted.write.mode("append").parquet(self.version)
        return csv_load.LoadResult(accepted, result.rejected).summary()

    def drop(self) -> None:
        """Delete the table's versions and the folders of what was derived from it."""
        for path in (self.path, *self.derived):
            remove(self.spark, path)
        self.version, self.derived = None, []

    def replace(self, rows: DataFrame) -> Table:
        version = f"{self.path}/v-{uuid.uuid4().hex}"
        rows.write.parquet(version)
        self.version = version
        return self

    def rows(self) -> DataFrame:
        if self.version is None:
            raise ValueError("the table has not been created")
        return self.spark.read.parquet(self.version)

    def insert(self, *values: tuple) -> Table:
        """Append rows given as tuples; a serial key may be left out. Keys that are there already, or twice among them, and too long texts are ValueErrors."""
        schema = self.rows().schema
        if self.serial and all(len(row) == len(schema) - 1 for row in values):
            first = self.next_serial()
            values = tuple((first + i, *row) for i, row in enumerate(values))
        for row in values:
            if len(row) != len(schema):
                raise ValueError(f"{len(schema)} values were expected, not {len(row)}")
            for name, value in zip(schema.names, row):
                if name in self.sizes and value is not None and len(value.encode()) > self.sizes[name]:
                    raise ValueError(f"{name} holds {self.sizes[name]} bytes at most")
        fresh = self.spark.createDataFrame(list(values), schema)
        if self.key:
            keys = [row[schema.names.index(self.key)] for row in values]
            if None in keys or len(set(keys)) < len(keys) or not self.rows().filter(F.col(self.key).isin(keys)).isEmpty():
                raise ValueError("the key is null or there already")
        fresh.write.mode("append").parquet(self.version)
        return self

    def next_serial(self) -> int:
        return (self.rows().agg(F.max(self.key)).first()[0] or 0) + 1

    def delete(self, column: str, value) -> Table:
        """Delete the rows whose column equals the value."""
        rows = self.rows()
        return self.replace(rows.filter(~F.coalesce(condition(rows, column, "=", value), F.lit(False))))

    def reorganise(self) -> dict:
        """Rewrite the rows in key order, in ranges that no two files share; the counts before and after."""
        rows = self.rows()
        before = {"files": len(rows.inputFiles()), "rows": rows.count()}
        self.replace(rows.repartitionByRange(self.key).sortWithinPartitions(self.key))
        return {"before": before, "after": {"files": len(self.rows().inputFiles()), "rows": self.rows().count()}}

    def info(self) -> dict:
        rows = self.rows()
        return {"columns": rows.dtypes, "key": self.key, "rows": rows.count(), "files": len(rows.inputFiles())}

    def export_csv(self, path: str) -> None:
        export_csv(self.rows(), path)

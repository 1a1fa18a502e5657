"""Bounded results for callers that show them: a row cap, the truncation mark, points for a map."""

from __future__ import annotations

import time

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_CAP = 100


def show(build, limited: bool = False, cap: int = ROW_CAP) -> dict:
    """Run build() -> DataFrame and collect at most `cap` rows of it (all, if it is limited already).

    Returns ok, columns, rows, rowcount, truncated, spatial (points of the first struct<x,y> column) and elapsed_ms;
    on failure ok is False, with error and stage (semantic before a job runs, execution after).
    """
    began, stage = time.time(), "semantic"
    try:
        df: DataFrame = build()
        stage = "execution"
        rows = df.collect() if limited else df.limit(cap + 1).collect()
    except (ValueError, PySparkException) as error:
        return {"ok": False, "error": str(error).split("\n")[0], "stage": stage}
    truncated = not limited and len(rows) > cap
    rows = rows if limited else rows[:cap]
    point = next((f.name for f in df.schema.fields if isinstance(f.dataType, T.StructType) and f.dataType.names == ["x", "y"]), None)
    spatial = {"column": point, "points": [{"x": r[point].x, "y": r[point].y, "row": i} for i, r in enumerate(rows) if r[point] is not None]} if point else None
    return {"ok": True, "columns": df.columns, "rows": [list(r) for r in rows], "rowcount": len(rows), "truncated": truncated, "spatial": spatial, "elapsed_ms": (time.time() - began) * 1000}


def export_csv(df: DataFrame, path: str) -> None:
    """Write a whole result as CSV files with a header: points as (x, y), which the loader reads, other nested values as JSON."""

    def cell(field: T.StructField):
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StructType) and field.dataType.names == ["x", "y"]:
            value = F.when(value.isNotNull(), F.format_string("(%s, %s)", value["x"].cast("string"), value["y"].cast("string")))
        elif isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
            value = F.to_json(value)
        elif isinstance(field.dataType, T.BinaryType):
            value = F.base64(value)
        return value.alias(field.name)

    df.select([cell(f) for f in df.schema.fields]).write.mode("overwrite").csv(path, header=True)

"""Typed filters, global aggregates and pages over DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.spatial import within

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMBER = (*INTEGRAL, T.FloatType, T.DoubleType, T.DecimalType)


def check_column(df: DataFrame, name: str) -> T.DataType:
    """The column's type; an unknown column is a ValueError before any job runs."""
    found = [f for f in df.schema.fields if f.name == name]
    if not found:
        raise ValueError(f"unknown column {name!r}")
    return found[0].dataType


def literal(value, kind: T.DataType, size: int | None = None):
    """The value as the column's type: integers truncate fractions and take digits, Booleans take only Booleans, text
    must fit `size` UTF-8 bytes. Anything else is a ValueError."""
    if isinstance(kind, T.BooleanType):
        if not isinstance(value, bool):
            raise ValueError(f"{value!r} is not Boolean")
        return value
    if isinstance(value, bool):
        raise ValueError(f"{value!r} is not a {kind.simpleString()}")
    try:
        if isinstance(kind, INTEGRAL):
            return int(value)
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return float(value)
    except (TypeError, ValueError) as error:
        raise ValueError(f"{value!r} is not a {kind.simpleString()}") from error
    if isinstance(kind, T.StringType):
        if size is not None and len(str(value).encode()) > size:
            raise ValueError(f"{value!r} is longer than {size} bytes")
        return str(value)
    return value


def condition(df: DataFrame, name: str, op: str, value) -> Column:
    """One comparison: = < <= > >=, between (low, high), in_circle ((x, y), radius) on a struct<x,y> column."""
    kind, column = check_column(df, name), F.col(name)
    if isinstance(kind, T.StructType):
        x, y = column["x"], column["y"]
        if op == "=":
            return (x == F.lit(float(value[0]))) & (y == F.lit(float(value[1])))
        if op == "in_circle":
            return within(x, y, *value)
        if op == "between":
            low, high = (F.struct(F.lit(float(v[0])).alias("x"), F.lit(float(v[1])).alias("y")) for v in value)
            return column.between(low, high)
        return F.lit(False)  # points have no order of their own
    size = next((f.metadata.get("size") for f in df.schema.fields if f.name == name), None)
    if op == "between":
        return column.between(literal(value[0], kind, size), literal(value[1], kind, size))
    try:
        compare = {"=": column.__eq__, "<": column.__lt__, "<=": column.__le__, ">": column.__gt__, ">=": column.__ge__}[op]
    except KeyError:
        raise ValueError(f"unknown comparison {op!r}") from None
    return compare(literal(value, kind, size))


def where(df: DataFrame, *conditions: tuple) -> DataFrame:
    """Rows that meet every (column, op, value); Catalyst pushes what it can into the scan."""
    return df.filter(reduce(Column.__and__, [condition(df, *c) for c in conditions])) if conditions else df


def project(df: DataFrame, *items: str | tuple[str, str]) -> DataFrame:
    """Columns by name or (name, alias); '*' alone gives all."""
    if "*" in items:
        if len(items) > 1:
            raise ValueError("* stands alone")
        return df
    pairs = [(i, i) if isinstance(i, str) else i for i in items]
    for name, _ in pairs:
        check_column(df, name)
    return df.select(*[F.col(n).alias(a) for n, a in pairs])


def aggregate(df: DataFrame, *items: tuple) -> DataFrame:
    """Global aggregates, one row: (function, column[, alias]); count takes '*' only.

    min and max take numbers and text, sum and avg numbers; sums of integers stay integers. Default names are
    count and <function>_<column>. Without rows the count is 0 and the others are null.
    """
    columns = []
    for function, name, *alias in items:
        if function == "count":
            if name != "*":
                raise ValueError("count takes *")
            columns.append(F.count(F.lit(1)).alias(*alias or ["count"]))
            continue
        kind = check_column(df, name)
        allowed = {"min": (*NUMBER, T.StringType), "max": (*NUMBER, T.StringType), "sum": NUMBER, "avg": NUMBER}.get(function)
        if allowed is None or not isinstance(kind, allowed):
            raise ValueError(f"no {function} of {name!r} ({kind.simpleString()})")
        columns.append(getattr(F, function)(name).alias(*alias or [f"{function}_{name}"]))
    return df.agg(*columns)


def page(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Skip `offset` rows, then take `limit`."""
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset are not negative")
    return df.offset(offset).limit(limit) if offset else df.limit(limit)


def top(df: DataFrame, rank: list[Column], limit: int, offset: int = 0, order_by: list[Column] | None = None) -> DataFrame:
    """The limit + offset best rows by `rank`, then in `order_by`'s order, then the page: another order never changes which rows are chosen."""
    best = df.orderBy(*rank).limit(limit + offset)
    ordered = best.orderBy(*order_by) if order_by else best
    return ordered.offset(offset) if offset else ordered

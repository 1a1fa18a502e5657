"""CSV ingestion: sniffing, schema inference, column statistics, typed loading with rejects."""

from __future__ import annotations

import csv
import math
import os
import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import publish

# What counts as a number, a Boolean, a point, and names of coordinates.
INT = r"^-?\d+$"
FLOAT = r"^-?\d+(?:\.\d+)?$"
BOOL = r"(?i)^(?:true|false)$"
BOOL_CELL = r"(?i)^(?:true|false|1|0)$"
POINT = r"^\(\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*\)$"
CODE = r"^-?0\d"
LATITUDE = ("latitude", "lat", "latitud")
LONGITUDE = ("longitude", "lng", "lon", "long", "longitud")
SEPARATORS = ",;\t|"
# Words that no column may be named.
RESERVED = frozenset(
    "create table primary key int float varchar text bool point vector index on using btree hash rtree inverted ivf insert into values select"
    " from where limit offset heap sequential between and in knn delete true false file load drop match with as order by asc desc set count min max"
    " sum avg".split()
)
SAMPLE_ROWS = 200
MAX_ERRORS = 50


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    kind: str
    size: int | None = None
    primary_key: bool = False
    auto: bool = False

    def __str__(self) -> str:
        return f"VARCHAR({self.size})" if self.kind == "VARCHAR" else self.kind

    @property
    def spark_type(self) -> str:
        return {"INT": "int", "FLOAT": "double", "BOOL": "boolean", "POINT": "struct<x:double,y:double>"}.get(self.kind, "string")


def safe_path(root: str, name: str) -> str:
    """The file under root; absolute names and names that leave it are ValueErrors."""
    if os.path.isabs(name) or ".." in name.replace("\\", "/").split("/"):
        raise ValueError(f"{name!r} is outside the data folder")
    return os.path.join(root, name)


def identifier(name: str) -> str:
    found = re.sub(r"[^a-zA-Z0-9_]", "_", name.strip().lower())
    return f"t_{found}" if not found or found[0].isdigit() or found in RESERVED else found


def fresh_name(name: str, used: set[str]) -> str:
    number, out = 2, name
    while out in used:
        out, number = f"{name}_{number}", number + 1
    used.add(out)
    return out


@dataclass
class CsvTable:
    """Rows of a CSV file: `line` (the physical line) and one string column c0, c1, ... per header field; `width` fields stand in the line."""

    header: list[str]
    rows: DataFrame


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, place, value): physical lines with their numbers from 1, and with those in their own file.

    The files of a folder follow one another by name. Rows are ordered by file block and place in it; only the
    blocks' row counts, a row per block, are accumulated.
    """
    read = spark.read.text(path).select(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    blocks = read.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    until = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.withColumns({"before": until(Window.orderBy("file", "block")), "above": until(Window.partitionBy("file").orderBy("block"))})
    here = F.col("id") - F.col("first") + 1
    return read.join(starts.drop("n"), ["file", "block"]).select((F.col("before") + here).alias("line"), (F.col("above") + here).alias("place"), "block", "file", "value")


def records(lines: DataFrame) -> DataFrame:
    """(line, place, value): records, each with its first line; one goes on over line breaks within quotes.

    Files without such line breaks, which one pass over the quotes tells, keep their lines. Otherwise the quotes
    before each block, a row per block, are accumulated, so that blocks are joined up without one task seeing all.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    if lines.filter(quotes % 2 == 1).isEmpty():
        return lines.select("line", "place", "value").filter(F.trim("value") != "")
    counted = publish(lines.withColumn("quotes", quotes), "csv-lines")
    total = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    held = counted.groupBy("file", "block").agg(F.sum("quotes").alias("n")).withColumn("held", F.coalesce(F.sum("n").over(total), F.lit(0))).drop("n")
    run = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    opened = (F.col("held") + F.coalesce(F.sum("quotes").over(run), F.lit(0))) % 2 == 0
    flagged = publish(counted.join(held, ["file", "block"]).withColumn("begins", opened.cast("int")), "csv-lines")
    begun = flagged.groupBy("file", "block").agg(F.sum("begins").alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(total), F.lit(0))).drop("n")
    upto = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    numbered = flagged.join(begun, ["file", "block"]).withColumn("record", F.col("earlier") + F.sum("begins").over(upto))
    parts = F.array_sort(F.collect_list(F.struct("line", "place", "value")))
    whole = numbered.groupBy("file", "record").agg(parts.alias("parts"))
    value = F.array_join(F.transform("parts", lambda x: x["value"]), "\n")
    return whole.select(F.get("parts", 0)["line"].alias("line"), F.get("parts", 0)["place"].alias("place"), value.alias("value")).filter(F.trim("value") != "")


def read_csv(spark: SparkSession, path: str) -> CsvTable:
    """Read a CSV file, or a folder of files with equal headers; the separator is sniffed from the first lines, blank ones are skipped.

    UTF-8, with or without a byte order mark, or else Latin-1. Fields in quotes may hold line breaks. A missing,
    empty or repeated header name is a ValueError.
    """
    lines = numbered_lines(spark, path)
    if not lines.filter(~F.is_valid_utf8("value")).isEmpty():
        lines = lines.withColumn("value", F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    lines = records(lines.withColumn("value", F.regexp_replace("value", "^\ufeff|\r$", "")))
    start = lines.orderBy("line").limit(20).collect()
    if not start:
        raise ValueError("the file is empty")
    try:
        sep = csv.Sniffer().sniff("\n".join(r["value"] for r in start), delimiters=SEPARATORS).delimiter
    except csv.Error:
        sep = ","
    header = next(csv.reader([start[0]["value"]], delimiter=sep))
    if any(not h.strip() for h in header):
        raise ValueError("a header field is empty")
    if len({h.strip().lower() for h in header}) < len(header):
        raise ValueError("a header field is repeated")
    names = [f"c{i}" for i in range(len(header))]
    # One column more than the header shows lines that are too long.
    schema = ", ".join(f"{n} string" for n in [*names, "more"])
    parsed = F.from_csv("value", schema, {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "emptyValue": "", "nullValue": "\u0001", "multiLine": "true"})
    again = (F.col("place") == 1) & (F.col("value") == start[0]["value"])
    rows = lines.filter((F.col("line") > start[0]["line"]) & ~again).select("line", parsed.alias("r"))
    missing = sum((F.col(f"r.{n}").isNull().cast("int") for n in names), F.lit(0))
    width = F.when(F.col("r.more").isNotNull(), len(names) + 1).otherwise(len(names) - missing)
    return CsvTable(header, rows.select("line", width.alias("width"), *[F.coalesce(f"r.{n}", F.lit("")).alias(n) for n in names]))


def number_like(value: Column, pattern: str) -> Column:
    return value.rlike(pattern) & ~value.rlike(CODE)


def text_kind(longest: int) -> tuple[str, int | None]:
    size = max(20, math.ceil(math.ceil(longest * 1.2) / 10) * 10)
    return ("TEXT", None) if size > 255 else ("VARCHAR", size)


def infer_schema(table: CsvTable, sample_rows: int = SAMPLE_ROWS) -> list[ColumnSpec]:
    """Column types: INT, FLOAT, BOOL or POINT if all of the first rows' values fit, numbers if all of the file's do, else text sized by the longest value.

    Codes with leading zeros are no numbers. The first column is the key if it is INT and unique in the sample.
    Two aggregations, over the sample and over the file, look at all columns at once.
    """
    whole = table.rows.filter(F.col("width") == len(table.header))
    sample = whole.orderBy("line").limit(sample_rows)
    names = [f"c{i}" for i in range(len(table.header))]

    def tests(n: str) -> list[Column]:
        v = F.trim(n)
        full = v != ""
        fits = {"i": number_like(v, INT), "f": number_like(v, FLOAT), "b": v.rlike(BOOL), "p": v.rlike(POINT)}
        out = [F.coalesce(F.bool_and(F.when(full, test)), F.lit(True)).alias(f"{n}_{k}") for k, test in fits.items()]
        return [*out, F.count_if(full).alias(f"{n}_n"), F.coalesce(F.max(F.length(v)), F.lit(0)).alias(f"{n}_l")]

    checks = [c for n in names for c in tests(n)]
    first = sample.agg(*checks, F.count_distinct(F.when(F.trim("c0") != "", F.trim("c0"))).alias("keys")).first()
    everything = whole.agg(*checks).first()
    used: set[str] = set()
    specs = []
    for n, name in zip(names, table.header):
        kinds = [k for k, label in (("INT", "i"), ("FLOAT", "f"), ("BOOL", "b"), ("POINT", "p")) if first[f"{n}_{label}"]] if first[f"{n}_n"] else ["TEXT"]
        kind, size = (kinds[0], None) if kinds else text_kind(everything[f"{n}_l"])
        if kind in ("INT", "FLOAT") and not everything[f"{n}_{kind[0].lower()}"]:
            kind, size = text_kind(everything[f"{n}_l"])
        specs.append(ColumnSpec(fresh_name(identifier(name), used), kind, size))
    if specs and specs[0].kind == "INT" and first["c0_n"] and first["keys"] == first["c0_n"]:
        specs[0] = replace(specs[0], primary_key=True)
    return specs


def create_statement(table: str, specs: list[ColumnSpec]) -> str:
    fields = ", ".join(f"{c.name} {c}{' PRIMARY KEY' if c.primary_key else ''}" for c in specs)
    return f"CREATE TABLE {table} ({fields});"


def column_stats(table: CsvTable) -> DataFrame:
    """One row per column: column, nulls (empty cells), duplicates among the others, and up to 3 first values."""
    names = [f"c{i}" for i in range(len(table.header))]
    cells = table.rows.select("line", F.posexplode(F.array(*names)).alias("at", "value"))
    full = F.trim("value") != ""
    stats = cells.groupBy("at").agg(
        F.count_if(~full).alias("nulls"),
        (F.count_if(full) - F.count_distinct(F.when(full, F.col("value")))).alias("duplicates"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.when(full & (F.col("line") <= 1000), F.struct("line", "value")))), 1, 3), lambda s: s["value"]).alias("sample_values"),
    )
    return stats.select(F.get(F.array(*[F.lit(h) for h in table.header]), "at").alias("column"), "nulls", "duplicates", "sample_values", "at").orderBy("at").drop("at")


def suggest_key(specs: list[ColumnSpec], stats: list) -> str | None:
    """A column named id, uuid or id_... without empty or repeated cells, or the first such column."""
    clean = [c.name for c, s in zip(specs, stats) if not s["nulls"] and not s["duplicates"]]
    named = [n for n in clean if n in ("id", "uuid") or n.startswith("id_")]
    return next(iter(named or clean), None)


def point_pair(table: CsvTable, specs: list[ColumnSpec]) -> dict | None:
    """A latitude and a longitude column, by name and by the whole file's range, that make a point column."""
    found = {}
    for names, limit, role in ((LATITUDE, 90, "lat"), (LONGITUDE, 180, "lng")):
        found[role] = [(i, limit) for i, c in enumerate(specs) if c.name in names and c.kind in ("INT", "FLOAT")]
    whole = table.rows.filter(F.col("width") == len(table.header))
    for i, _ in found["lat"]:
        for j, _ in found["lng"]:
            value = lambda n: F.expr(f"try_cast(nullif(trim(c{n}), '') AS double)")
            low = whole.agg(F.min(value(i)), F.max(value(i)), F.min(value(j)), F.max(value(j))).first()
            if None not in low and low[0] >= -90 and low[1] <= 90 and low[2] >= -180 and low[3] <= 180:
                return {"column": fresh_name("location", {c.name for c in specs}), "lat": specs[i].name, "lng": specs[j].name}
    return None


def map_header(header: list[str], specs: list[ColumnSpec], optional: frozenset[str] = frozenset()) -> tuple[dict[str, int], list[str]]:
    """Column name -> header place, and the header's unused names; a missing required column is a ValueError."""
    places: dict[str, int] = {}
    for i, name in enumerate(map(identifier, header)):
        if name in places:
            raise ValueError(f"two header fields are read as {name!r}")
        places[name] = i
    missing = [c.name for c in specs if c.name not in places and c.name not in optional]
    if missing:
        raise ValueError(f"the file lacks the column {missing[0]!r}")
    wanted = {c.name for c in specs}
    return {n: i for n, i in places.items() if n in wanted}, [h for h, n in zip(header, map(identifier, header)) if n not in wanted]


def cast_cell(value: Column, spec: ColumnSpec) -> tuple[Column, Column]:
    """(typed value, reason): exactly one is null, except that a rejected cell has no value and an empty text is ''."""
    v = F.trim(value)
    wrong = F.concat(F.lit(f"{spec.name}: '"), value, F.lit(f"' is no {spec}"))
    if spec.kind == "TEXT":
        return v, F.lit(None).cast("string")
    if spec.kind == "VARCHAR":
        long = F.octet_length(v) > spec.size
        return F.when(~long, v), F.when(long, F.concat(F.lit(f"{spec.name}: '"), value, F.lit(f"' is longer than {spec}")))
    typed = {
        "INT": F.when(v.rlike(INT), v.try_cast("int")),
        "FLOAT": F.when(v.rlike(FLOAT), v.try_cast("double")),
        "BOOL": F.when(v.rlike(BOOL_CELL), F.lower(v).isin("true", "1")),
        "POINT": F.when(v.rlike(POINT), F.struct(*[F.regexp_extract(v, POINT, i).try_cast("double").alias(n) for i, n in ((1, "x"), (2, "y"))])),
    }[spec.kind]
    return typed, F.when(typed.isNull(), wrong)


@dataclass
class LoadResult:
    accepted: DataFrame
    rejected: DataFrame

    def summary(self) -> dict:
        return {
            "loaded": self.accepted.count(),
            "rejected": self.rejected.count(),
            "errors": [r.asDict() for r in self.rejected.orderBy("line").limit(MAX_ERRORS).collect()],
        }


def typed_rows(table: CsvTable, specs: list[ColumnSpec], pair: dict | None = None) -> DataFrame:
    """line, the typed columns, and `reason`: why a row is rejected, from its first bad cell."""
    optional = frozenset([pair["column"]] if pair else []) | {c.name for c in specs if c.auto}
    places, _ = map_header(table.header, specs, optional)
    by_identifier = {identifier(h): i for i, h in enumerate(table.header)}
    typed, reasons = [], [F.when(F.col("width") != len(table.header), F.concat(F.lit(f"{len(table.header)} fields were expected, not "), F.col("width").cast("string")))]
    for spec in specs:
        if pair and spec.name == pair["column"] and spec.name not in places:
            x, y = (F.trim(f"c{by_identifier[pair[k]]}").try_cast("double") for k in ("lat", "lng"))
            typed.append(F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y"))).alias(spec.name))
            reasons.append(F.when(x.isNull() | y.isNull(), F.lit(f"{spec.name}: no latitude and longitude")))
        elif spec.name in places:
            value, reason = cast_cell(F.col(f"c{places[spec.name]}"), spec)
            typed.append(value.alias(spec.name))
            reasons.append(reason)
    return table.rows.select("line", *typed, F.coalesce(*reasons).alias("reason"))


def load(table: CsvTable, specs: list[ColumnSpec], existing: DataFrame | None = None, pair: dict | None = None) -> LoadResult:
    """Typed rows that are accepted, and (line, reason) of the others.

    Of rows with one key the first line wins, and keys that stand in `existing` are rejected. Rows are ranked
    within their key only, so the work is spread by key.
    """
    rows = typed_rows(table, specs, pair)
    key = next((c.name for c in specs if c.primary_key and not c.auto), None)
    if key:
        # Only rows with good cells and a key are ranked, so rejected ones meet in no group.
        good = F.col("reason").isNull() & F.col(key).isNotNull()
        order = F.row_number().over(Window.partitionBy(key).orderBy("line"))
        repeated = F.concat(F.lit(f"{key}: '"), F.col(key).cast("string"), F.lit("' is there already"))
        ranked = rows.filter(good).withColumn("reason", F.when(order > 1, repeated))
        rows = ranked.unionByName(rows.filter(~good))
        if existing is not None:
            held = existing.select(F.col(key).alias("_held")).distinct()
            rows = rows.join(held, F.col(key) == F.col("_held"), "left").withColumn("reason", F.when(F.col("reason").isNull() & F.col("_held").isNotNull(), repeated).otherwise(F.col("reason"))).drop("_held")
    return LoadResult(rows.filter(F.col("reason").isNull()).drop("reason"), rows.filter(F.col("reason").isNotNull()).select("line", "reason"))

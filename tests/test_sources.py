import random

import pytest
from pyspark.sql import functions as F

from tessera.plans.results import export_csv
from tessera.sources import csv_load, tables
from tessera.sources.csv_load import ColumnSpec
from tessera.streaming.ingest import ingest


def written(tmp_path, text, name="t.csv", encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_inference(spark, tmp_path):
    rows = "\n".join(f'{i},name {i},{i}.5,{"true" if i % 2 else "FALSE"},"({i}, -{i}.25)",0{i}' for i in range(1, 30))
    table = csv_load.read_csv(spark, written(tmp_path, "id,Full Name,rating,active,place,zip\n\n" + rows + "\n"))
    specs = csv_load.infer_schema(table)
    assert [(c.name, str(c)) for c in specs] == [
        ("id", "INT"), ("full_name", "VARCHAR(20)"), ("rating", "FLOAT"), ("active", "BOOL"), ("place", "POINT"), ("zip", "VARCHAR(20)"),
    ]
    assert specs[0].primary_key
    assert csv_load.create_statement("t", specs[:2]) == "CREATE TABLE t (id INT PRIMARY KEY, full_name VARCHAR(20));"
    loaded = csv_load.load(table, specs)
    assert loaded.summary()["loaded"] == 29
    assert loaded.accepted.filter("id = 2").select("place.x", "place.y", "active", "line").first() == (2.0, -2.25, False, 4)


def test_late_violation_makes_text(spark, tmp_path):
    table = csv_load.read_csv(spark, written(tmp_path, "postalcode,n\n" + "".join(f"{10000 + i},1\n" for i in range(250)) + "39452-6632,1\n"))
    assert [str(c) for c in csv_load.infer_schema(table)] == ["VARCHAR(20)", "INT"]


def test_separators_and_encodings(spark, tmp_path):
    table = csv_load.read_csv(spark, written(tmp_path, "﻿id;año\n1;ñandú\n2;\"a;b\"\n"))
    assert table.header == ["id", "año"]
    assert sorted(r["c1"] for r in table.rows.collect()) == ["a;b", "ñandú"]
    latin = csv_load.read_csv(spark, written(tmp_path, "id;año\n1;ñandú\n", "l.csv", "latin-1"))
    assert latin.rows.first()["c1"] == "ñandú"
    for bad in ("", "a,,b\n1,2,3\n", "a,A\n1,2\n"):
        with pytest.raises(ValueError):
            csv_load.read_csv(spark, written(tmp_path, bad, "bad.csv"))


def test_rejects(spark, tmp_path):
    text = "id,name,score\n1,a,2.5\n2,b,x\n1,again,3\n3,toolongname,1\n4,d\n5,e,1,9\n99999999999,f,1\n7,g,1e5\n8,h,-4\n"
    specs = [ColumnSpec("id", "INT", None, True), ColumnSpec("name", "VARCHAR", 6), ColumnSpec("score", "FLOAT")]
    result = csv_load.load(csv_load.read_csv(spark, written(tmp_path, text)), specs, spark.createDataFrame([(8,)], "id int"))
    assert sorted(r["id"] for r in result.accepted.collect()) == [1]
    assert [(r["line"], r["reason"].split(":")[0]) for r in result.rejected.orderBy("line").collect()] == [
        (3, "score"), (4, "id"), (5, "name"), (6, "3 fields were expected, not 2"), (7, "3 fields were expected, not 4"), (8, "id"), (9, "score"), (10, "id"),
    ]


def test_statistics_and_key(spark, tmp_path):
    table = csv_load.read_csv(spark, written(tmp_path, "name,uuid,v\na,1,\na,2,x\n,3,x\n"))
    stats = csv_load.column_stats(table).collect()
    assert [(s["nulls"], s["duplicates"]) for s in stats] == [(1, 1), (0, 0), (1, 1)]
    assert stats[0]["sample_values"] == ["a", "a"]
    assert csv_load.suggest_key(csv_load.infer_schema(table), stats) == "uuid"


def test_points_from_coordinates(spark, tmp_path):
    table = csv_load.read_csv(spark, written(tmp_path, "id,lng,lat\n1,-77.5,-12.5\n2,10,20\n"))
    specs = csv_load.infer_schema(table)
    pair = csv_load.point_pair(table, specs)
    assert pair == {"column": "location", "lat": "lat", "lng": "lng"}
    loaded = csv_load.load(table, [*specs, ColumnSpec("location", "POINT")], pair=pair).accepted
    assert loaded.filter("id = 1").select("location.x", "location.y").first() == (-12.5, -77.5)
    far = csv_load.read_csv(spark, written(tmp_path, "lat,lng\n95,1\n", "far.csv"))
    assert csv_load.point_pair(far, csv_load.infer_schema(far)) is None


def test_header_mapping():
    specs = [ColumnSpec("c_digo", "TEXT"), ColumnSpec("id", "INT", auto=True)]
    assert csv_load.map_header(["Código", "extra"], specs, frozenset({"id"})) == ({"c_digo": 0}, ["extra"])
    with pytest.raises(ValueError):
        csv_load.map_header(["x"], specs)
    with pytest.raises(ValueError):
        csv_load.map_header(["a b", "a_b"], specs)
    assert csv_load.identifier("1st") == "t_1st" and csv_load.identifier("Select") == "t_select"
    with pytest.raises(ValueError):
        csv_load.safe_path("/data", "../x.csv")


def test_line_numbers_over_many_blocks(spark, tmp_path):
    path = written(tmp_path, "".join(f"line {i}\n" for i in range(1, 5001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = csv_load.numbered_lines(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 5000 and all(r["value"] == f"line {r['line']}" for r in rows)


def test_table_changes(spark, tmp_path):
    t = tables.Table(spark, str(tmp_path / "t"), "id").create(spark.createDataFrame([(3, "c"), (1, "a")], "id int, v string"))
    t.insert((2, "b"))
    with pytest.raises(ValueError):
        t.insert((2, "again"))
    with pytest.raises(ValueError):
        t.insert((5,))
    assert t.next_serial() == 4
    report = t.delete("v", "a").reorganise()
    assert report["after"]["rows"] == 2 and sorted(r["id"] for r in t.rows().collect()) == [2, 3]
    assert t.info()["rows"] == 2
    t.export_csv(str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2


def test_serial_numbers_follow_the_order(spark):
    values = random.Random(1).sample(range(10_000), 500)
    rows = tables.with_serial(spark.createDataFrame([(v,) for v in values], "v int").repartition(7), "v", start=10).collect()
    assert sorted((r["v"], r["id"]) for r in rows) == [(v, i + 10) for i, v in enumerate(sorted(values))]


def test_serial_numbers_of_many_wide_rows(spark):
    n = 600_000
    wide = spark.range(0, n, 1, 12).select(F.pmod(F.xxhash64("id"), F.lit(n * 3)).alias("v"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 6).alias("w"))
    got = tables.with_serial(wide, "v", "w").agg(F.count("*"), F.count_distinct("id"), F.min("id"), F.max("id")).first()
    assert tuple(got) == (n, n, 1, n)


def test_declared_tables_and_files_appended(spark, tmp_path):
    t = tables.Table(spark, str(tmp_path / "t")).declare([ColumnSpec("name", "VARCHAR", 5), ColumnSpec("n", "FLOAT")])
    assert t.rows().dtypes == [("id", "int"), ("name", "string"), ("n", "double")]
    t.insert(("a", 1.0), ("b", 2.0)).insert(("c", 3.0))
    with pytest.raises(ValueError):
        t.insert(("too long", 1.0))
    assert t.load_csv(written(tmp_path, "name,n\nd,4\nlonger,5\ne,x\n", "more.csv"))["loaded"] == 1
    assert sorted(map(tuple, t.rows().collect())) == [(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0), (4, "d", 4.0)]
    with pytest.raises(ValueError):
        tables.Table(spark, str(tmp_path / "u"), "id").create(spark.createDataFrame([(1,), (1,)], "id int"))
    t.drop()
    assert not (tmp_path / "t").exists()
    with pytest.raises(ValueError):
        t.rows()


def test_a_file_makes_a_table(spark, tmp_path):
    t = tables.Table(spark, str(tmp_path / "t"))
    assert t.load_csv(written(tmp_path, "id,lat,lng\n1,-12.5,77\n2,10,20\n")) == {"loaded": 2, "rejected": 0, "errors": []}
    assert t.key == "id" and t.rows().filter("id = 1").select("location.x").first()[0] == -12.5
    more = t.load_csv(written(tmp_path, "id,lat,lng\n2,1,1\n3,5,6\n3,7,8\n4,?,8\n", "more.csv"))
    assert (more["loaded"], more["rejected"], [e["line"] for e in more["errors"]]) == (1, 3, [2, 4, 5])
    assert sorted(r["id"] for r in t.rows().collect()) == [1, 2, 3]


def test_line_breaks_in_quotes_and_folders(spark, tmp_path):
    text = 'id,note\n1,"one\ntwo ""x"", three\n\nfour"\n2,plain\n\n3,"a\nb"\n'
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16")
    try:
        rows = csv_load.read_csv(spark, written(tmp_path, text)).rows.orderBy("line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r["line"], r["c0"], r["c1"]) for r in rows] == [(2, "1", 'one\ntwo "x", three\n\nfour'), (6, "2", "plain"), (8, "3", "a\nb")]
    folder = tmp_path / "parts"
    folder.mkdir()
    for i in range(3):
        written(folder, "id,v\n" + "".join(f"{10 * i + j},x\n" for j in range(10)), f"part-{i}.csv")
    table = csv_load.read_csv(spark, str(folder))
    assert sorted(int(r["c0"]) for r in table.rows.collect()) == list(range(30))
    assert table.rows.agg(F.count_distinct("line")).first()[0] == 30


def test_words_of_the_language_are_no_columns():
    assert [csv_load.identifier(n) for n in ("count", "MAX", "asc", "hash", "name")] == ["t_count", "t_max", "t_asc", "t_hash", "name"]


def test_first_by_key(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 5, "c")], "k int, line int, v string")
    assert sorted(r["v"] for r in tables.first_by_key(df, "k", "line").collect()) == ["a", "c"]


def test_stream_keeps_the_first_of_a_key(spark, tmp_path):
    source = tmp_path / "in"
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", "a"), (1, "2024-01-01 00:01:00", "b"), (2, "2024-01-01 00:02:00", "c")], "id int, ts string, v string")
    rows.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("id int, ts timestamp, v string").parquet(str(source))
    ingest(stream, str(tmp_path / "out"), "id", "ts", str(tmp_path / "check")).awaitTermination(120)
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_a_result_is_exported_whole(spark, tmp_path):
    df = spark.range(300).select("id", F.struct((F.col("id") * 1.5).alias("x"), F.lit(-2.0).alias("y")).alias("place"), F.array("id").alias("many"))
    export_csv(df, str(tmp_path / "out"))
    back = csv_load.read_csv(spark, str(tmp_path / "out"))
    kinds = {c.name: c.kind for c in csv_load.infer_schema(back)}
    assert (kinds["id"], kinds["place"]) == ("INT", "POINT")
    loaded = csv_load.load(back, [csv_load.ColumnSpec("id", "INT", None, True), csv_load.ColumnSpec("place", "POINT"), csv_load.ColumnSpec("many", "TEXT")]).accepted
    assert sorted((r["id"], r["place"]["x"], r["many"]) for r in loaded.collect()) == [(i, i * 1.5, f"[{i}]") for i in range(300)]

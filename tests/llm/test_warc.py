import gzip
import hashlib
import io
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import warc


def brute(rows, least=100):
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[h or ""].append(i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = min((x for x in groups[h or ""] if x is not None), default=None)
        again = len(data) >= least and i != first
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


BIG = "<p>" + "é" * 200_000 + "</p>"
ROWS = [
    (1, "http://a", "<p>" + "x" * 100), (2, "http://b", "<p>" + "x" * 100), (3, None, "short"), (4, "http://d", "short"), (5, "u", None), (6, "u\r\nX: y", ""),
    (7, "u", BIG), (8, "u", BIG), (9, "u", "a\r\n\r\nb" * 40), (0, "u", "<p>" + "x" * 100), (10, "u", "\r\n" * 60), (11, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 9),
    (12, "u", "twice" * 30), (12, "u", "twice" * 30), (None, "u", "without an id " * 20),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, payload string, records int")


def test_round_trip(spark, tmp_path):
    got = warc.round_trip(frame(spark, ROWS), f"file://{tmp_path}/w").collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr) == brute(ROWS)
    html = {r["page_id"]: r["html"] for r in got if r["record_type"] == "response"}
    assert html[7] == BIG and html[9] == "a\r\n\r\nb" * 40 and html[5] == ""
    for p in (tmp_path / "w" / "members").glob("*.warc.gz"):
        index = [line.split("\t") for line in (p.parent / f"{p.name}.idx").read_text().splitlines()]
        data = p.read_bytes()
        assert sum(int(n) for _, n, _, _ in index) == len(data)
        for offset, length, page, kind in index:
            record = gzip.decompress(data[int(offset) : int(offset) + int(length)])
            assert record.startswith(b"WARC/1.1\r\n") and f"WARC-Type: {kind}".encode() in record and f"<urn:page:{page}>".encode() in record


def test_archives_are_cut_by_size_and_are_one_stream(spark, tmp_path):
    df = spark.range(50).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.concat(F.lit("word "), F.col("id").cast("string")), 50).alias("html")).coalesce(1)
    made = warc.write_archives(warc.payload_verdicts(df), f"file://{tmp_path}/s", archive_bytes=4000).collect()
    assert len(made) > 3 and sum(r["records"] for r in made) == 50
    for p in (tmp_path / "s").glob("*.warc.gz"):
        assert p.read_bytes().count(b"\x1f\x8b\x08") == 1
        assert len(list(warc.stream_records(warc.inflate(io.BytesIO(p.read_bytes()), 100)))) == next(r["records"] for r in made if r["name"] == p.name)
    warc.normalise_archives(spark, f"file://{tmp_path}/s", f"file://{tmp_path}/m").count()
    assert warc.read_archives(spark, f"file://{tmp_path}/m").count() == 50


def test_damage_is_noticed(tmp_path):
    whole = gzip.compress(warc.record(1, "u", b"payload", "d", None))
    with pytest.raises(Exception):
        list(warc.stream_records(warc.inflate(io.BytesIO(whole[:-20]))))
    for step in (1, 7, 1 << 20):
        assert len(list(warc.stream_records(warc.inflate(io.BytesIO(whole + whole), step)))) == 2


def test_hot_payload_and_empty_table(spark, tmp_path):
    rows = [(i, "u", "<p>hot</p>" * 20 if i % 3 == 0 else f"page {i} " * 20) for i in range(600)]
    got = warc.round_trip(frame(spark, rows), f"{tmp_path}/h", with_html=False).collect()
    assert sum(r["refers_to"] == 0 for r in got) == 199
    assert warc.round_trip(frame(spark, []), f"{tmp_path}/e").count() == 0

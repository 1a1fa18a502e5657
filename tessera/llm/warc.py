"""WARC archives: writing whole-file gzip streams, normalising them to one member per record, reading by index."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import marks, new_folder, publish, ship, with_mark

ARCHIVE_BYTES = 32 << 20
"""An archive is closed after so many bytes before compression, so every file fits in a task."""
LEAST_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"
CRLF = b"\r\n"


def payload_verdicts(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """pages (page_id, url, html) with payload, digest, and refers_to: the response that a revisit repeats.

    Of equal payloads of at least `least` bytes, the one with the smallest page_id is the response. Digests are
    counted first; only pages whose digest may occur twice are shuffled with their payloads.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload")).withColumn(
        "digest", F.sha2("payload", 256)
    )
    first = publish(
        rows.filter(F.octet_length("payload") >= least)
        .groupBy(F.col("digest").alias("f_digest"))
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n"),
        "warc-groups",
    )
    rows = with_mark(rows, marks(first, "f_digest"), "repeated", "digest")
    lone = rows.filter(~F.col("repeated")).select("page_id", "url", "payload", "digest", F.lit(None).cast(pages.schema["page_id"].dataType).alias("refers_to"))
    maybe = rows.filter("repeated").join(first, F.col("digest") == F.col("f_digest"), "left")
    # In this order a task that runs again writes the same files.
    maybe = maybe.sortWithinPartitions("page_id", "digest", "url")
    again = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return lone.unionByName(maybe.select("page_id", "url", "payload", "digest", again.alias("refers_to")))


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header and leaves the payload out."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    clean = "".join(" " if c in "\r\n" else c for c in url or "")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", clean),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if kind == "revisit":
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    return head + CRLF + block + CRLF + CRLF


def headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:] if line)}


def store(path: str):
    """(file system, path in it) of a URI that Spark's shared folder may have."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def put(folder: str, name: str, chunks: Iterator[bytes]) -> int:
    """Write a file under a name of its own and then give it its name, so that a task that runs again leaves one file."""
    import uuid

    from pyarrow import fs

    system, path = store(folder)
    system.create_dir(path, recursive=True)
    part, size = f"{path}/.{name}.{uuid.uuid4().hex}", 0
    with system.open_output_stream(part, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    try:
        system.move(part, f"{path}/{name}")
    except OSError:
        # Not every store replaces a file; what is there is the same file of a task that ran before.
        if system.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
            raise
        system.delete_file(part)
    return size


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write records (page_id, url, payload, digest, refers_to) as .warc.gz files of one gzip stream each.

    Returns one row per archive: name, records, bytes. Files are cut by size, and each is streamed to storage.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))))
        row = next(rows, None)
        while row is not None:
            count = 0

            def stream():
                nonlocal row, count
                pack, raw = zlib.compressobj(6, zlib.DEFLATED, 31), 0
                while row is not None and raw < archive_bytes:
                    data = record(*row)
                    raw, count, row = raw + len(data), count + 1, next(rows, None)
                    yield pack.compress(data)
                yield pack.flush()

            name = f"part-{part:06d}-{number:05d}.warc.gz"
            size = put(folder, name, stream())
            yield pa.RecordBatch.from_pydict({"name": [name], "records": [count], "bytes": [size]})
            number += 1

    return records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, "name string, records long, bytes long")


def stream_records(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of every record of a decompressed stream, holding one record at a time."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        while (end := held.find(b"\r\n\r\n")) >= 0:
            size = int(headers(bytes(held[:end])).get("content-length", "0"))
            stop = end + 4 + size
            if len(held) < stop + 4:
                break
            yield bytes(held[:end]), bytes(held[end + 4 : stop])
            del held[: stop + 4]
    if held.strip():
        raise ValueError("the archive ends inside a record")


def inflate(source: BinaryIO, step: int = 1 << 16) -> Iterator[bytes]:
    """The content of a gzip file of any number of members, piece by piece; neither file nor content is held whole."""
    unpack, started = zlib.decompressobj(31), False
    while held := source.read(step):
        while held:
            started = True
            yield unpack.decompress(held)
            held = unpack.unused_data
            if unpack.eof:
                unpack, started = zlib.decompressobj(31), False
    if started:
        raise ValueError("the gzip stream is cut off")


INDEX = "archive string, offset long, length long, page_id long, record_type string"


def normalise_archives(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite every archive of `source` with each record as a gzip member of its own, beside an offset index.

    Each whole-file stream is inflated once; members go to `target`, and the sidecar `<archive>.idx` lists offset,
    length, page and type line by line. Returns the index: one row per record.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = store(source)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                name, lines, offset = path.rsplit("/", 1)[-1], [], 0

                def members():
                    with system.open_input_stream(f"{root}/{name}", compression=None) as archive:
                        yield from rewritten(archive)

                def rewritten(archive):
                    nonlocal offset
                    for head, block in stream_records(inflate(archive)):
                        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = pack.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()
                        fields = headers(head)
                        page = fields["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
                        lines.append((name, offset, len(member), int(page) if page else None, fields["warc-type"]))
                        offset += len(member)
                        yield member

                put(target, name, members())
                text = "".join(f"{o}\t{n}\t{'' if p is None else p}\t{k}\n" for _, o, n, p, k in lines)
                put(target, f"{name}.idx", iter([text.encode()]))
                names = [c.split()[0] for c in INDEX.split(", ")]
                types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in lines], t) for i, t in enumerate(types)], names=names)

    # Spark lists the archives and deals them out; a task streams them itself, so their size is not bounded.
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(source).select("path")
    return files.mapInArrow(rewrite, INDEX)


READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, html string"


def read_archives(spark: SparkSession, folder: str, with_html: bool = True) -> DataFrame:
    """Read normalised archives through their sidecar indexes: one row per record, its member inflated by offset.

    Digests of responses are computed from what was read; a revisit carries those of the record it refers to.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = store(folder)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = []
                with system.open_input_file(f"{root}/{path.rsplit('/', 1)[-1].removesuffix('.idx')}") as archive:
                    for line in content.decode().splitlines():
                        offset, length, _, kind = line.split("\t")
                        archive.seek(int(offset))
                        head, _, rest = zlib.decompress(archive.read(int(length)), 31).partition(b"\r\n\r\n")
                        fields = headers(head)
                        http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
                        number = lambda v: int(d) if (d := v.removeprefix("<urn:page:").removesuffix(">")) else None
                        said = fields["warc-payload-digest"].removeprefix("sha256:")
                        size = int(headers(http)["content-length"])
                        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != said):
                            raise ValueError(f"record at {offset} of {path} is damaged")
                        rows.append((number(fields["warc-record-id"]), fields["warc-target-uri"], kind, number(fields.get("warc-refers-to", "")), size, said, payload.decode() if with_html and kind == "response" else None))
                        if len(rows) == 500:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = {"long": pa.int64(), "string": pa.string()}
        named = [c.split() for c in READ.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[t]) for i, (_, t) in enumerate(named)], names=[n for n, _ in named])

    indexes = spark.read.format("binaryFile").option("pathGlobFilter", "*.idx").load(folder).select("path", "content")
    return indexes.mapInArrow(read, READ)


def round_trip(pages: DataFrame, folder: str | None = None, least: int = LEAST_REVISIT, with_html: bool = True) -> DataFrame:
    """Write pages (page_id, url, html) to archives, normalise them, and read every record back.

    Null html is an empty payload, null url an empty target. A row repeated with its page_id repeats its record;
    rows of null id carry no id, and one of them is the response only if no row of the group has an id. Other
    columns are ignored. An empty table makes no archive and gives no rows.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = folder or new_folder(spark, "warc")
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    written = write_archives(payload_verdicts(slim, least), f"{folder}/streams").agg(F.sum("records")).first()[0]
    if not written:
        return spark.createDataFrame([], READ)
    indexed = normalise_archives(spark, f"{folder}/streams", f"{folder}/members").count()
    if indexed != written:
        raise ValueError(f"{written} records were written and {indexed} indexed")
    return read_archives(spark, f"{folder}/members", with_html)

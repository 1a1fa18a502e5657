"""Helpers of the training-data operators: shared storage and bounded membership marks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the warehouse where it is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"


BATCH_ROWS = 500
"""Rows of an Arrow batch: long texts are held by the hundred, not by Spark's ten thousand."""


def ship(spark: SparkSession) -> None:
    """Prepare a session for the Python steps: workers can import this package, and batches are small."""
    scratch.ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def publish(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends there, so a lost executor costs no recomputation."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MARK_BITS = 26
"""Marks take 2**26 bits, so 8 MB at most, however many keys they hold."""


def marks(keys: DataFrame, *columns: str) -> DataFrame:
    """Bitmaps (at most 2048 of 4 KB) of the hashes of the given columns: a bounded, one-sided membership test."""
    slot = F.pmod(F.xxhash64(*columns), F.lit(1 << MARK_BITS))
    return (
        keys.select(slot.alias("slot"))
        .groupBy(F.bitmap_bucket_number("slot").alias("_mark_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_mark_bits"))
    )


def with_mark(rows: DataFrame, marked: DataFrame, name: str, *columns: str | Column) -> DataFrame:
    """Add the boolean `name`: false where the row's key is surely not among the marked ones, else true.

    The broadcast side has at most 2048 rows of 4 KB. Full marks only cost work, never rows.
    """
    slot = F.pmod(F.xxhash64(*columns), F.lit(1 << MARK_BITS))
    bit = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("_mark_bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    power = F.get(F.array(*[F.lit(1 << i) for i in range(8)]), F.pmod(bit, F.lit(8)).cast("int"))
    hit = byte.bitwiseAND(power) != 0
    joined = rows.join(F.broadcast(marked), F.bitmap_bucket_number(slot) == F.col("_mark_bucket"), "left")
    return joined.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_mark_bucket", "_mark_bits")


def bounded_sample(rows: DataFrame, size: int, *key: str) -> list:
    """At most `size` rows, those whose hash of `key` is least, in that order.

    Only hashes are sorted; then the rows up to the last hash are fetched, so that the driver gets `size` rows
    however many partitions there are. Rows of equal keys may be left out beyond `size`.
    """
    hashed = rows.withColumn("_hash", F.xxhash64(*key))
    last = hashed.select("_hash").orderBy("_hash").limit(size).agg(F.max("_hash")).first()[0]
    if last is None:
        return []
    found = hashed.filter(F.col("_hash") <= last).limit(size).collect()
    return sorted(found, key=lambda r: (r["_hash"], str([r[k] for k in key])))

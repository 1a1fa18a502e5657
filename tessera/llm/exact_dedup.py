"""Exact de-duplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import marks, publish, with_mark


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 256, digest_all: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are. Rows are counted by length, those that share one by the hash of their
    first `prefix` characters, and only rows that share both are hashed in full (`digest_all`: every row, for
    callers that want the digest anyway). Counts are combined before each shuffle, and only keys are shuffled.

    Null text counts as empty. The largest doc_id of a group stays; null ids are smaller than others. Of rows
    repeated with their id, one stays. Other columns are ignored, whatever their names. An empty table gives none.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select(
        "doc_id", "text", F.octet_length("text").alias("size"), F.xxhash64(F.substring("text", 1, prefix)).alias("head")
    )
    heads = keyed.groupBy("size", "head").agg(F.count(F.lit(1)).alias("n"))
    lengths = heads.groupBy("size").agg(F.sum("n").alias("n")).filter("n > 1").select("size")
    alive = heads.filter("n > 1").join(lengths, "size", "left_semi")
    checked = with_mark(keyed, marks(alive, "size", "head"), "alive", "size", "head")
    full = F.unhex(F.sha2("text", 256))
    rows = publish(
        checked.select("doc_id", "size", "head", "alive", (full if digest_all else F.when(F.col("alive"), full)).alias("digest")), "exact"
    )
    # A row that was not hashed joins on its own head and length, which no group has.
    rows = rows.withColumn("key", F.coalesce(F.col("digest"), F.encode(F.concat_ws("/", "size", "head"), "UTF-8")))
    # Written first, so that the join reads both sides anew and Spark can split a hot group's rows.
    groups = publish(
        rows.filter("alive")
        .groupBy(F.col("key").alias("group_key"))
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1"),
        "exact-sizes",
    )
    joined = rows.join(groups, rows.key == groups.group_key, "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        "digest",
        F.xxhash64("key").alias("tag"),
    )
    # Each id has few rows, so this window is even however large a group is.
    copy = F.row_number().over(Window.partitionBy("doc_id", "tag").orderBy(F.lit(1)))
    return joined.withColumn("copy", F.when(F.col("group_size") > 1, copy).otherwise(F.lit(1))).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops; all columns stay as they are.

    Rows of no group pass without a shuffle; only rows that may be copies travel with their texts. Null text counts as
    empty, of rows repeated with their id one stays, texts are compared whole, and an empty table gives no rows.
    """
    verdicts = publish(exact_dedup(docs, id_col, text_col).filter("group_size > 1"), "exact-groups")
    rows = docs.select(
        F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest")
    )
    verdicts = verdicts.select("doc_id", "kept", F.unhex("text_sha256").alias("digest"))
    rows = with_mark(rows, marks(verdicts, "digest"), "suspect", "digest")
    keepers = verdicts.filter("kept").select(F.col("doc_id").alias("k_id"), F.col("digest").alias("k_digest")).distinct()
    groups = verdicts.select(F.col("digest").alias("g_digest")).distinct()
    suspects = rows.filter("suspect")
    stay = suspects.join(keepers, suspects.doc_id.eqNullSafe(keepers.k_id) & (suspects.digest == keepers.k_digest), "left_semi")
    lone = suspects.join(groups, suspects.digest == groups.g_digest, "left_anti")
    return (
        rows.filter(~F.col("suspect")).select("row.*")
        .unionByName(stay.dropDuplicates(["doc_id", "digest"]).select("row.*"))
        .unionByName(lone.select("row.*"))
    )

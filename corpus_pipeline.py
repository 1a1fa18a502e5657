"""The corpus pipeline: language, exact copies, near copies, source mix, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.exact_dedup import drop_exact_copies
from tessera.llm.language_id import drop_unidentified, fit
from tessera.llm.mixing import repeat_documents
from tessera.llm.near_dedup import drop_near_copies
from tessera.llm.packing import pack_documents
from tessera.llm.shared import publish, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that are in no language that the labelled ones among them teach."""
    return drop_unidentified(docs, fit(docs.select(F.col("doc_id").alias("key"), "text", "lang")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keep the document with the largest doc_id."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, keep the document with the smallest doc_id."""
    return drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and sample whole documents to the sources' targets, prose (letters and blanks) first."""
    text = F.coalesce(F.col("text"), F.lit(""))
    prose = F.length(F.regexp_replace(text, r"[^\p{L}\p{M} ]+", "")) / F.greatest(F.length(text), F.lit(1))
    return repeat_documents(docs, F.greatest(prose, F.lit(0.05)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the mix's documents into sequences: one row per piece."""
    return pack_documents(docs.select("doc_id", "text"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixture", mixture), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over what the one before kept, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = publish(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The registered queries of the training-data operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text
from .exact_dedup import exact_dedup
from .language_id import fit, identify_language
from .license_scan import scan_licenses
from .mixing import mix, word_count
from .near_dedup import near_duplicates
from .packing import pack_documents
from .pii import find_personal_data, fit_on
from .shared import table
from .topk_search import search
from .warc import round_trip


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links", "kept")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract_main_text(pages, html_text.fit_on(pages))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0).drop("evaluated")


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"), with_html=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_personal_data(docs, fit_on(docs))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    model = fit(docs.filter(~F.coalesce(held_out, F.lit(False))).select(F.col("doc_id").alias("key"), "text", "lang"))
    return identify_language(docs, model, "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"))


def quality_weights(labels: DataFrame) -> DataFrame:
    """(q_id, quality_weight): 2 for documents labelled good, 0.5 for those labelled bad."""
    good = F.max(F.col("quality").cast("int"))
    return labels.groupBy(F.col("doc_id").alias("q_id")).agg(F.when(good == 1, F.lit(2.0)).when(good == 0, F.lit(0.5)).alias("quality_weight"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    weights = quality_weights(table(spark, sf_dir, "labels"))
    slim = docs.join(weights, F.col("doc_id") == F.col("q_id"), "left")
    return mix(slim, F.coalesce("quality_weight", F.lit(1.0)), F.col("size")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), digest_all=True)


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op7_language_id": op7_language_id,
    "op2_order_minhash": op2_order_minhash,
    "op3_main_text": op3_main_text,
    "op4_exact_topk": op4_exact_topk,
    "op8_warc_round_trip": op8_warc_round_trip,
    "op5_personal_data": op5_personal_data,
    "op6_mix_sources": op6_mix_sources,
    "op9_license_scan": op9_license_scan,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLES = {
    "op4_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
             r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    # Ranks by weight and prefix sums stand for the rounds and the slices; the cut of a source is where its rest ends.
    "op6_mix_sources": r"""
        WITH q AS (SELECT doc_id, CASE max(CAST(quality AS INTEGER)) WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 END::DOUBLE AS w FROM labels GROUP BY doc_id),
             d AS (SELECT documents.doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, coalesce(q.w, 1.0) AS w
                   FROM documents LEFT JOIN q ON documents.doc_id = q.doc_id),
             k AS (SELECT *, -ln((('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), size, 17)), 1, 13))::BIGINT + 0.5::DOUBLE)
                                 / 4503599627370496::DOUBLE) / w AS key FROM d),
             s AS (SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS cap,
                          ([5.0, 2.0, 1.0]::DOUBLE[])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source),
             l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))
                             / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
                   FROM s WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
             f AS (SELECT *, (SELECT min_by(level, cap / weight) FROM l WHERE level * weight <= cap) AS final FROM l),
             t AS (SELECT source, source_size, least(cap, coalesce(final * weight, cap)) AS target FROM f),
             e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
             r AS (SELECT k.*, source_size, target, epochs, greatest(round(target)::BIGINT - epochs * source_size, 0) AS rest,
                          coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
                   FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
        SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(least(rest - before, size), 0) AS BIGINT) AS taken, source FROM r""",
    "op8_warc_round_trip": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
                   FROM pages),
             f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f""",
    "op10_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
}

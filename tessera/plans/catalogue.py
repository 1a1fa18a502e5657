"""Registered queries of the relational, spatial, text and vector operators, with their oracles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, normal_text, terms
from ..functions.vector import cosine_distance, l2_distance
from ..operators import fulltext, recommend, relational, spatial, vectors
from ..sources import csv_load, tables
from ..sources.scratch import new_folder, ship

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def add(function):
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Relational: scans, filters, aggregates, pages.


@query("SELECT * FROM supplier")
def scan_all(spark, sf):
    return relational.project(read(spark, sf, "supplier"), "*")


@query("SELECT s_suppkey AS id, s_name AS name, s_acctbal FROM supplier")
def project_alias(spark, sf):
    return relational.project(read(spark, sf, "supplier"), ("s_suppkey", "id"), ("s_name", "name"), "s_acctbal")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 5")
def filter_eq(spark, sf):
    return relational.project(relational.where(read(spark, sf, "customer"), ("c_nationkey", "=", 5)), "c_custkey", "c_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 200000")
def filter_range(spark, sf):
    return relational.where(read(spark, sf, "orders"), ("o_totalprice", ">", 100000), ("o_totalprice", "<=", 200000)).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 AND c_nationkey = 5")
def filter_between(spark, sf):
    return relational.where(read(spark, sf, "customer"), ("c_acctbal", "between", (0, 5000)), ("c_nationkey", "=", 5)).select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 500 AND o_orderkey < 4000 AND o_orderstatus = 'F' AND o_totalprice < 150000")
def filter_and_residual(spark, sf):
    rows = relational.where(
        read(spark, sf, "orders"), ("o_orderkey", ">=", 500), ("o_orderkey", "<", 4000), ("o_orderstatus", "=", "F"), ("o_totalprice", "<", 150000)
    )
    return rows.select("o_orderkey", "o_custkey")


@query("SELECT p_partkey, p_size FROM part WHERE p_size = 3")
def int_literal_truncation(spark, sf):
    return relational.where(read(spark, sf, "part"), ("p_size", "=", 3.7)).select("p_partkey", "p_size")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey")
def sequential_scan_ordered(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 500 ORDER BY o_orderkey")
def sequential_range(spark, sf):
    return relational.where(read(spark, sf, "orders"), ("o_orderkey", "between", (100, 500))).select("o_orderkey", "o_totalprice").orderBy("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def limit_offset_ordered(spark, sf):
    return relational.page(read(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey"), 20, 40)


@query("SELECT count(*) AS count FROM lineitem")
def count_star(spark, sf):
    return relational.aggregate(read(spark, sf, "lineitem"), ("count", "*"))


@query("SELECT min(c_acctbal) AS min_c_acctbal, max(c_acctbal) AS max_c_acctbal, min(c_name) AS min_c_name FROM customer")
def min_max(spark, sf):
    return relational.aggregate(read(spark, sf, "customer"), ("min", "c_acctbal"), ("max", "c_acctbal"), ("min", "c_name"))


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS sum_l_linenumber, round(avg(l_quantity), 6) AS avg_l_quantity, round(sum(l_extendedprice), 2) AS sum_l_extendedprice FROM lineitem")
def sum_avg(spark, sf):
    found = relational.aggregate(read(spark, sf, "lineitem"), ("sum", "l_linenumber"), ("avg", "l_quantity"), ("sum", "l_extendedprice"))
    return found.select("sum_l_linenumber", F.round("avg_l_quantity", 6).alias("avg_l_quantity"), F.round("sum_l_extendedprice", 2).alias("sum_l_extendedprice"))


@query(
    "SELECT count(*) AS n, min(l_quantity) AS min_l_quantity, max(l_shipmonth) AS max_l_linestatus FROM (SELECT l_quantity, l_linestatus AS l_shipmonth"
    " FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 10)"
)
def multi_agg_where(spark, sf):
    rows = relational.where(read(spark, sf, "lineitem"), ("l_returnflag", "=", "R"), ("l_quantity", ">=", 10))
    return relational.aggregate(rows, ("count", "*", "n"), ("min", "l_quantity"), ("max", "l_linestatus"))


@query("SELECT count(*) AS count, min(c_acctbal) AS min_c_acctbal, sum(c_acctbal) AS sum_c_acctbal, avg(c_acctbal) AS avg_c_acctbal FROM customer WHERE c_custkey < 0")
def agg_empty(spark, sf):
    rows = relational.where(read(spark, sf, "customer"), ("c_custkey", "<", 0))
    return relational.aggregate(rows, ("count", "*"), ("min", "c_acctbal"), ("sum", "c_acctbal"), ("avg", "c_acctbal"))


# Spatial: part as points (size, price).

POINTS = "(SELECT p_partkey, p_brand, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part)"
GAP = "sqrt((x - 25) * (x - 25) + (y - 950) * (y - 950))"


def points(spark, sf) -> DataFrame:
    return read(spark, sf, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))


@query(f"SELECT p_partkey, x, y FROM {POINTS} WHERE x = 25 AND y = (SELECT min(p_retailprice) FROM part WHERE p_size = 25)")
def point_equality(spark, sf):
    rows = points(spark, sf)
    y = rows.filter("x = 25").agg(F.min("y")).first()[0]
    packed = rows.select("p_partkey", F.struct("x", "y").alias("pt"))
    found = relational.where(packed, ("pt", "=", (25, -1.0 if y is None else y)))
    return found.select("p_partkey", "pt.x", "pt.y")


@query(f"SELECT p_partkey, x, y FROM {POINTS} WHERE {GAP} <= 10")
def spatial_radius(spark, sf):
    return spatial.radius(points(spark, sf), (25, 950), 10).select("p_partkey", "x", "y")


@query(f"SELECT p_partkey, x, y FROM {POINTS} WHERE {GAP} <= 20 AND x < 30")
def spatial_radius_residual(spark, sf):
    return spatial.radius(points(spark, sf), (25, 950), 20).filter("x < 30").select("p_partkey", "x", "y")


@query(f"SELECT p_partkey, x, y FROM {POINTS} WHERE {GAP} <= 10")
def spatial_radius_grid(spark, sf):
    grid = spatial.GridIndex(points(spark, sf), new_folder(spark, "grid"), 5.0)
    return grid.radius((25, 950), 10).select("p_partkey", "x", "y")


KNN = f"SELECT p_partkey, p_brand, x, round({GAP}, 6) AS distance FROM {POINTS}"


@query(f"SELECT p_partkey, distance FROM ({KNN} ORDER BY {GAP}, p_partkey LIMIT 10)")
def knn_spatial(spark, sf):
    return spatial.nearest(points(spark, sf), (25, 950), 10, "p_partkey").select("p_partkey", F.round("distance", 6).alias("distance"))


@query(f"SELECT p_partkey, distance FROM ({KNN} ORDER BY {GAP}, p_partkey LIMIT 10)")
def knn_spatial_grid(spark, sf):
    grid = spatial.GridIndex(points(spark, sf), new_folder(spark, "grid"), 5.0)
    return grid.nearest((25, 950), 10, "p_partkey").select("p_partkey", F.round("distance", 6).alias("distance"))


@query(f"SELECT p_partkey, distance FROM ({KNN} ORDER BY {GAP}, p_partkey LIMIT 40) WHERE x < 25")
def knn_then_filter(spark, sf):
    return spatial.nearest(points(spark, sf), (25, 950), 40, "p_partkey").filter("x < 25").select("p_partkey", F.round("distance", 6).alias("distance"))


@query(f"SELECT p_partkey, distance FROM ({KNN} WHERE x < 25 ORDER BY {GAP}, p_partkey LIMIT 40)")
def filter_then_knn(spark, sf):
    return spatial.nearest(points(spark, sf).filter("x < 25"), (25, 950), 40, "p_partkey").select("p_partkey", F.round("distance", 6).alias("distance"))


@query(f"SELECT count(*) AS count, min(y) AS min_y, max(y) AS max_y FROM {POINTS} WHERE {GAP} <= 10")
def agg_over_radius(spark, sf):
    return relational.aggregate(spatial.radius(points(spark, sf), (25, 950), 10), ("count", "*"), ("min", "y"), ("max", "y"))


# Text: documents, language none, then stop words and stems.

TOKENS = "(SELECT *, regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+') AS tokens FROM documents)"


def has(*words: str) -> list[str]:
    return [f"list_contains(tokens, '{w}')" for w in words]


def matching(where: str) -> str:
    return f"SELECT doc_id, lang FROM {TOKENS} WHERE {where}"


def matched(spark, sf, text: str) -> DataFrame:
    return fulltext.search(read(spark, sf, "documents"), "text", text).select("doc_id", "lang")


THBLE, ATTION, WITH = has("thble", "attion", "with")


@query(matching(THBLE))
def match_term(spark, sf):
    return matched(spark, sf, "thble")


@query(matching(f"{THBLE} AND {ATTION}"))
def match_and(spark, sf):
    return matched(spark, sf, "thble AND attion")


@query(matching(f"{THBLE} OR {ATTION}"))
def match_or(spark, sf):
    return matched(spark, sf, "thble OR attion")


@query(matching(f"{WITH} AND NOT {THBLE}"))
def match_not(spark, sf):
    return matched(spark, sf, "with AND NOT thble")


@query(matching(f"({THBLE} OR {ATTION}) AND NOT {WITH}"))
def match_parens(spark, sf):
    return matched(spark, sf, "(thble OR attion) AND NOT with")


@query(matching(f"{THBLE} AND {ATTION} AND {WITH}"))
def match_implicit_and(spark, sf):
    return matched(spark, sf, "Thble attion WITH")


@query(matching(f"{THBLE} AND n_chars < 2000 AND source = 'src1'"))
def match_residual(spark, sf):
    docs = relational.where(read(spark, sf, "documents"), ("n_chars", "<", 2000), ("source", "=", "src1"))
    return fulltext.search(docs, "text", "thble").select("doc_id", "lang")


@query(f"SELECT count(*) AS count FROM {TOKENS} WHERE {THBLE} OR {ATTION}")
def count_match(spark, sf):
    return relational.aggregate(fulltext.search(read(spark, sf, "documents"), "text", "thble OR attion"), ("count", "*"))


@query(matching(f"({THBLE} OR {ATTION}) AND NOT {WITH}"))
def match_inverted_index(spark, sf):
    docs = read(spark, sf, "documents")
    index = fulltext.InvertedIndex(docs, new_folder(spark, "postings"), "doc_id", "text", "none")
    return index.search(docs, "(thble OR attion) AND NOT with").select("doc_id", "lang")


@query(f"SELECT doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS t FROM {TOKENS}) WHERE t = 'thble' GROUP BY doc_id")
def posting_lookup(spark, sf):
    return fulltext.postings(read(spark, sf, "documents"), "doc_id", "text").filter("term = 'thble'").select("doc_id", "tf")


def ranking(words: tuple[str, ...], where: str = "true") -> str:
    values = ", ".join(f"('{w}', {words.count(w)})" for w in sorted(set(words)))
    return f"""
        WITH t AS (SELECT doc_id, unnest(tokens) AS term FROM {TOKENS} WHERE {where}),
             p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
             n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents WHERE {where}),
             f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
             w AS (SELECT doc_id, p.term, (1 + log10(tf)) * log10(n / df) AS w FROM p JOIN f USING (term), n),
             l AS (SELECT doc_id, sqrt(sum(w * w)) AS nd FROM w GROUP BY doc_id),
             q AS (SELECT term, (1 + log10(qtf)) * log10(n / df) AS qw FROM (VALUES {values}) v(term, qtf) JOIN f USING (term), n),
             s AS (SELECT doc_id, sum(w * qw) AS dot FROM w JOIN q USING (term) GROUP BY doc_id)
        SELECT doc_id, round(dot / (nd * (SELECT sqrt(sum(qw * qw)) FROM q)), 6) AS cosine_score FROM s JOIN l USING (doc_id) WHERE dot > 0 AND nd > 0"""


RANKED = ranking(("thble", "attion"))


def ranked(spark, sf, text: str = "thble attion", where: str = "true") -> DataFrame:
    docs = read(spark, sf, "documents").filter(where).select("doc_id", "text", "lang", "n_chars")
    return fulltext.rank(docs, "doc_id", "text", text)


@query(f"SELECT * FROM ({RANKED}) ORDER BY cosine_score DESC, doc_id LIMIT 10")
def rank_topk(spark, sf):
    return fulltext.best(ranked(spark, sf), "doc_id", 10).select("doc_id", "cosine_score")


@query(RANKED)
def rank_all(spark, sf):
    return ranked(spark, sf).select("doc_id", "cosine_score")


@query(f"SELECT * FROM (SELECT * FROM ({RANKED}) ORDER BY cosine_score DESC, doc_id LIMIT 10) ORDER BY cosine_score, doc_id")
def rank_reorder(spark, sf):
    return fulltext.best(ranked(spark, sf), "doc_id", 10, order_by=[F.col("cosine_score"), F.col("doc_id")]).select("doc_id", "cosine_score")


@query(f"SELECT r.doc_id, cosine_score FROM (SELECT * FROM ({RANKED}) ORDER BY cosine_score DESC, doc_id LIMIT 50) r JOIN documents d ON r.doc_id = d.doc_id WHERE n_chars < 3000")
def rank_then_filter(spark, sf):
    docs = read(spark, sf, "documents")
    index = fulltext.InvertedIndex(docs.select("doc_id", "text"), new_folder(spark, "postings"), "doc_id", "text", "none")
    best = fulltext.best(index.score("thble attion"), "doc_id", 50)
    return best.join(docs.filter("n_chars < 3000").select("doc_id"), "doc_id")


@query(f"SELECT * FROM ({ranking(('thble', 'attion'), 'n_chars < 3000')}) ORDER BY cosine_score DESC, doc_id LIMIT 50")
def filter_then_rank(spark, sf):
    return fulltext.best(ranked(spark, sf, where="n_chars < 3000"), "doc_id", 50).select("doc_id", "cosine_score")


STOPS = ", ".join(f"'{w}'" for w in sorted(STOPWORDS))


@query(f"SELECT doc_id, len(list_filter(tokens, lambda t: NOT list_contains([{STOPS}], t))) AS n_terms FROM {TOKENS}")
def stopword_filtered_terms(spark, sf):
    kept = F.filter(terms(F.col("text")), lambda t: ~t.isin(*sorted(STOPWORDS)))
    return read(spark, sf, "documents").select("doc_id", F.size(kept).cast("long").alias("n_terms"))


@query("SELECT doc_id, md5(strip_accents(lower(text))) AS plain FROM documents")
def accent_stripping(spark, sf):
    """The digest of every whole text without accents."""
    return read(spark, sf, "documents").select("doc_id", F.md5(normal_text(F.col("text"))).alias("plain"))


def holds(*words: str) -> str:
    return f"list_has_any(tokens, {list(words)})"


# The forms that the published algorithm cuts to "attion", "run" and "gat", as far as texts hold them: fixed values.
ATTION = holds("attion", "attions", "attione", "attiones", "attioned", "attioning", "attioner", "attioners", "attionly")
RUN = holds("run", "runs", "running")
GAT = holds("gat", "gata", "gatas", "gato", "gatos", "gatar", "gatan", "gatara", "gatado", "gataar", "gataas", "gataado", "gatamente")


@query(matching(GAT))
def match_stemmed_es_forms(spark, sf):
    return fulltext.search(read(spark, sf, "documents"), "text", "gatos", "spanish").select("doc_id", "lang")


@query()
def match_stemmed_es(spark, sf):
    return fulltext.search(read(spark, sf, "documents"), "text", "ciones OR gatos", "spanish").select("doc_id", "lang")


@query(matching(f"{ATTION} AND NOT {RUN}"))
def match_stemmed_en(spark, sf):
    return fulltext.search(read(spark, sf, "documents"), "text", "attions AND NOT running", "english").select("doc_id", "lang")


@query()
def rank_stemmed(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return fulltext.best(fulltext.rank(docs, "doc_id", "text", "thble attions", "english"), "doc_id", 20).select("doc_id", "cosine_score")


# Vectors.

QUERY_VECTOR = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
L2 = f"round(list_distance(embedding::DOUBLE[], {QUERY_VECTOR}), 6)"
COSINE = f"round(1 - list_cosine_similarity(embedding::DOUBLE[], {QUERY_VECTOR}), 6)"


def first_vector(spark, sf) -> list[float]:
    row = read(spark, sf, "embeddings").filter("vec_id = 0").select("embedding").first()
    return [float(x) for x in row[0]]


@query(f"SELECT vec_id, {L2} AS dist_l2 FROM embeddings ORDER BY dist_l2, vec_id LIMIT 10")
def vec_l2_topk(spark, sf):
    return vectors.nearest(read(spark, sf, "embeddings"), "vec_id", "embedding", first_vector(spark, sf), 10).select("vec_id", "dist_l2")


@query(f"SELECT vec_id, {COSINE} AS dist_cosine FROM embeddings ORDER BY dist_cosine, vec_id LIMIT 10")
def vec_cosine_topk(spark, sf):
    return vectors.nearest(read(spark, sf, "embeddings"), "vec_id", "embedding", first_vector(spark, sf), 10, "cosine").select("vec_id", "dist_cosine")


@query(f"SELECT vec_id, {L2} AS dist_l2, {COSINE} AS dist_cosine FROM embeddings")
def vec_distances(spark, sf):
    q = first_vector(spark, sf)
    e = F.col("embedding")
    return read(spark, sf, "embeddings").select("vec_id", F.round(l2_distance(e, q), 6).alias("dist_l2"), F.round(cosine_distance(e, q), 6).alias("dist_cosine"))


@query(f"SELECT vec_id, label, {L2} AS dist_l2 FROM embeddings WHERE label = 1 ORDER BY dist_l2, vec_id LIMIT 10")
def vec_prefilter_l2(spark, sf):
    return vectors.hybrid(read(spark, sf, "embeddings"), "vec_id", "embedding", first_vector(spark, sf), 10, condition=F.col("label") == 1).select("vec_id", "label", "dist_l2")


@query(f"SELECT * FROM (SELECT vec_id, {L2} AS dist_l2 FROM embeddings ORDER BY dist_l2, vec_id LIMIT 10) ORDER BY dist_l2 DESC, vec_id")
def vec_reorder(spark, sf):
    order = [F.desc("dist_l2"), F.col("vec_id")]
    return vectors.nearest(read(spark, sf, "embeddings"), "vec_id", "embedding", first_vector(spark, sf), 10, order_by=order).select("vec_id", "dist_l2")


def ivf(spark, sf) -> vectors.IvfIndex:
    return vectors.IvfIndex(read(spark, sf, "embeddings"), new_folder(spark, "ivf"), "vec_id", "embedding")


@query()
def ivf_ann_topk(spark, sf):
    """The probes are those that the index fitted to find 0.9 of the nearest."""
    return ivf(spark, sf).search(first_vector(spark, sf), 10).select("vec_id", "dist_l2")


@query()
def ivf_post_filter(spark, sf):
    index = ivf(spark, sf)
    found = vectors.hybrid(read(spark, sf, "embeddings"), "vec_id", "embedding", first_vector(spark, sf), 20, condition=F.col("label") == 1, filter_first=False, index=index)
    return found.select("vec_id", "label", "dist_l2")


@query(f"SELECT vec_id, {L2} AS dist_l2 FROM embeddings ORDER BY dist_l2, vec_id LIMIT 10")
def ivf_full_probes(spark, sf):
    index = ivf(spark, sf)
    return index.search(first_vector(spark, sf), 10, probes=index.lists).select("vec_id", "dist_l2")


@query()
def ivf_recall_curve(spark, sf):
    """Share of the exact 10 nearest of every vector whose id is divisible by 100 that each number of probes finds; `fitted` marks the index's own."""
    index = ivf(spark, sf)
    return index.recall(F.col("vec_id") % 100 == 0, 10, (1, 2, 5, 10, 20, index.lists))


BAGS = """
    b AS (SELECT e.vec_id, arg_min(c.vec_id, list_distance(e.embedding::DOUBLE[], c.embedding::DOUBLE[])) AS w
          FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id < 16) c GROUP BY e.vec_id),
    documents AS (SELECT vec_id // 10 AS doc_id, string_agg('vw' || w, ' ') AS text FROM b GROUP BY 1)"""


@query(
    "WITH "
    + BAGS
    + ", x AS ("
    + ranking(("vw0", "vw1", "vw2"))
    + ") SELECT * FROM x ORDER BY cosine_score DESC, doc_id LIMIT 10"
)
def bovw_rank(spark, sf):
    """Items are ten vectors each; their nearest codewords are the item's text."""
    embeddings = read(spark, sf, "embeddings")
    book = embeddings.filter("vec_id < 16").orderBy("vec_id").select("embedding").collect()
    words = vectors.visual_words(embeddings, "embedding", np.array([r[0] for r in book], float))
    items = words.groupBy(F.floor(F.col("vec_id") / 10).alias("doc_id")).agg(F.array_join(F.collect_list("word"), " ").alias("text"))
    return recommend.by_words(items, "doc_id", "text", "vw0 vw1 vw2", 10).select("doc_id", "cosine_score")


EN_MIDDLE = "lang = 'en' AND n_chars BETWEEN 500 AND 5000"


@query(f"SELECT * FROM ({ranking(('thble', 'attion'), EN_MIDDLE)}) ORDER BY cosine_score DESC, doc_id LIMIT 10")
def recommend_text(spark, sf):
    chosen = recommend.filters(500, 5000, "en", price="n_chars", category_col="lang")
    return recommend.by_text(read(spark, sf, "documents"), "doc_id", "text", "thble attion", 10, chosen=chosen).select("doc_id", "cosine_score")


@query(f"SELECT vec_id, {COSINE} AS dist_cosine FROM embeddings WHERE label >= 2 AND label <= 6 ORDER BY dist_cosine, vec_id LIMIT 10")
def recommend_vector(spark, sf):
    chosen = recommend.filters(2, 6, price="label")
    return recommend.by_vector(read(spark, sf, "embeddings"), "vec_id", "embedding", first_vector(spark, sf), 10, chosen=chosen).select("vec_id", "dist_cosine")


# CSV ingestion, keys, changes.


def supplier_csv(spark, sf) -> csv_load.CsvTable:
    """supplier as CSV, with a bad cell in one row of ten and a repeated key, read back."""
    path = new_folder(spark, "supplier-csv")
    rows = read(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("Supplier Name"),
        F.when(F.col("s_suppkey") % 10 == 3, F.lit("n/a")).otherwise(F.round("s_acctbal", 2).cast("decimal(12,2)").cast("string")).alias("balance"),
        (F.col("s_nationkey") - 12.5).cast("string").alias("lat"),
        (F.col("s_nationkey") * 2.0).cast("string").alias("lng"),
    )
    rows.unionByName(rows.filter("id = 1")).write.csv(path, header=True)
    return csv_load.read_csv(spark, path)


SUPPLIER_SPECS = [
    csv_load.ColumnSpec("id", "INT", None, True),
    csv_load.ColumnSpec("supplier_name", "VARCHAR", 40),
    csv_load.ColumnSpec("balance", "FLOAT"),
    csv_load.ColumnSpec("location", "POINT"),
]


@query("SELECT * FROM (VALUES ('id', 'INT'), ('supplier_name', 'VARCHAR(30)'), ('balance', 'VARCHAR(20)'), ('lat', 'FLOAT'), ('lng', 'FLOAT')) t(\"column\", \"type\")")
def csv_infer_schema(spark, sf):
    specs = csv_load.infer_schema(supplier_csv(spark, sf))
    return spark.createDataFrame([(c.name, str(c)) for c in specs], "column string, type string")


@query("""
    WITH r AS (SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey % 10 = 3 THEN 'n/a' ELSE CAST(CAST(round(s_acctbal, 2) AS DECIMAL(12, 2)) AS VARCHAR) END AS b FROM supplier),
         u AS (SELECT * FROM r UNION ALL SELECT * FROM r WHERE s_suppkey = 1)
    SELECT 'id' AS "column", CAST(0 AS BIGINT) AS nulls, count(*) - count(DISTINCT s_suppkey) AS duplicates FROM u
    UNION ALL SELECT 'Supplier Name', 0, count(*) - count(DISTINCT s_name) FROM u
    UNION ALL SELECT 'balance', 0, count(*) - count(DISTINCT b) FROM u
    UNION ALL SELECT 'lat', 0, count(*) - count(DISTINCT s_nationkey) FROM u
    UNION ALL SELECT 'lng', 0, count(*) - count(DISTINCT s_nationkey) FROM u""")
def csv_column_stats(spark, sf):
    return csv_load.column_stats(supplier_csv(spark, sf)).drop("sample_values")


@query("SELECT s_suppkey AS id, s_name AS supplier_name, CAST(CAST(round(s_acctbal, 2) AS DECIMAL(12, 2)) AS DOUBLE) AS balance, s_nationkey - 12.5::DOUBLE AS x, s_nationkey * 2.0::DOUBLE AS y FROM supplier WHERE s_suppkey % 10 <> 3")
def csv_derive_point(spark, sf):
    table = supplier_csv(spark, sf)
    loaded = csv_load.load(table, SUPPLIER_SPECS, pair={"column": "location", "lat": "lat", "lng": "lng"})
    return loaded.accepted.select(F.col("id").cast("long").alias("id"), "supplier_name", "balance", "location.x", "location.y")


@query("SELECT CASE WHEN n = 1 THEN 'cell' ELSE 'key' END AS why, count(*) AS n FROM (SELECT 1 AS n FROM supplier WHERE s_suppkey % 10 = 3 UNION ALL SELECT 2 FROM supplier WHERE s_suppkey = 1) GROUP BY 1")
def csv_load_rejects(spark, sf):
    table = supplier_csv(spark, sf)
    rejected = csv_load.load(table, SUPPLIER_SPECS, pair={"column": "location", "lat": "lat", "lng": "lng"}).rejected
    return rejected.groupBy(F.when(F.col("reason").startswith("balance"), "cell").otherwise("key").alias("why")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, user_id, value FROM events")
def pk_dedup_first_wins(spark, sf):
    events = read(spark, sf, "events").select("event_id", "user_id", "value")
    twice = events.withColumn("line", F.lit(1)).unionByName(events.withColumns({"line": F.lit(2), "value": F.col("value") + 1}))
    return tables.first_by_key(twice, "event_id", "line").drop("line")


@query("SELECT CAST(row_number() OVER (ORDER BY ts, event_id) AS INTEGER) AS id, event_id FROM events")
def serial_pk(spark, sf):
    return tables.with_serial(read(spark, sf, "events").select("ts", "event_id"), "ts", "event_id").select("id", "event_id")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 99, 'ATLANTIS', 3")
def insert_row(spark, sf):
    nation = tables.Table(spark, new_folder(spark, "nation"), "n_nationkey").create(read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    return nation.insert((99, "ATLANTIS", 3)).rows()


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 1")
def delete_eq(spark, sf):
    nation = tables.Table(spark, new_folder(spark, "nation"), "n_nationkey").create(read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    return nation.delete("n_regionkey", 1).rows()


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def reorganize_sorted(spark, sf):
    orders = tables.Table(spark, new_folder(spark, "orders"), "o_orderkey").create(read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"))
    orders.reorganise()
    return orders.rows()

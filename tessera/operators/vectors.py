"""Exact and approximate nearest vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import METRICS, parse_vector
from ..sources.scratch import publish
from .relational import top

MAX_LISTS = 4_096
"""Bound of the default number of cells, whose centres the driver holds."""
FIT_ROWS, FIT_QUERIES, MARGIN = 10_000, 200, 0.03
"""Bounds of the sample that the number of probes is fitted on, and what is added to the recall asked for."""
QUERY_BLOCK = 1_000
NAMES = {"l2": "dist_l2", "cosine": "dist_cosine"}


def measured(df: DataFrame, column: str, query: str | Sequence[float], metric: str = "l2", name: str | None = None) -> DataFrame:
    """df with the distance to the query, rounded to 6 places, as its last column."""
    return df.withColumn(name or NAMES[metric], F.round(METRICS[metric](F.col(column), parse_vector(query)), 6))


def nearest(df: DataFrame, key: str, column: str, query, k: int, metric: str = "l2", order_by: list[Column] | None = None, offset: int = 0) -> DataFrame:
    """The k nearest rows, ties by key. Filter df first to search among some rows only."""
    found = measured(df.filter(F.col(column).isNotNull()), column, query, metric)
    return top(found, [F.col(NAMES[metric]), F.col(key)], k, offset, order_by)


class IvfIndex:
    """Vectors stored by k-means cell; a search reads the `probes` cells nearest to the query.

    Cells, and the probes that find the share `recall` of the nearest, are fitted on bounded samples; every row is
    stored.
    """

    def __init__(self, df: DataFrame, path: str, key: str, column: str, metric: str = "l2", lists: int | None = None, seed: int = 42, sample: int = 100_000, recall: float = 0.9):
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric!r}")
        self.path, self.key, self.column, self.metric, self.spark = path, key, column, metric, df.sparkSession
        rows = df.count()
        if not rows:
            raise ValueError("an index needs rows")
        self.lists = min(rows, lists or max(1, min(MAX_LISTS, math.isqrt(rows))))
        vectors = df.withColumn("_v", array_to_vector(self.unit(F.col(column).cast("array<double>"))))
        # Cells are learned from a bounded sample; every row is assigned and stored.
        drawn = vectors.select("_v").sample(min(1.0, sample / rows), seed) if rows > sample else vectors.select("_v")
        model = KMeans(k=self.lists, seed=seed, maxIter=25, featuresCol="_v", predictionCol="cell").fit(drawn)
        self.centres = np.array(model.clusterCenters())
        self.assign = lambda rows: model.transform(rows.withColumn("_v", array_to_vector(self.unit(F.col(column).cast("array<double>"))))).drop("_v")
        self.write(model.transform(vectors).drop("_v"), "overwrite")
        self.probes = self.fitted_probes(recall)

    def fitted_probes(self, recall: float, neighbours: int = 10) -> int:
        """The fewest cells that hold `recall` of the nearest of FIT_QUERIES sampled vectors among the other FIT_ROWS sampled ones.

        The whole table's nearest are nearer than a sample's, so they stand in nearer cells.
        """
        stored = self.spark.read.parquet(self.path)
        share = min(1.0, 1.2 * FIT_ROWS / max(1, stored.count()))
        drawn = stored.sample(share, 7).select(self.unit(F.col(self.column).cast("array<double>")).alias("v"), "cell").limit(FIT_ROWS).collect()
        rows, cells = np.array([r["v"] for r in drawn]), np.array([r["cell"] for r in drawn])
        if len(rows) < 2:
            return self.lists
        ranks = []
        for i in range(min(FIT_QUERIES, len(rows))):
            gaps = ((rows - rows[i]) ** 2).sum(axis=1)
            gaps[i] = np.inf
            near = np.argsort(gaps, kind="stable")[: min(neighbours, len(rows) - 1)]
            ranks += self.cell_ranks(rows[i])[cells[near]].tolist()
        return int(np.quantile(ranks, min(1.0, recall + MARGIN), method="higher")) + 1

    def cell_ranks(self, q: np.ndarray) -> np.ndarray:
        """The place of every cell in the order in which a query reads them, from 0."""
        order = np.argsort(((self.centres - q) ** 2).sum(axis=1), kind="stable")
        ranks = np.empty(len(order), np.int64)
        ranks[order] = np.arange(len(order))
        return ranks

    def recall(self, is_query: Column, k: int, probes: Sequence[int]) -> DataFrame:
        """(probes, recall, fitted): the share of the exact k nearest, over all stored rows, of the rows that meet is_query in so many cells.

        Queries go to the tasks in blocks of QUERY_BLOCK; a task keeps k rows a query, whose cells' ranks tell how
        many probes find them. Of the queries' nearest only k rows of each task are shuffled.
        """
        stored = self.spark.read.parquet(self.path)
        vector = self.unit(F.col(self.column).cast("array<double>")).alias("v")
        asked = publish(stored.filter(is_query).select(F.col(self.key).alias("q"), vector), "ivf-queries")
        blocks, found = max(1, -(-asked.count() // QUERY_BLOCK)), None
        for block in range(blocks):
            part = asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).collect()
            if part:
                near = self.nearest_of(stored.select(F.col(self.key).alias("key"), "cell", vector), part, k)
                found = near if found is None else found.unionByName(near)
        counts = sorted({*(p for p in probes if p <= self.lists), self.probes})
        if found is None:
            found = self.spark.createDataFrame([], "q long, rank long")
        shares = found.agg(*[F.avg((F.col("rank") < p).cast("double")).alias(str(p)) for p in counts])
        unpivoted = shares.select(F.explode(F.array(*[F.struct(F.lit(p).alias("probes"), F.col(str(p)).alias("recall"), F.lit(p == self.probes).alias("fitted")) for p in counts])).alias("row"))
        return unpivoted.select("row.*")

    def nearest_of(self, rows: DataFrame, queries: list, k: int) -> DataFrame:
        """(q, rank): the exact k nearest of a block of queries, each by its cell's rank."""
        ids = np.array([r["q"] for r in queries], np.int64)
        points = np.array([r["v"] for r in queries])
        shared = self.spark.sparkContext.broadcast((ids, points, np.stack([self.cell_ranks(p) for p in points])))  # a block of queries

        def scan(frames):
            ids, points, ranks = shared.value
            best = [np.empty((0, 3))] * len(ids)
            for frame in frames:
                x, keys, cells = np.stack([np.asarray(v, float) for v in frame["v"]]), frame["key"].to_numpy(np.int64), frame["cell"].to_numpy(np.int64)
                for i, point in enumerate(points):
                    gaps = ((x - point) ** 2).sum(axis=1)
                    gaps[keys == ids[i]] = np.inf
                    near = np.argsort(gaps, kind="stable")[:k]
                    merged = np.concatenate([best[i], np.column_stack([gaps[near], keys[near], ranks[i][cells[near]]])])
                    best[i] = merged[np.lexsort((merged[:, 1], merged[:, 0]))[:k]]
            out = [(q, *row) for q, rows in zip(ids, best) for row in rows if np.isfinite(row[0])]
            yield pd.DataFrame(out, columns=["q", "gap", "key", "rank"]).astype({"q": "int64", "key": "int64", "rank": "int64"})

        local = rows.mapInPandas(scan, "q long, gap double, key long, rank long")
        top_k = F.slice(F.array_sort(F.collect_list(F.struct("gap", "key", "rank"))), 1, k)
        return local.groupBy("q").agg(top_k.alias("hits")).select("q", F.explode("hits").alias("hit")).select("q", F.col("hit.rank").alias("rank"))

    def unit(self, vector: Column) -> Column:
        if self.metric != "cosine":
            return vector
        size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
        return F.transform(vector, lambda x: F.when(size == 0, x).otherwise(x / size))

    def write(self, rows: DataFrame, mode: str) -> None:
        # Salted by key: a cell with a third of the rows is written by many tasks.
        rows.repartition(F.col("cell"), F.pmod(F.xxhash64(self.key), F.lit(8))).write.mode(mode).partitionBy("cell").parquet(self.path)

    def add(self, rows: DataFrame) -> None:
        """New rows go to the cells that exist."""
        self.write(self.assign(rows), "append")

    def candidates(self, query, probes: int) -> DataFrame:
        """Rows of the nearest cells; as a partition filter, so other cells are not read."""
        q = np.array(parse_vector(query))
        if self.metric == "cosine" and (size := np.linalg.norm(q)):
            q = q / size
        if probes < 1:
            raise ValueError("at least one cell is read")
        cells = np.argsort(self.cell_ranks(q), kind="stable")[: min(probes, self.lists)]
        return self.spark.read.parquet(self.path).filter(F.col("cell").isin(cells.tolist())).drop("cell")

    def search(self, query, k: int, probes: int | None = None, metric: str | None = None) -> DataFrame:
        if (metric or self.metric) != self.metric:
            raise ValueError(f"the index measures {self.metric}")
        return nearest(self.candidates(query, self.probes if probes is None else probes), self.key, self.column, query, k, self.metric)


def hybrid(df: DataFrame, key: str, column: str, query, k: int, metric: str = "l2", condition: Column | None = None, filter_first: bool = True, index: IvfIndex | None = None, probes: int | None = None) -> DataFrame:
    """Nearest rows that meet a condition, by one of three ways.

    With filter_first, exact among the rows that meet it. With an index and no filter_first, the index's k
    candidates, then the condition, so fewer than k may stay. With neither, an exact scan.
    """
    if index is not None and index.metric != metric:
        raise ValueError(f"the index measures {index.metric}")
    if index is not None and not (filter_first and condition is not None):
        found = index.search(query, k, probes)
        return found if condition is None else found.filter(condition)
    return nearest(df if condition is None else df.filter(condition), key, column, query, k, metric)


def visual_words(df: DataFrame, column: str, centres: np.ndarray) -> DataFrame:
    """df with `word`: v<i> of the codeword nearest to each vector (ties to the first), for ranking as text."""
    book = df.sparkSession.sparkContext.broadcast(np.asarray(centres, float))  # a codebook of fixed size

    @F.pandas_udf("string")
    def word(vectors: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(v, float) for v in vectors])
        gaps = (x * x).sum(1)[:, None] - 2 * x @ book.value.T + (book.value**2).sum(1)
        return pd.Series([f"vw{i}" for i in gaps.argmin(axis=1)])

    return df.withColumn("word", word(column))

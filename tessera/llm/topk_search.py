"""Exact top-k inner products by pivot-table elimination."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_sample, publish, ship

PIVOTS = 32
SAMPLE = 2_000
"""Bound of the sample that pivots and the first floors come from; every row is searched whatever it holds."""
ROWS_AT_ONCE, ROWS_PER_CELL = 4_096, 256
BLOCK_MB = 16
"""Queries are sent to all tasks in blocks of so many MB at most."""
STEP = 256
MOST = 2**63 - 1


def usable(vector: Column) -> Column:
    """The vector is not null and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~bad


def matrix(cells: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(cells), kind).reshape(len(cells), len(cells.iat[0]) // np.dtype(kind).itemsize)


def farthest_first(rows: np.ndarray, count: int) -> np.ndarray:
    """Pivots far from one another: each the row farthest from those before."""
    chosen, gap = [0], np.full(len(rows), np.inf)
    while len(chosen) < min(count, len(rows)):
        gap = np.minimum(gap, np.linalg.norm(rows - rows[chosen[-1]], axis=1))
        if gap.max() <= 0:
            break
        chosen.append(int(gap.argmax()))
    return rows[chosen]


def inner(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer inner products; the components are integers held as doubles. Beyond a long, the nearest long."""
    most = float(np.abs(rows).max()) * float(np.abs(query).max()) * rows.shape[1] if rows.size else 0.0
    if most < 2**53:
        return (rows @ query).astype(np.int64)
    if most < 2**62:
        return rows.astype(np.int64) @ query.astype(np.int64)
    q = [int(x) for x in query]
    return np.array([max(-MOST, min(MOST, sum(int(x) * y for x, y in zip(row, q)))) for row in rows], np.int64)


def reach(gap: np.ndarray, query_norm: np.ndarray | float, norms: np.ndarray | float) -> np.ndarray:
    """An upper bound of q.x = (|q|^2 + |x|^2 - |q-x|^2) / 2 from a lower bound of |q-x|, with room for rounding."""
    with np.errstate(over="ignore", invalid="ignore"):
        total = query_norm + norms
        bound = (total - np.maximum(0, gap * (1 - 1e-9)) ** 2) / 2 + 1e-9 * total + 1e-6
    return np.where(np.isfinite(bound), bound, np.inf)


class Cells:
    """Rows of one dimension, ordered by their nearest pivot and cut to cells: each has the range of its distances to every pivot."""

    def __init__(self, row_ids: np.ndarray, ids: np.ndarray, values: np.ndarray, far: np.ndarray):
        order = np.lexsort((far.min(axis=1), far.argmin(axis=1)))
        self.row_ids, self.ids, self.values, self.far = row_ids[order], ids[order], values[order], far[order]
        with np.errstate(over="ignore"):
            self.norms = np.einsum("ij,ij->i", self.values, self.values)
        self.starts = np.arange(0, len(ids), ROWS_PER_CELL)
        self.low, self.high = (f.reduceat(self.far, self.starts, axis=0) for f in (np.minimum, np.maximum))
        self.most = np.maximum.reduceat(self.norms, self.starts)

    def bounds(self, query_far: np.ndarray, query_norms: np.ndarray) -> np.ndarray:
        """(query, cell): what no inner product of the query with a row of the cell exceeds."""
        with np.errstate(invalid="ignore"):  # distances to huge vectors are infinite
            gap = np.maximum(self.low[None] - query_far[:, None], query_far[:, None] - self.high[None]).max(axis=2)
        return reach(gap, query_norms[:, None], self.most[None])

    def best(self, row_id: int, query: np.ndarray, query_far: np.ndarray, norm: float, cells: np.ndarray, k: int, floor: float, ids: np.ndarray, scores: np.ndarray):
        """The k best of (ids, scores) and of the cells' rows for one query, and how many rows were evaluated.

        |q-x| is at least the greatest difference of their distances to a pivot. Rows are evaluated from the highest
        bound on until the next one is below the k-th score, or below the floor that k rows elsewhere reach. Equal
        bounds are evaluated too, for ties.
        """
        rows = np.concatenate([np.arange(s, min(s + ROWS_PER_CELL, len(self.ids))) for s in self.starts[cells]])
        with np.errstate(invalid="ignore"):
            gap = np.abs(self.far[rows] - query_far).max(axis=1)
        bounds = reach(gap, norm, self.norms[rows])
        held = (bounds >= floor) & (self.row_ids[rows] != row_id)
        rows, bounds = rows[held], bounds[held]
        order = np.argsort(-bounds, kind="stable")
        done = 0
        while done < len(order) and (len(scores) < k or bounds[order[done]] >= scores[-1]):
            part = rows[order[done : done + STEP]]
            done += len(part)
            ids, scores = np.concatenate([ids, self.ids[part]]), np.concatenate([scores, inner(self.values[part], query)])
            top = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[top], scores[top]
        return ids, scores, done


class Queries:
    """A block of queries of one dimension, with the best that a task has found for each so far."""

    def __init__(self, part: pd.DataFrame):
        self.row_ids, self.ids, self.floors = part["row_id"].to_numpy(np.int64), part["vec_id"].to_numpy(np.int64), part["floor"].to_numpy(float)
        self.values, self.far = matrix(part["x"], "<f8"), matrix(part["far"], "<f8")
        with np.errstate(over="ignore"):
            self.norms = np.einsum("ij,ij->i", self.values, self.values)

    def look(self, cells: Cells, found: dict[int, tuple], k: int) -> None:
        """Compare the queries with the cells that can hold one of their k best."""
        at_once = max(1, 2_000_000 // max(1, cells.low.size))
        for start in range(0, len(self.ids), at_once):
            bounds = cells.bounds(self.far[start : start + at_once], self.norms[start : start + at_once])
            for i, row in enumerate(bounds, start):
                ids, scores, done = found.get(i, (np.empty(0, np.int64), np.empty(0, np.int64), 0))
                least = max(self.floors[i], float(scores[-1]) if len(scores) == k else -np.inf)
                if len(open_cells := np.flatnonzero(row >= least)):
                    ids, scores, more = cells.best(self.row_ids[i], self.values[i], self.far[i], self.norms[i], open_cells, k, least, ids, scores)
                    found[i] = (ids, scores, done + more)


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, pivots: int = PIVOTS, sample: int = SAMPLE) -> DataFrame:
    """Exact top k of every query row among all other rows of vectors (vec_id, embedding): query_id, rank, vec_id, score, evaluated.

    Components become floor(scale * x); the score is the integer inner product, ties go to the smaller vec_id. One
    pass stores each row's distances to the pivots. Then the rows stay where they are: queries go to all tasks in
    blocks of bounded size, a task cuts its rows to cells of like distances, skips the cells and then the rows whose
    bound is below a query's k-th score, and hands on the k best for each query. A floor for each query, its k-th
    score in a bounded sample, spares work but decides nothing. `evaluated` counts the rows whose score was computed.

    Rows whose vector is null or holds null or non-finite components take no part, nor do rows of null vec_id;
    vectors are compared with those of their own dimension. Only the query's own row is no candidate for it: rows
    that repeat its id, or all of it, are, and are queries of their own. Scores beyond a long count as the nearest
    long. Very long vectors make the blocks of queries smaller. Other columns are ignored; empty tables give no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("is_query")).filter(
        F.col("vec_id").isNotNull() & usable(F.col("embedding"))
    )
    drawn = pd.DataFrame([(r["vec_id"], r["embedding"]) for r in bounded_sample(rows.select("vec_id", "embedding"), sample, "vec_id")], columns=["vec_id", "embedding"])

    def scaled(cells) -> np.ndarray:
        return np.floor(np.stack([np.asarray(c, float) for c in cells]) * scale)

    known: dict[int, tuple] = {}
    for size, part in drawn.groupby(drawn["embedding"].map(len)):
        values = scaled(part["embedding"])
        known[size] = (farthest_first(values, pivots), part["vec_id"].to_numpy(np.int64), values)
    shared = spark.sparkContext.broadcast(known)  # at most `sample` vectors

    def tabulate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for size, part in frame.groupby(frame["embedding"].map(len)):
                values = scaled(part["embedding"])
                points, seen_ids, seen = shared.value.get(size, (np.zeros((1, size)), np.empty(0, np.int64), np.empty((0, size))))
                far = np.stack([np.linalg.norm(values - p, axis=1) for p in points], axis=1)
                floors = np.full(len(part), -np.inf)
                for i in np.flatnonzero(part["is_query"].to_numpy(bool)):
                    others = inner(seen[seen_ids != part["vec_id"].iat[i]], values[i])
                    if len(others) >= k:
                        floors[i] = np.partition(others, len(others) - k)[len(others) - k]
                yield pd.DataFrame({"row_id": part["row_id"], "vec_id": part["vec_id"], "is_query": part["is_query"], "size": size, "floor": floors, "x": [v.tobytes() for v in values], "far": [v.tobytes() for v in far]})

    numbered = rows.withColumn("row_id", F.monotonically_increasing_id())  # written once, so they stay
    prepared = publish(numbered.mapInPandas(tabulate, "row_id long, vec_id long, is_query boolean, size int, floor double, x binary, far binary"), "pivot-table")
    asked = prepared.filter("is_query")
    number, widest = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.length("x") + F.length("far")), F.lit(0))).first()
    blocks = max(1, -(-number * (widest + 24) // int(BLOCK_MB * (1 << 20))))
    found = None
    for block in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("row_id"), F.lit(blocks)) == block).toPandas()
        best = best_of(prepared, part, k)
        best = publish(best, "block-best") if blocks > 1 else best
        found = best if found is None else found.unionByName(best)
    return found.select("query_id", "evaluated", F.posexplode("best").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.low")).alias("score"), "evaluated"
    )


def best_of(prepared: DataFrame, part: pd.DataFrame, k: int) -> DataFrame:
    """(query_id, best, evaluated) of a block of queries, over all prepared rows; each task sends k rows a query at most."""
    known = {size: Queries(rows) for size, rows in part.groupby("size")}
    shared = prepared.sparkSession.sparkContext.broadcast(known)  # at most BLOCK_MB

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries, held = shared.value, {}
        found: dict[int, dict[int, tuple]] = {size: {} for size in queries}

        def look(size: int) -> None:
            rows = pd.concat(held.pop(size))
            cells = Cells(rows["row_id"].to_numpy(np.int64), rows["vec_id"].to_numpy(np.int64), matrix(rows["x"], "<f8"), matrix(rows["far"], "<f8"))
            queries[size].look(cells, found[size], k)

        for frame in frames:
            for size, rows in frame.groupby("size"):
                if size in queries:
                    held.setdefault(size, []).append(rows)
                    if sum(map(len, held[size])) >= ROWS_AT_ONCE:
                        look(size)
        for size in list(held):
            look(size)
        for size, own in queries.items():
            out = [
                (own.row_ids[i], own.ids[i], v, s, done if n == 0 else 0)
                for i, (ids, scores, done) in found[size].items()
                for n, (v, s) in enumerate(zip(ids.tolist(), scores.tolist()))
            ]
            yield pd.DataFrame(out, columns=["row_id", "query_id", "vec_id", "score", "evaluated"])

    local = prepared.select("row_id", "vec_id", "size", "x", "far").mapInPandas(scan, "row_id long, query_id long, vec_id long, score long, evaluated long")
    hits = F.collect_list(F.struct((-F.col("score")).alias("low"), "vec_id"))
    return local.groupBy("row_id", "query_id").agg(F.slice(F.sort_array(hits), 1, k).alias("best"), F.sum("evaluated").alias("evaluated")).drop("row_id")

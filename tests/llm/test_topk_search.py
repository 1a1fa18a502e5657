import math
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm.topk_search import farthest_first, search


MOST = 2**63 - 1


def brute(rows, k):
    usable = [(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ints = [(n, i, tuple(math.floor(256 * x) for x in v)) for n, (i, v) in enumerate(usable)]
    out = []
    for n, q, a in ints:
        if q % 50 == 0:
            scores = sorted((-max(-MOST, min(MOST, sum(x * y for x, y in zip(a, b)))), i) for m, i, b in ints if m != n and len(b) == len(a))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def vectors(n, dim, seed):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, 0.3) for _ in range(dim)]) for i in range(n)]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, rank string")
    return sorted(tuple(r)[:4] for r in search(df, F.col("vec_id") % 50 == 0, **kw).collect())


def test_matches_brute_force(spark):
    rows = vectors(700, 8, 1)
    assert run(spark, rows, sample=50) == brute(rows, 5)


def test_ties_nulls_and_odd_vectors(spark):
    same = [0.5, -0.25, 0.125]
    rows = [(i, same) for i in range(120)] + [(200, None), (250, [float("nan"), 1.0, 1.0]), (300, [float("inf"), 1.0, 1.0]), (350, [None, 1.0, 1.0])]
    rows += [(None, same), (0, same), (400, [1.0, 2.0]), (401, [3.0, 4.0]), (450, []), (500, [1e12, -1e12, 0.0])]
    got = run(spark, rows)
    assert got == brute(rows, 5)
    assert [r[2] for r in got if r[0] == 50][1:] == [0, 0, 1, 2]


def test_large_components_are_exact(spark):
    rows = [(0, [300_000.0, 1.0]), (1, [300_000.0, 0.0]), (2, [400_000.0, 0.0]), (3, [-5e8, 2e8]), (4, [1e12, -1e12]), (50, [1e13, 3.0]), (100, [1e200, 1e300])]
    got = run(spark, rows)
    assert got == brute(rows, 5)
    assert [r[2:] for r in got if r[0] == 0 and r[2] in (1, 2)] == [(2, 300_000 * 400_000 * 65_536), (1, 300_000 * 300_000 * 65_536)]


def test_blocks_of_queries_and_elimination(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(9 * (i % 7), 0.1), rng.gauss(-9 * (i % 5), 0.1), rng.gauss(0, 0.1)]) for i in range(3_000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = [tuple(r) for r in search(df, F.col("vec_id") % 50 == 0, sample=300).collect()]
    assert sum({r[0]: r[4] for r in whole}.values()) < 0.5 * 60 * 3_000
    monkeypatch.setattr("tessera.llm.topk_search.BLOCK_MB", 0.01)
    monkeypatch.setattr("tessera.llm.topk_search.ROWS_PER_CELL", 16)
    parted = [tuple(r) for r in search(df, F.col("vec_id") % 50 == 0, sample=300).collect()]
    want = brute([tuple(r) for r in df.collect()], 5)
    assert sorted(r[:4] for r in whole) == sorted(r[:4] for r in parted) == want


def test_fewer_rows_than_k_and_none(spark):
    assert run(spark, vectors(3, 4, 2)) == brute(vectors(3, 4, 2), 5)
    assert run(spark, []) == []


def test_pivots_are_far_apart():
    points = np.array([[0.0, 0], [1, 0], [10, 0], [10, 1], [0, 10]])
    assert farthest_first(points, 3).tolist() == [[0, 0], [10, 1], [0, 10]]
    assert len(farthest_first(np.zeros((4, 2)), 3)) == 1

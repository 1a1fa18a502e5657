import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import packing


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, used = packing.best_fit(np.array([700, 600, 400, 300]), 1000)
    assert bins.tolist() == [0, 1, 1, 0] and offsets.tolist() == [0, 0, 600, 700] and used.tolist() == [1000, 1000]


def test_pieces():
    assert packing.pieces(10, 10) == [(0, 10)]
    assert packing.pieces(25, 10) == [(0, 5), (5, 10), (15, 10)]
    assert packing.pieces(20, 10) == [(0, 10), (10, 10)]


def check(rows, got, capacity):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, total = Counter(), 0
    for doc, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        cut = [0] if len(ids) <= capacity else [*([0] if len(ids) % capacity else []), *range(len(ids) % capacity, len(ids), capacity)]
        for n, (a, b) in enumerate(zip(cut, [*cut[1:], len(ids)])):
            want[(doc, n, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append(r)
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity and all(p["used"] == at for p in pieces)
    return len(sequences), -(-total // capacity)


def test_rounds_place_every_piece(spark):
    rng = random.Random(0)
    rows = [(i, " ".join("word" for _ in range(rng.randrange(0, 120)))) for i in range(600)]
    rows += [(1000, None), (1001, ""), (1002, "long " * 3000), (1003, "a<|endoftext|>b"), (None, "no id"), (5, "again")]
    df = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, length int")
    got = packing.pack_documents(df, capacity=100, items_per_task=40, fan_in=3, slack=2).collect()
    used, least = check(rows, got, 100)
    assert used <= least * 1.05 + 1
    again = packing.pack_documents(df, capacity=100, items_per_task=40, fan_in=3, slack=2).collect()
    key = lambda r: (str(r["doc_id"]), r["piece"], r["length"], r["ids_crc32"], r["offset"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_special_token_is_read_as_the_library_reads_it():
    ids = packing.encoder(packing.tokenizer_file())("a<|endoftext|>b")
    assert ids == Tokenizer.from_file(packing.tokenizer_file()).encode("a<|endoftext|>b", add_special_tokens=False).ids and 50256 in ids


def packed_sizes(spark, sizes, **kw):
    df = spark.createDataFrame(pd.DataFrame({"doc_id": range(len(sizes)), "piece": 0, "start": 0, "length": sizes, "ids_crc32": 0}))
    got = packing.pack_pieces(df.select(*(F.col(c).cast("long") for c in df.columns)), **kw).toPandas()
    by = got.groupby("sequence_id")["length"].sum()
    assert len(got) == len(sizes) and by.max() <= kw.get("capacity", 1024)
    return len(by)


def test_bins_that_nothing_fits_are_closed(spark):
    assert packed_sizes(spark, [60] * 300, capacity=100, items_per_task=50, fan_in=2) == 300


def test_half_full_bins_waste_little(spark):
    sizes = np.random.default_rng(1).integers(400, 625, 100_000)
    assert packed_sizes(spark, sizes, items_per_task=8_000, fan_in=4) <= 1.01 * sizes.sum() / 1024


def test_handing_on_some_bins_of_each_fill_loses_nothing(spark):
    """One task over all bins of its children, against one over those that they hand on."""
    rng = np.random.default_rng(2)
    for capacity, low in ((64, 1), (64, 20), (200, 60)):
        sizes = rng.integers(low, capacity, 4_000)
        got = packed_sizes(spark, sizes, capacity=capacity, items_per_task=500, fan_in=8, slack=0)
        tasks = [np.sort(part)[::-1] for part in np.array_split(sizes, 8)]
        bins = np.concatenate([packing.best_fit(part, capacity)[2] for part in tasks])
        whole = len(packing.best_fit(np.sort(bins)[::-1], capacity)[2])
        assert abs(got - whole) <= 0.01 * whole + 2


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0

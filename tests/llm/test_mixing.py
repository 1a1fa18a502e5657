import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm.mixing import mix, repeat_documents, source_targets


def filled(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    share, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        left = share - sum(target.values())
        over = {n for n in free if left * weight[n] / sum(weight[m] for m in free) > 2 * sizes[n] + 1e-9}
        if not over:
            return target | {n: left * weight[n] / sum(weight[m] for m in free) for n in free}
        target |= {n: 2.0 * sizes[n] for n in over}
        free -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 100, "b": 1, "c": 50, "d": 7, None: 30}, {"x": 0, "y": 5}, {"a": 0}, {"é": 9, "z": 9, "Z": 900, "": 3}])
def test_targets_are_filled_by_weight(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    assert got == pytest.approx(filled(sizes))


def rows_of(spark):
    rows = [(i, "w " * (i % 17) + ("\t x" if i % 5 else ""), ["a", "b", "c", None, "d"][min(4, i % 7)]) for i in range(400)]
    rows += [(None, "no id", "a"), (7, None, "b"), (8, "", "b"), (9, "twice", "c"), (9, "twice", "c")]
    return rows, spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, taken int, target double")


def test_taken_words_meet_the_targets(spark):
    rows, df = rows_of(spark)
    got = mix(df).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _ in rows)
    by = defaultdict(list)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]].append(r)
    targets = filled({s: sum(r["size"] for r in rs) for s, rs in by.items()})
    for s, rs in by.items():
        assert rs[0]["target"] == pytest.approx(targets[s]) and abs(sum(r["taken"] for r in rs) - targets[s]) <= 1
        assert rs[0]["source_size"] == sum(r["size"] for r in rs)
    assert sorted(map(str, got)) == sorted(map(str, mix(df.repartition(5)).collect()))


def test_heavier_documents_are_taken_first(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w w w").alias("text"), F.when(F.col("id") < 3000, "a").otherwise("b").alias("source"))
    got = mix(df, F.when(F.col("doc_id") % 2 == 0, 8.0).otherwise(1.0)).filter("taken % size != 0 or taken > 0").collect()
    part = [r for r in got if r["target"] % r["source_size"]]
    more = [r for r in part if r["taken"] > r["epochs"] * r["size"]]
    assert sum(r["doc_id"] % 2 == 0 for r in more) > 0.6 * len(more)


def test_whole_documents_are_repeated(spark):
    rows, df = rows_of(spark)
    taken = {}
    for r in mix(df, cut_last=False).collect():
        taken[(r["doc_id"], r["size"], r["source"])] = r["taken"]
        assert r["size"] == 0 or r["taken"] % r["size"] == 0
    out = repeat_documents(df)
    assert out.columns == df.columns
    count = defaultdict(int)
    for r in out.collect():
        count[(r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")), r["source"])] += 1
    for key, words in taken.items():
        if key[1] and key[0] != 9:
            assert count[key] == words // key[1]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(df).count() == 0 and repeat_documents(df).count() == 0

import hashlib
from collections import defaultdict

from tessera.llm.exact_dedup import drop_exact_copies, exact_dedup

LONG = "word " * 30_000
ROWS = [
    (1, "a"), (2, "a"), (3, "b"), (4, ""), (5, None), (6, "same length!"), (7, "same length?"), (8, LONG), (9, LONG), (10, LONG + "."),
    (11, "x" * 300 + "1"), (12, "x" * 300 + "2"), (13, "x" * 300 + "1"), (14, "A"), (None, "null id"), (15, "null id"), (16, "one"), (16, "one"), (17, "é"), (18, "é"),
]


def frame(spark, rows):
    data = [(i, t, "src", True, 9) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, keep_id string, kept boolean, size int")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        seen = False
        for i in ids:
            first = i == keep and not seen
            seen = seen or first
            out.append((i, keep, len(ids), first, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_matches_brute_force(spark):
    got = exact_dedup(frame(spark, ROWS), digest_all=True)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(ROWS)


def test_only_survivors_are_hashed(spark):
    got = {r["doc_id"]: r["text_sha256"] for r in exact_dedup(frame(spark, ROWS)).collect()}
    assert got[3] is None and got[10] is None and got[1] is not None
    assert got[12] is not None  # same length and prefix as others


def test_empty_table(spark):
    assert exact_dedup(frame(spark, [])).count() == 0
    assert drop_exact_copies(frame(spark, [])).count() == 0


def test_hot_group(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    got = exact_dedup(frame(spark, rows)).filter("group_size > 1").collect()
    assert len(got) == 1000 and {r["keep_id"] for r in got} == {2997} and sum(r["kept"] for r in got) == 1


def test_drop_keeps_other_columns(spark):
    df = frame(spark, ROWS)
    got = drop_exact_copies(df)
    assert got.columns == df.columns
    kept = {(i, digest) for i, _, _, stays, digest in brute(ROWS) if stays}
    pairs = [(r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in got.collect()]
    assert len(pairs) == len(kept) and set(pairs) == kept

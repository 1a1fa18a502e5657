import random
import time

import numpy as np
import pytest

from tessera.llm import near_dedup as nd


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_alignment_matches_dynamic_programme():
    rng = np.random.default_rng(0)
    for _ in range(400):
        a = rng.integers(0, 6, rng.integers(1, 50))
        b = np.array([x for x in a if rng.random() > 0.15] + rng.integers(0, 6, rng.integers(0, 4)).tolist())
        if not len(b):
            continue
        m = lcs(a.tolist(), b.tolist())
        want, got = m / (len(a) + len(b) - m), nd.similarity(a, b, 0.6)
        assert got == pytest.approx(want) or (want < 0.6 and got < 0.6)


def test_repeats_are_labelled_by_occurrence():
    h = np.array([5, 7, 5, 5, 7], np.uint64)
    assert len(set(nd.labelled(h).tolist())) == 5
    assert nd.labelled(h)[0] == nd.labelled(h[:1])[0]


def test_sketch_sees_order():
    words = nd.WordHashes()
    a, b = "one two three four five six seven eight nine ten", "six seven eight nine ten one two three four five"
    x, y = (nd.sketch(nd.shingles(words(t), 1), 8, 3) for t in (a, b))
    assert x != y and x == nd.sketch(nd.shingles(words(a), 1), 8, 3)


def documents(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(60, 300))]
        rows.append(" ".join(base))
        for _ in range(rng.randrange(0, 4)):
            copy = list(base)
            for _ in range(rng.randrange(1, max(2, len(base) // 40))):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    passage = " ".join(word() for _ in range(60))
    rows += [passage + " " + " ".join(word() for _ in range(50)) for _ in range(10)]
    rows += ["", None, "   ", "only four words here", "Only four words here!", "three words here"]
    return list(enumerate(rows, 1)) + [(3, rows[2]), (None, "a text without an id that is long enough to have shingles")]


def brute(rows):
    words, root = nd.WordHashes(), list(range(len(rows)))
    found = lambda i: i if root[i] == i else found(root[i])
    arrays = [words(t or "") for _, t in rows]
    grams = [nd.shingles(a, nd.SHINGLE) for a in arrays]
    for i in range(len(rows)):
        for j in range(i):
            if np.array_equal(arrays[i], arrays[j]) or nd.similarity(grams[i], grams[j], 0.8) >= 0.8:
                root[found(i)] = found(j)
    classes = {}
    for i, (doc, _) in enumerate(rows):
        classes.setdefault(found(i), []).append(doc)
    return {doc: min((d for d in c if d is not None), default=None) for c in classes.values() for doc in c}


def test_classes_match_brute_force(spark):
    rows = documents(1)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, class_id string, row int")
    got = nd.near_duplicates(df).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    kept = [r["doc_id"] for r in got if r["kept"]]
    assert sorted(kept, key=repr) == sorted({c for c in want.values()}, key=repr)
    stays = nd.drop_near_copies(df)
    assert stays.columns == df.columns and sorted((r["doc_id"] for r in stays.collect()), key=repr) == sorted(kept, key=repr)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert nd.near_duplicates(df).count() == 0 and nd.drop_near_copies(df).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(bytes([i]), bytes([i + 1])) for i in range(1, 20)] + [(bytes([100]), bytes([i])) for i in range(101, 140)]
    got = nd.components(spark.createDataFrame(links, "a binary, b binary")).collect()
    assert {bytes(r["node"]): bytes(r["root"]) for r in got} == {bytes([i]): bytes([1]) for i in range(2, 21)} | {bytes([i]): bytes([100]) for i in range(101, 140)}


def passage_pairs(count, passage, own, edits):
    """Pairs of near copies whose texts all hold one passage, so that every two are somewhat alike."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(7))
    common, rows = [word() for _ in range(passage)], []
    for i in range(count):
        text = common + [word() for _ in range(own)]
        copy = list(text)
        for at in rng.sample(range(7, len(text) - 7, 7), edits[i % len(edits)]):
            copy[at] = word()
        rows += [" ".join(text), " ".join(copy)]
    return list(enumerate(rows, 1))


def test_pairs_within_a_shared_passage(spark):
    rows = passage_pairs(1000, 190, 30, (2, 3, 4))
    words = nd.WordHashes()
    grams = [nd.shingles(words(t), nd.SHINGLE) for _, t in rows]
    assert all(0.8 <= nd.similarity(grams[i], grams[i + 1], 0.1) <= 0.92 for i in range(0, len(rows), 2))
    assert max(nd.similarity(grams[0], g, 0.1) for g in grams[2:]) < 0.8
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {i: i - (i + 1) % 2 for i, _ in rows}


def test_large_class_is_whole(spark):
    """600 copies of one text, and a copy of each of them that is unlike the first text: one class, others apart."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(7))
    base, rows = [word() for _ in range(120)], []

    def edited(text, places):
        return [word() if i in places else w for i, w in enumerate(text)]

    def plain_similarity(a, b):
        grams = [[tuple(t[i : i + 5]) for i in range(len(t) - 4)] for t in (a, b)]
        m = lcs(*grams)
        return m / (len(grams[0]) + len(grams[1]) - m)

    for i in range(600):
        child = edited(base, set(rng.sample(range(6, 60, 6), 2)))
        rows += [child, edited(child, set(rng.sample(range(66, 114, 6), 2)))]
        if i < 3:
            assert plain_similarity(base, child) >= 0.8 and plain_similarity(*rows[-2:]) >= 0.8 > plain_similarity(base, rows[-1])
    rows += [[word() for _ in range(120)] for _ in range(50)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate([base, *rows])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in nd.near_duplicates(df).collect()}
    assert all(got[i]["class_id"] == 0 for i in range(1201)) and all(got[i]["class_id"] == i for i in range(1201, 1251))
    assert all(got[i]["n_links"] >= 1 for i in range(1201)) and all(got[i]["n_links"] == 0 for i in range(1201, 1251))


def test_repetitive_texts_align_quickly():
    words, began = nd.WordHashes(), time.time()
    a = nd.shingles(words("one two three four five six seven " * 8000), 5)
    b = nd.shingles(words("new " + "one two three four five six seven " * 7000 + "old one " * 2000), 5)
    assert nd.similarity(a, a, 0.8) == 1
    assert 0.5 < nd.similarity(a, b, 0.5) < 1
    assert nd.sketch(nd.shingles(words("word " * 200_000), 5), 16, 3)
    assert time.time() - began < 20

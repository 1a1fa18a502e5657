"""The pipeline against a plain version of it, and the queries that SQL can express."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tessera.llm import near_dedup as nd
from tessera.llm import queries
from tessera.llm.language_id import WORDS, fit
from tessera.llm.mixing import sampling_key
from tessera.llm.shared import table

from ..oracle import SF, compare
from .test_mixing import filled
from .test_packing import check

ODD = [
    (9001, None, "en", "src1"), (9002, "", "en", "src1"), (9003, "123 456 ...", "en", "src2"), (None, "the and with of this that is a line without an id", "en", "src3"),
    (9004, "the and with of this that is a line of which two rows are equal", "en", None), (9004, "the and with of this that is a line of which two rows are equal", "en", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    given = table(spark, SF, "documents").select("doc_id", "text", "lang", "source", "n_chars", F.lit("x").alias("row"), F.lit(0.5).alias("score"))
    extra = spark.createDataFrame([(*r, 1, "x", 0.5) for r in ODD], given.schema)
    return given.unionByName(extra).cache()


def rows_of(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


def test_stages_match_a_plain_version(spark, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "exact", "near", "mixture", "packing"]
    stage = dict(corpus_pipeline.STAGES)

    model = fit(docs.select(F.col("doc_id").alias("key"), "text", "lang"))

    def spoken(text):
        words = WORDS.findall((text or "").lower())
        if not words:
            return False
        total = sum(model.score_word(w) for w in words)
        return 1 / sum(math.exp(min(0.0, x - max(total))) for x in total) >= 0.5

    one = stage["language"](spark, docs, SF).cache()
    assert one.columns == docs.columns
    assert Counter(rows_of(one)) == Counter(r for r in rows_of(docs) if spoken(r[1]))

    two = stage["exact"](spark, one, SF).cache()
    last = {}
    for i, text, _ in rows_of(one):
        last[text] = max(last.get(text, -1), -1 if i is None else i)
    got = rows_of(two)
    assert two.columns == docs.columns and len(got) == len(last)
    assert {t: -1 if i is None else i for i, t, _ in got} == last

    three = stage["near"](spark, two, SF).cache()
    words = nd.WordHashes()
    grams = [nd.shingles(words(t), nd.SHINGLE) for _, t, _ in got]
    root = list(range(len(got)))

    def found(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(got)):
        for j in range(i):
            if np.array_equal(grams[i], grams[j]) or nd.similarity(grams[i], grams[j], 0.8) >= 0.8:
                root[found(i)] = found(j)
    classes = defaultdict(list)
    for i, r in enumerate(got):
        classes[found(i)].append(r)
    stays = Counter(min(c, key=lambda r: (r[0] is None, r[0] or 0)) for c in classes.values())
    assert three.columns == docs.columns and Counter(rows_of(three)) == stays

    four = stage["mixture"](spark, three, SF).cache()
    text = F.coalesce(F.col("text"), F.lit(""))
    prose = F.length(F.regexp_replace(text, r"[^\p{L}\p{M} ]+", "")) / F.greatest(F.length(text), F.lit(1))
    keyed = three.select("text", *sampling_key(F.greatest(prose, F.lit(0.05)), None, 17)).collect()
    by = defaultdict(list)
    for r in keyed:
        by[r["source"]].append(r)
    targets = filled({s: sum(r["size"] for r in rs) for s, rs in by.items()})
    want = Counter()
    for s, rs in by.items():
        whole = sum(r["size"] for r in rs)
        epochs = int(targets[s] / whole + 1e-9)
        left = math.floor(targets[s] + 0.5) - epochs * whole
        for r in sorted(rs, key=lambda r: (r["key"], r["doc_id"] is not None, r["doc_id"] or 0)):
            more = 0 < left and 2 * left >= r["size"]
            left -= r["size"]
            want[(r["doc_id"], r["text"], s)] += epochs + more
    mixed = Counter(rows_of(four))
    unlike = [(r[0], r[2], mixed[r], want[r], targets[r[2]]) for r in mixed | want if mixed[r] != want[r]]
    assert four.columns == docs.columns and unlike == []

    five = stage["packing"](spark, four, SF).collect()
    used, least = check([(i, t) for i, t, _ in rows_of(four)], five, 1024)
    assert used <= 1.02 * least + 2


def test_run_applies_the_stages(spark):
    out = __spark_entry__.queries()["pipeline"](spark, SF)
    assert out.count() > 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    assert compare(spark, name, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("number", range(1, 11))
def test_one_query_per_operator(number):
    assert sum(n.startswith(f"op{number}_") for n in queries.QUERIES) == 1


def test_language_query_holds_out(spark):
    truth = {r["doc_id"]: r["lang"] for r in table(spark, SF, "documents").collect()}
    got = queries.QUERIES["op7_language_id"](spark, SF).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(truth) and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97


def test_main_text_query(spark):
    got = {r["page_id"]: r["text"] for r in queries.QUERIES["op3_main_text"](spark, SF).collect()}
    from tessera.llm.html_text import blocks

    pages = table(spark, SF, "pages").collect()
    right = sum(got[p["page_id"]] == "\n\n".join(t for path, t, _ in blocks(p["html"]) if "article" in path) for p in pages)
    assert right / len(pages) > 0.98

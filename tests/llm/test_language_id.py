import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import queries
from tessera.llm.language_id import Predictor, WordFirstModel, drop_unidentified, fit, identify_language
from tessera.llm.shared import table

from ..oracle import SF


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(0)
    parts = {"en": ["the", "ing", "tion", "of", "er", "and", "th"], "es": ["el", "ción", "los", "ar", "que", "ñ", "ue"], "de": ["der", "ung", "sch", "und", "ei", "ß"]}
    rows = []
    for i in range(600):
        lang = rng.choice(list(parts))
        word = lambda: "".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4)))
        rows.append((i, " ".join(word() for _ in range(rng.randrange(3, 40))), lang if i % 10 else None, lang, 0.5))
    return spark.createDataFrame(rows, "key long, text string, lang string, truth string, score double").cache()


def test_held_out_accuracy(labelled):
    model = fit(labelled.filter("key % 3 != 1"))
    got = identify_language(labelled.filter("key % 3 = 1"), model, "key", "truth").collect()
    assert sum(r["lang_pred"] == r["truth"] for r in got) / len(got) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_sample_and_model_are_bounded(labelled):
    model = fit(labelled, max_docs=60, max_words=25)
    assert len(model.words) <= 25 and len(model.languages) <= 3


def test_backoff_goes_to_shorter_grams():
    model = WordFirstModel([("a", "hello", 10), ("b", "world", 10)])
    assert model.score_word("hello").tolist() == model.word_logs[model.words["hello"]].tolist()
    longest = model.score_word("hellos")
    assert longest.argmax() == 0 and model.score_word("wo").argmax() == 1
    assert not model.score_word("###").any()


def test_texts_without_letters(spark):
    model = WordFirstModel([("a", "hello", 10), ("b", "world", 10)])
    p = Predictor(model)
    assert [p.predict(t) for t in (None, "", "12 34 !?", "²³")] == [("und", 0.0)] * 4
    assert p.predict("hello " * 100_000)[0] == "a"
    assert p.predict("ωψ")[0] in ("a", "b")
    assert Predictor(WordFirstModel([])).predict("hello") == ("und", 0.0)


def test_stage_drops_only_rejected_rows(spark, labelled):
    df = labelled.select("key", F.when(F.col("key") == 5, None).when(F.col("key") == 6, "123 456").otherwise(F.col("text")).alias("text"), "lang", "score")
    out = drop_unidentified(df, fit(labelled))
    assert out.columns == df.columns
    assert {r["key"] for r in df.join(out, "key", "left_anti").collect()} == {5, 6}
    assert out.union(out).count() == 2 * out.count()


def test_empty_table(spark):
    df = spark.createDataFrame([], "key long, text string, lang string")
    assert fit(df).languages == [] and identify_language(df, fit(df), "key").count() == 0


def test_rare_languages_and_words_are_kept(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{''.join(rng.choices('abcdefghij', k=9))}" for _ in range(200)), "common") for i in range(500)] * 2
    rows += [(5_000, "zuq xev olp", "seldom")]
    model = fit(spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], "key long, text string, lang string"))
    assert model.languages == ["common", "seldom"]
    assert len(model.words) == len({w for _, t, _ in rows for w in t.split()}) > 90_000
    assert Predictor(model).predict("olp zuq")[0] == "seldom"


def test_stage_keeps_texts_where_no_row_is_labelled(spark):
    df = spark.createDataFrame([(1, "a text", None), (2, "12 34", None), (3, None, None), (4, "ñ", None)], "key long, text string, lang string")
    assert sorted(r["key"] for r in drop_unidentified(df, fit(df)).collect()) == [1, 4]


class PlainBackoff:
    """Words first with dictionaries of strings: another way to the same scores."""

    def __init__(self, rows):
        self.words, self.grams = defaultdict(Counter), defaultdict(Counter)
        for text, lang in rows:
            for word, n in Counter(self.split(text)).items():
                self.words[lang][word] += n
                for size in range(1, 6):
                    for gram in self.cut(f"^{word}$", size):
                        self.grams[lang, size][gram] += n
        self.languages = sorted(self.words)
        self.known = self.shares(lambda lang: self.words[lang])
        self.known_grams = {size: self.shares(lambda lang, size=size: self.grams[lang, size]) for size in range(1, 6)}

    def split(self, text):
        return re.findall(r"[^\W\d_]+", (text or "").lower())

    def cut(self, text, size):
        return [text[i : i + size] for i in range(len(text) - size + 1)]

    def shares(self, counts):
        every = set().union(*(counts(lang) for lang in self.languages))
        totals = {lang: sum(counts(lang).values()) + 0.5 * len(every) for lang in self.languages}
        return {w: [math.log((counts(lang)[w] + 0.5) / totals[lang]) for lang in self.languages] for w in every}

    def word(self, word):
        if word in self.known:
            return self.known[word]
        for size in range(5, 0, -1):
            found = [self.known_grams[size][g] for g in self.cut(f"^{word}$" if size > 1 else word, size) if g in self.known_grams[size]]
            if found:
                return [sum(x) / len(found) for x in zip(*found)]
        return [0.0] * len(self.languages)

    def scores(self, text):
        return [sum(x) for x in zip(*(self.word(w) for w in self.split(text)))]


def test_query_matches_a_plain_version(spark):
    rows = {r["doc_id"]: r for r in table(spark, SF, "documents").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in rows}
    model = PlainBackoff([(r["text"], r["lang"]) for i, r in rows.items() if not held[i] and r["lang"] is not None])
    got = queries.QUERIES["op7_language_id"](spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == held[r["doc_id"]]
        total = model.scores(rows[r["doc_id"]]["text"])
        if not total:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        # Log frequencies are held in four bytes, so equal scores may differ a little.
        assert total[model.languages.index(r["lang_pred"])] >= max(total) - 0.01
        assert r["score"] == pytest.approx(1 / sum(math.exp(max(x - max(total), -700)) for x in total), abs=0.01)

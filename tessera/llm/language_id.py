"""Language identification by words first, backing off to ever shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import publish, ship

TRAIN_DOCS = 8_000
"""Bound of the fitting sample: so many labelled documents, drawn evenly by a hash of their ids."""
LONGEST = 5
WORDS = re.compile(r"[^\W\d_]+")
MEMO = 100_000
TOGETHER = 20_000
GRAM_FACTORS = np.random.default_rng(7).integers(0, 2**63, 65, np.uint64) * np.uint64(2) + np.uint64(1)
UNKNOWN = "und"


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n code points."""
    if len(codes) < n:
        return np.empty(0, np.uint64)
    total = np.full(len(codes) - n + 1, n, np.uint64) * GRAM_FACTORS[0]
    for i in range(n):
        total += codes[i : len(codes) - n + 1 + i] * GRAM_FACTORS[1 + i % (len(GRAM_FACTORS) - 1)]
    return total


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


class Hashed:
    """Rows of a table by 64-bit hashes, held as one sorted array."""

    def __init__(self, keys: np.ndarray, hashed=word_hash):
        self.keys, self.hashed = keys, hashed

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A row for each hash, and whether it is that hash's."""
        if not len(self.keys):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return at, self.keys[at] == hashes

    def get(self, key: str) -> int | None:
        at, found = self.find(np.array([self.hashed(key)], np.uint64))
        return int(at[0]) if found[0] else None

    def __getitem__(self, key: str) -> int:
        if (row := self.get(key)) is None:
            raise KeyError(key)
        return row


def hashed_rows(langs: Sequence[str], words: Sequence[str], numbers: Sequence[int], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, place of the word, hash, number): kind 0 has the words themselves, kind n their n-grams with marked ends, repeats included."""
    numbers = np.asarray(numbers, np.int64)
    yield 0, np.arange(len(words)), np.array([word_hash(w) for w in words], np.uint64), numbers
    marked = code_points("".join(f"^{w}$" for w in words))
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    ends, owner = np.repeat(np.cumsum(lengths), lengths), np.repeat(np.arange(len(words)), lengths)
    for n in range(1, longest + 1):
        inside = np.flatnonzero(np.arange(len(marked)) + n <= ends)
        if len(inside):
            yield n, owner[inside], gram_hashes(marked, n)[inside], numbers[owner[inside]]


class WordFirstModel:
    """Log frequencies by language: of known words, and of their n-grams for words that are unseen.

    Words and n-grams are held as hashes in sorted arrays, 8 bytes each and 4 for each language.
    """

    def __init__(self, counts: Iterable[tuple[str, str, int]], longest: int = LONGEST):
        langs, words, numbers = map(list, tuple(zip(*counts)) or ((), (), ()))
        parts = [(np.full(len(at), kind), np.array(langs, object)[at], hashes, number) for kind, at, hashes, number in hashed_rows(langs, words, numbers, longest)]
        self.build(*(np.concatenate(x) for x in zip(*parts)), longest)

    @classmethod
    def of_rows(cls, kinds: np.ndarray, langs: np.ndarray, hashes: np.ndarray, numbers: np.ndarray, longest: int = LONGEST) -> WordFirstModel:
        """The model of hashed rows that are counted already."""
        model = cls.__new__(cls)
        model.build(kinds, langs, hashes, numbers, longest)
        return model

    def build(self, kinds: np.ndarray, langs: np.ndarray, hashes: np.ndarray, numbers: np.ndarray, longest: int) -> None:
        self.longest = longest
        self.languages = sorted(set(langs.tolist()))
        place = {lang: i for i, lang in enumerate(self.languages)}
        columns = np.array([place[lang] for lang in langs.tolist()], np.int64)
        self.prior = [int(numbers[(kinds == 0) & (columns == i)].sum()) for i in range(len(self.languages))]
        tables = []
        for kind in range(longest + 1):
            own = kinds == kind
            keys, table = self.table(hashes[own], columns[own], numbers[own])
            tables.append((keys, self.logs(table)))
        (keys, self.word_logs), grams = tables[0], tables[1:]
        self.words = Hashed(keys)
        every = np.concatenate([keys for keys, _ in grams])
        order = np.argsort(every)
        self.by_gram, self.gram_logs = Hashed(every[order]), np.concatenate([logs for _, logs in grams])[order]

    def table(self, hashes: np.ndarray, columns: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct hashes, sorted, and each one's counts by language."""
        keys, rows = np.unique(hashes, return_inverse=True)
        width = len(self.languages)
        counts = np.bincount(rows * width + columns, numbers, len(keys) * width) if len(keys) else np.zeros(0)
        return keys, counts.reshape(len(keys), width)

    def logs(self, table: np.ndarray) -> np.ndarray:
        """Smoothed log frequencies of the counts, among one another."""
        return np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * len(table))).astype(np.float32)

    def score_words(self, words: list[str]) -> np.ndarray:
        """A row per word: its log frequencies if known; else the mean over its known n-grams of the greatest length that has any."""
        out = np.zeros((len(words), len(self.languages)))
        if not words:
            return out
        hashes = np.array([word_hash(w) for w in words], np.uint64)
        at, known = self.words.find(hashes)
        out[known] = self.word_logs[at[known]]
        open_words = np.flatnonzero(~known)
        for n in range(self.longest, 0, -1):
            if not len(open_words):
                break
            # Marks of a word's ends take no part in single letters.
            marked = [f"^{words[i]}$" if n > 1 else words[i] for i in open_words]
            codes, lengths = code_points("".join(marked)), np.array([len(w) for w in marked], np.int64)
            ends, owner = np.repeat(np.cumsum(lengths), lengths), np.repeat(np.arange(len(marked)), lengths)
            inside = np.flatnonzero(np.arange(len(codes)) + n <= ends)
            if not len(inside):
                continue
            at, found = self.by_gram.find(gram_hashes(codes, n)[inside])
            at, owner = at[found], owner[inside[found]]
            counts = np.bincount(owner, minlength=len(marked))
            for column in range(len(self.languages)):
                sums = np.bincount(owner, self.gram_logs[at, column], len(marked))
                out[open_words, column] = sums / np.maximum(counts, 1)
            open_words = open_words[counts == 0]
        return out

    def score_word(self, word: str) -> np.ndarray:
        return self.score_words([word])[0]


class Predictor:
    """Scores whole texts; rows of scored words are remembered up to MEMO of them, and new words are scored together."""

    def __init__(self, model: WordFirstModel):
        self.model, self.place, self.tables = model, {}, []

    def predict_all(self, texts: Iterable[str | None]) -> Iterator[tuple[str, float]]:
        held: list[Counter] = []
        new: dict[str, None] = {}
        for text in texts:
            words = Counter(WORDS.findall(text.lower())) if text else Counter()
            held.append(words)
            new.update((w, None) for w in words if w not in self.place)
            if len(new) >= TOGETHER:
                yield from self.settle(held, list(new))
                held, new = [], {}
        yield from self.settle(held, list(new))

    def settle(self, held: list[Counter], new: list[str]) -> Iterator[tuple[str, float]]:
        if len(self.place) + len(new) > MEMO:
            self.place, self.tables = {}, []
            new = list(dict.fromkeys(w for words in held for w in words))
        if self.model.languages and new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            self.tables.append(self.model.score_words(new))
            self.tables = [np.concatenate(self.tables)]
        for words in held:
            yield self.judge(words)

    def judge(self, words: Counter) -> tuple[str, float]:
        if not self.model.languages or not any(letter.isalpha() for word in words for letter in word):
            return UNKNOWN, 0.0
        at = np.fromiter((self.place[w] for w in words), np.int64, len(words))
        total = np.fromiter(words.values(), float, len(words)) @ self.tables[0][at]
        # Equal scores go to the language with the most words, then to the first.
        best = max(range(len(total)), key=lambda i: (total[i], self.model.prior[i], -i))
        return self.model.languages[best], float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum())

    def predict(self, text: str | None) -> tuple[str, float]:
        return next(self.predict_all([text]))


def fit(labelled: DataFrame, max_docs: int = TRAIN_DOCS, max_words: int | None = None) -> WordFirstModel:
    """Fit on (key, text, lang) rows with non-null lang: at most about max_docs of them, drawn by a hash of key.

    Spark counts the sample's words, taken as in prediction, and their n-grams, both as hashes; the driver gets these
    counts, of all words of the sample or of the most frequent max_words.
    """
    ship(labelled.sparkSession)
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = min(1.0, max_docs / max(1, labelled.count()))
    sample = labelled.filter(F.pmod(F.xxhash64("key", F.lit("language")), F.lit(1_000_000)) < math.ceil(share * 1_000_000))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words = Counter(WORDS.findall(text.lower()))
                columns = [pa.array([lang] * len(words), pa.string()), pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for kind, at, hashes, numbers in hashed_rows(langs, batch.column("word").to_pylist(), batch.column("count").to_numpy(), LONGEST):
                columns = [pa.array(np.full(len(at), kind, np.int32)), batch.column("lang").take(pa.array(at)), pa.array(hashes.view(np.int64)), pa.array(numbers)]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "lang", "hash", "n"])

    words = sample.select("lang", "text").mapInArrow(count, "lang string, word string, n long")
    counts = words.groupBy("lang", "word").agg(F.sum("n").alias("count"))
    if max_words is not None:
        counts = counts.orderBy(F.desc("count"), "lang", "word").limit(max_words)
    counts = publish(counts, "language-words")
    rows = counts.mapInArrow(hashed, "kind int, lang string, hash long, n long").groupBy("kind", "lang", "hash").agg(F.sum("n").alias("n"))
    names = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    number = F.coalesce(F.array_position(F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.col("lang")) - 1, F.lit(0))
    found = rows.select("kind", number.cast("int").alias("lang"), "hash", "n").toArrow()
    kinds, langs, hashes, numbers = (found.column(c).to_numpy() for c in ("kind", "lang", "hash", "n"))
    return WordFirstModel.of_rows(kinds, np.array(names, object)[langs], hashes.view(np.uint64), numbers)


def language_of(spark: SparkSession, model: WordFirstModel, text: Column) -> Column:
    """struct(lang_pred, score) of a text, from the whole text alone.

    A text that is null or has no letter gets 'und' and 0, as does every text if the model knows no language.
    Score is the posterior of the language under equal priors.
    """
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the model's parameters

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predictor = Predictor(shared.value)
        for texts in batches:
            yield pd.DataFrame(list(predictor.predict_all(texts)), columns=["lang_pred", "score"])

    return predict(text)


def identify_language(docs: DataFrame, model: WordFirstModel, *keep: Column | str) -> DataFrame:
    """The columns `keep` of every row of docs (text, ...), with lang_pred and score.

    Each row is judged by its text alone, so repeated rows get equal results, and neither other columns nor null
    ids matter. An empty table gives no rows. Very long texts are judged whole, in time linear in their length.
    """
    return docs.select(*keep, language_of(docs.sparkSession, model, F.col("text")).alias("found")).select("*", "found.*").drop("found")


def drop_unidentified(docs: DataFrame, model: WordFirstModel, least: float = 0.5) -> DataFrame:
    """docs without texts of no language or of a posterior under `least`; all columns stay as they are.

    A model that knows no language judges none: then only texts without letters go. Null texts go; rows repeated in
    full get one verdict; an empty table gives no rows; texts are judged whole however long they are.
    """
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = language_of(docs.sparkSession, model, F.col("text"))
    rows = docs.select(F.struct("*").alias("row"), found.alias("found"))
    return rows.filter((F.col("found.lang_pred") != UNKNOWN) & (F.col("found.score") >= least)).select("row.*")

"""Hybrid recommendations: nearest or best-ranked items under price, category and place filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spatial import degrees, within
from . import fulltext, vectors


def filters(
    price_min: float | None = None,
    price_max: float | None = None,
    category: str | None = None,
    near: tuple[float, float] | None = None,
    radius_km: float | None = None,
    price: str = "price",
    category_col: str = "category",
    x: str = "x",
    y: str = "y",
) -> Column | None:
    """The filters that are given, joined by AND; None without any."""
    parts = []
    if price_min is not None:
        parts.append(F.col(price) >= float(price_min))
    if price_max is not None:
        parts.append(F.col(price) <= float(price_max))
    if category:
        parts.append(F.col(category_col) == category)
    if near is not None and radius_km is not None:
        parts.append(within(F.col(x), F.col(y), near, degrees(radius_km)))
    return reduce(Column.__and__, parts) if parts else None


def kept(df: DataFrame, chosen: Column | None) -> DataFrame:
    return df if chosen is None else df.filter(chosen)


def clamp(k: int) -> int:
    return max(1, min(100, k))


def by_vector(df: DataFrame, key: str, column: str, vector, k: int = 10, metric: str = "cosine", chosen: Column | None = None) -> DataFrame:
    return vectors.nearest(kept(df, chosen), key, column, vector, clamp(k), metric)


def by_text(df: DataFrame, key: str, text: str, query: str, k: int = 10, language: str = "none", chosen: Column | None = None) -> DataFrame:
    return fulltext.best(fulltext.rank(kept(df, chosen), key, text, query, language), key, clamp(k))


def by_words(df: DataFrame, key: str, words: str, query: str, k: int = 10, chosen: Column | None = None) -> DataFrame:
    """Ranking over visual words, a text without language."""
    return by_text(df, key, words, query, k, "none", chosen)


def sample(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows drawn from all, each equally likely."""
    return df.orderBy(F.rand(seed)).limit(clamp(n))

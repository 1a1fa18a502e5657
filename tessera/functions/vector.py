"""Vector functions: literals, Euclidean and cosine distance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_vector(literal: str | Sequence[float], dim: int | None = None) -> list[float]:
    """'[a, b, ...]' (brackets may be left out) or a sequence as floats; another dimension than `dim` is an error."""
    if isinstance(literal, str):
        literal = [p for p in literal.strip().removeprefix("[").removesuffix("]").split(",") if p.strip()]
    values = [float(x) for x in literal]
    if dim is not None and len(values) != dim:
        raise ValueError(f"the vector has {len(values)} components, not {dim}")
    return values


def constant(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def l2_distance(vector: Column, query: Sequence[float]) -> Column:
    gaps = F.zip_with(vector, constant(query), lambda x, q: (x.cast("double") - q) * (x.cast("double") - q))
    return F.sqrt(total(gaps))


def cosine_distance(vector: Column, query: Sequence[float]) -> Column:
    """1 - q.v / (|q| |v|); 1 if either is zero."""
    size = sum(float(x) ** 2 for x in query) ** 0.5
    dot = total(F.zip_with(vector, constant(query), lambda x, q: x.cast("double") * q))
    own = F.sqrt(total(F.transform(vector, lambda x: x.cast("double") * x.cast("double"))))
    if size == 0:
        return F.when(vector.isNotNull(), F.lit(1.0))
    return F.when(own == 0, F.lit(1.0)).otherwise(1 - dot / (own * F.lit(size)))


METRICS = {"l2": l2_distance, "cosine": cosine_distance}

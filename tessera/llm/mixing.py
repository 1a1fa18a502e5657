"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import with_serial
from .shared import publish

SLICES = 4096
"""Slices of the key's range in a source; only the slice that the budget ends in is sorted."""
BROADCAST_SOURCES = 100_000
"""Decisions of so many sources (about 50 bytes each) are broadcast; those of more are joined by a shuffle."""


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(source, source_size) -> (source, source_size, target, epochs, rest).

    The share of all sizes is dealt by weight; no target exceeds `limit` times its source, and what is above is
    dealt again by weight until none is. A round is one sum over the sources, and those at their limit only grow, so
    there are few. Sources are numbered over ranges of their names; no window runs over all of them.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    numbered = with_serial(sizes, F.col("source").asc_nulls_last(), name="_number")
    ranked = publish(
        numbered.select(
            "source",
            "source_size",
            F.get(cycle, F.pmod(F.col("_number") - 1, F.lit(len(weights)))).alias("w"),
            (F.col("source_size") * F.lit(float(limit))).alias("cap"),
        ),
        "mix-sources",
    )
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    level, full_before = 0.0, -1
    while level is not None:
        full = F.lit(level) * F.col("w") > F.col("cap")
        n_full, at_limit, open_weight = ranked.agg(
            F.count_if(full), F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))
        ).first()
        if n_full == full_before:
            break
        full_before = n_full
        level = (total - at_limit) / open_weight if open_weight else None
    target = F.col("cap") if level is None else F.least("cap", F.lit(level) * F.col("w"))
    return (
        ranked.withColumn("target", target)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.round(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size"))
        .withColumn("rest", F.greatest(F.col("rest"), F.lit(0).cast("long")))
        .select("source", "source_size", "target", "epochs", "rest")
    )


def sampling_key(weight: Column | None, size: Column | None, seed: int) -> list[Column]:
    """doc_id, source, size, key and slice: the Efraimidis-Spirakis key -ln(u)/w and its slice by probability."""
    words = word_count(F.col("text")) if size is None else size
    named = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), words, F.lit(seed)).cast("binary"))
    # 52 bits of the hash, so that u lies strictly between 0 and 1.
    u = (F.conv(F.substring(named, 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))
    w = F.lit(1.0) if weight is None else F.when(weight > 0, weight.cast("double")).otherwise(F.lit(1.0))
    key = -F.log(u) / w
    # 1 - exp(-key) rises with the key and lies in [0, 1].
    part = F.floor((1 - F.exp(-key)) * SLICES).cast("int")
    return [F.col("doc_id"), F.col("source"), words.alias("size"), key.alias("key"), part.alias("slice")]


def mix(docs: DataFrame, weight: Column | None = None, size: Column | None = None, seed: int = 17, cut_last: bool = True, **targets) -> DataFrame:
    """Words to take of every row of docs (doc_id, text, source): doc_id, source, size, key, source_size, target, epochs, taken.

    The size of a document is its number of words, or the column `size`.

    Each source is taken as often as its target allows in whole epochs. For the rest its documents are ordered by
    Efraimidis-Spirakis keys -ln(u)/w (u from a hash of id, size and seed; w the quality `weight`, 1 by default)
    and taken while their prefix sum stays in the budget. The document that the budget ends in is cut there
    (`cut_last`), or else taken whole if that comes nearer.

    A hot source is never sorted as one group: keys fall into slices of equal probability, slice sums (combined
    before the shuffle) tell the slice where the budget ends, and only that slice is sorted. Null text has size 0,
    a null source is a source of its own, null or non-positive weights count as 1, and repeated rows are rows of
    their own. Other columns are ignored. Very long texts are counted whole. An empty table gives no rows. Reruns agree.
    """
    keyed = publish(docs.select(*sampling_key(weight, size, seed)), "mix-keys")
    slices = publish(keyed.groupBy("source", "slice").agg(F.sum("size").alias("n")), "mix-slices")
    goals = source_targets(slices.groupBy("source").agg(F.sum("n").alias("source_size")), **targets).withColumnRenamed("source", "g_source")
    upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        slices.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0).cast("long")))
        .join(goals, F.col("source").eqNullSafe(F.col("g_source")))
        .withColumn("left", F.col("rest") - F.col("before"))
        .select(F.col("source").alias("g_source"), F.col("slice").alias("g_slice"), "n", "left", "source_size", "target", "epochs")
    )
    # One row per source and slice against many documents: skewed parts of the documents are split by Spark.
    rows = keyed.join(placed, F.col("source").eqNullSafe(F.col("g_source")) & (F.col("slice") == F.col("g_slice")))
    whole = F.col("epochs") * F.col("size")
    edge = (F.col("left") > 0) & (F.col("left") < F.col("n"))
    columns = ["doc_id", "source", "size", "key", "source_size", "target", "epochs"]
    plain = rows.filter(~edge).select(*columns, (whole + F.when(F.col("left") >= F.col("n"), F.col("size")).otherwise(0)).alias("taken"))
    within = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.filter(edge).withColumn("left", F.col("left") - F.coalesce(F.sum("size").over(within), F.lit(0).cast("long")))
    more = F.greatest(F.least("left", "size"), F.lit(0)) if cut_last else F.when(F.col("left") * 2 >= F.col("size"), F.col("size")).otherwise(0)
    return plain.unionByName(last.select(*columns, (whole + F.when(F.col("left") > 0, more).otherwise(0)).alias("taken")))


def repeat_documents(docs: DataFrame, weight: Column | None = None, seed: int = 17, **targets) -> DataFrame:
    """docs with each row as often as the mix takes it, whole documents only; all columns stay as they are.

    Within a source the rest is the documents up to one key. So the decisions are a row per source, and documents
    find theirs by their own key; no text is shuffled while sources are few enough to broadcast.

    Null texts and texts without words have size 0: they come as often as their source's whole epochs. A null source
    is a source of its own. Rows with one id and size tie, and fall on the same side of the cut. An empty table gives no rows.
    """
    taken = mix(docs, weight, None, seed, cut_last=False, **targets)
    more = F.col("taken") > F.col("epochs") * F.col("size")
    cuts = publish(
        taken.groupBy(F.col("source").alias("c_source")).agg(
            F.max("epochs").alias("epochs"), F.max(F.when(more, F.struct("key", "doc_id", "size"))).alias("cut")
        ),
        "mix-cuts",
    )
    if cuts.count() <= BROADCAST_SOURCES:
        cuts = F.broadcast(cuts)
    rows = docs.select(F.struct("*").alias("row"), *sampling_key(weight, None, seed))
    rows = rows.join(cuts, F.col("source").eqNullSafe(F.col("c_source")))
    before = F.coalesce(F.struct("key", "doc_id", "size") <= F.col("cut"), F.lit(False)) & (F.col("size") > 0)
    times = (F.col("epochs") + before.cast("long")).cast("int")
    return rows.select("row", F.explode(F.array_repeat(F.lit(1), times))).select("row.*")

"""Near-duplicates by order MinHash over word shingles, verified by banded alignment."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import marks, publish, ship, with_mark

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 16
SAMPLED = 3
"""Two texts of similarity s share one of the sketches with probability 1 - (1 - s**3)**16: all but 1e-5 at 0.8."""
SLOT_BITS = 22
BLOCK = 1 << 12
"""Shingles are counted in 2**22 slots by hash, sent in blocks; the table of orders that tasks get has a byte per slot."""
MEMO = 300_000
MANY = 16
ODD = np.random.default_rng(2).integers(0, 2**63, 128, np.uint64) * np.uint64(2) + np.uint64(1)
FACTORS, SEEDS, TURNS = ODD[:16], ODD[16:72], ODD[72:]
"""Fixed random odd numbers: factors of hashes, and the sketches' orders."""
WORD = re.compile(r"\w+")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def folded(columns: list[np.ndarray]) -> np.ndarray:
    """One hash of several aligned columns, in their order."""
    total = columns[0] * FACTORS[0]
    for column, factor in zip(columns[1:], FACTORS[1:], strict=False):
        total += column * factor
    return mixed(total)


class WordHashes:
    """32-bit hashes of a text's lower-case words; hashes of words are remembered up to MEMO of them."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words, known = WORD.findall(text.lower()), self.known
        try:
            return np.array([known[w] for w in words], np.uint32)
        except KeyError:
            if len(known) > MEMO:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh32_intdigest(w)
            return np.array([known[w] for w in words], np.uint32)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words; a shorter text is one run."""
    if not len(words):
        return np.empty(0, np.uint64)
    size = min(size, len(words))
    return folded([words[i : len(words) - size + 1 + i].astype(np.uint64) for i in range(size)])


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Each hash joined with the number of its occurrences before, so that repeats differ."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    fresh = np.r_[True, ordered[1:] != ordered[:-1]]
    if fresh.all():
        return mixed(hashes)
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(hashes)), 0))
    count = np.empty(len(hashes), np.uint64)
    count[order] = np.arange(len(hashes)) - first
    return mixed(hashes + count * np.uint64(0x9E3779B97F4A7C15))


def sketch(hashes: np.ndarray, sketches: int, sampled: int) -> list[int]:
    """Per sketch the `sampled` shingles that are least under its own order, in text order, as one hash."""
    if not len(hashes):
        return []
    named = labelled(hashes)
    keys = (named ^ SEEDS[:sketches, None]) * TURNS[:sketches, None]
    if len(named) > sampled:
        least = np.sort(np.argpartition(keys, sampled - 1, axis=1)[:, :sampled], axis=1)
    else:
        least = np.tile(np.arange(len(named)), (sketches, 1))
    return folded([SEEDS[:sketches], *named[least].T]).view(np.int64).tolist()


def aligned_matches(a: np.ndarray, b: np.ndarray, width: int) -> int:
    """Most matches of an order-preserving alignment of a and b that stays within `width` of the diagonal.

    A bit vector holds a window of a; a zero bit is a place where the best count of matches steps up. Places of
    shingles that occur more than MANY times are read from the window as a whole, so repetitive texts cost no more.
    """
    places: dict[int, list[int]] = {}
    for i, h in enumerate(a.tolist()):
        places.setdefault(h, []).append(i)
    frequent = {h: np.uint64(h) for h, found in places.items() if len(found) > MANY}
    size = 2 * width + 1
    full = steps = (1 << size) - 1
    low = count = 0
    for j, h in enumerate(b.tolist()):
        if h not in places:
            continue
        if (shift := j - width - low) > 0:
            gone = steps & ((1 << shift) - 1) if shift < size else steps
            count += min(shift, size) - gone.bit_count()
            steps = steps >> shift | full ^ (full >> shift)
            low += shift
        hits = 0
        if h in frequent:
            hits = int.from_bytes(np.packbits(a[low : j + width + 1] == frequent[h], bitorder="little").tobytes(), "little")
        else:
            for i in places[h]:
                if low <= i <= j + width:
                    hits |= 1 << (i - low)
        kept = steps & hits
        steps = (steps + kept | steps - kept) & full
    return count + size - steps.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Matches of the alignment over matches and all others: the Jaccard measure of shingles kept in order.

    Pairs that cannot reach `least` give 0. The band is as wide as any alignment that reaches it needs.
    """
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    need = least * (n + m) / (1 + least)
    if np.isin(a, b).sum() < need - 1e-9 or np.isin(b, a).sum() < need - 1e-9:
        return 0.0
    short = min(n, m)
    unlike = np.flatnonzero(a[:short] != b[:short])
    head = int(unlike[0]) if len(unlike) else short
    unlike = np.flatnonzero(a[n - (short - head) :][::-1] != b[m - (short - head) :][::-1])
    tail = int(unlike[0]) if len(unlike) else short - head
    width = int(max(n, m) - need) + 1
    inner = aligned_matches(a[head : n - tail], b[head : m - tail], width) if head + tail < short else 0
    matches = head + tail + inner
    return matches / (n + m - matches)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of id and text), fp (fingerprint of the word sequence), bands (sketch hashes) of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHashes()
        for batch in batches:
            prints, bands = [], []
            for text in batch.column("text").to_pylist():
                words = hashed(text)
                prints.append(xxhash.xxh3_128_digest(words.tobytes()))
                bands.append(sketch(shingles(words, SHINGLE), SKETCHES, SAMPLED))
            columns = [batch.column("doc_id"), batch.column("row"), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "fp", "bands"])

    return rows_of(docs).mapInArrow(sign, "doc_id long, row long, fp binary, bands array<long>")


def rows_of(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("row"))


def word_arrays(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """fp and word hashes of the rows that `wanted` (row, fp) names; only these rows reach Python or a shuffle."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHashes()
        for batch in batches:
            words = [hashed(text).tobytes() for text in batch.column("text").to_pylist()]
            prints = [xxhash.xxh3_128_digest(w) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), pa.array(words, pa.binary())], names=["fp", "words"])

    named = with_mark(rows_of(docs), marks(wanted, "row"), "named", "row").filter("named").select("text")
    return named.mapInArrow(read, "fp binary, words binary").dropDuplicates(["fp"])


def verified(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """pairs (a, b) with their similarity, 0 where it is under `least`."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, last, held = [], None, np.empty(0, np.uint64)
            for left, right in zip(batch.column("a_words"), batch.column("b_words")):
                if (raw := right.as_py()) != last:
                    last, held = raw, shingles(np.frombuffer(raw, np.uint32), SHINGLE)
                found.append(similarity(shingles(np.frombuffer(left.as_py(), np.uint32), SHINGLE), held, least))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], names=["a", "b", "similarity"])

    left = words.select(F.col("fp").alias("a"), F.col("words").alias("a_words"))
    right = words.select(F.col("fp").alias("b"), F.col("words").alias("b_words"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "a_words", "b_words").mapInArrow(compare, "a binary, b binary, similarity double")


def hub_pairs(members: DataFrame) -> DataFrame:
    """(a, b): every member a of a bucket (fp, band, n) with the bucket's hub b, one row per member and bucket.

    The hub is the member whose other buckets are largest: in a group of copies of one text, that text or the copy
    nearest to it. So a bucket of n members gives n - 1 pairs.
    """
    central = members.groupBy("fp").agg(F.sum(F.log2("n")).alias("weight"))
    weighed = members.join(central, "fp").select("band", "fp", "weight")
    hubs = publish(weighed.groupBy("band").agg(F.max(F.struct("weight", "fp")).alias("top")).select("band", F.col("top.fp").alias("b")), "near-hubs")
    return weighed.join(hubs, "band").filter(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b")


def slots_of(named: np.ndarray) -> np.ndarray:
    return (named >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def commonness(words: DataFrame) -> np.ndarray:
    """Per slot of shingle hashes a byte that grows with the number of texts' shingles in it: 0 for none, 1 for just one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SLOT_BITS, np.uint32)
        for batch in batches:
            for raw in batch.column("words"):
                np.add.at(counts, slots_of(labelled(shingles(np.frombuffer(raw.as_py(), np.uint32), SHINGLE))), 1)
        blocks = counts.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        for part in np.array_split(used, max(1, len(used) // 256)):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([blocks[i].tobytes() for i in part], pa.binary())], names=["block", "counts"])

    def total(group: pa.Table) -> pa.Table:
        counts = np.zeros(BLOCK, np.uint64)
        for raw in group.column("counts"):
            counts += np.frombuffer(raw.as_py(), np.uint32)
        level = np.where(counts > 1, 1 + np.ceil(4 * np.log2(np.maximum(counts, 1))), counts).clip(max=255).astype(np.uint8)
        return pa.table({"block": group.column("block")[:1], "levels": pa.array([level.tobytes()], pa.binary())})

    counted = words.select("words").mapInArrow(count, "block int, counts binary")
    levels = np.zeros(((1 << SLOT_BITS) // BLOCK, BLOCK), np.uint8)
    for block, raw in counted.groupBy("block").applyInArrow(total, "block int, levels binary").collect():
        levels[block] = np.frombuffer(raw, np.uint8)
    return levels.ravel()


def prefix(named: np.ndarray, levels: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The text's rarest labelled shingles, as many as a pair of similarity `least` needs to share one, and their places.

    All texts order shingles alike, by level and hash; any such order is exact, and one that puts shared passages
    last gives few pairs. Shingles that stand in one text only are left out, but keep their places.
    """
    level = levels[slots_of(named)]
    size = len(named) - math.ceil(least * len(named) - 1e-9) + 1
    order = np.lexsort((named, level))[:size]
    places = np.flatnonzero(level[order] > 1)
    return named[order[places]], places


def rest_pairs(words: DataFrame, rooted: DataFrame, levels: np.ndarray, least: float) -> DataFrame:
    """(a, b): all pairs of texts of `rooted` (fp, root) with different roots that can reach `least`, by prefix filtering.

    A pair of similarity `least` has at least need = least * (n + m) / (1 + least) labelled shingles in common, so its
    first common one leaves that many behind it in both texts. The lengths and that place decide; nothing is capped.
    """
    shared = words.sparkSession.sparkContext.broadcast(levels)  # a byte per slot

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, node, root in zip(batch.column("words"), batch.column("node"), batch.column("root")):
                named = labelled(shingles(np.frombuffer(raw.as_py(), np.uint32), SHINGLE))
                tokens, places = prefix(named, shared.value, least)
                if len(tokens):
                    same = [pa.array(np.full(len(tokens), x.as_py(), np.int64)) for x in (node, root)]
                    columns = [pa.array(tokens.view(np.int64)), *same, pa.array(np.full(len(tokens), len(named), np.int32)), pa.array(places.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["token", "node", "root", "size", "place"])

    # Nodes and roots go as 64-bit hashes.
    ids = rooted.select("fp", F.xxhash64("fp").alias("node"), F.xxhash64("root").alias("root"))
    rows = words.join(ids, "fp").select("words", "node", "root").mapInArrow(rarest, "token long, node long, root long, size int, place int")
    rows = publish(rows, "near-rarest")
    several = publish(rows.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("token"), "near-several")
    rows = with_mark(rows, marks(several, "token"), "shared", "token").filter("shared").drop("shared").join(several, "token", "left_semi")
    rows = publish(rows, "near-rarest")
    name = lambda end: [F.col(c).alias(c + end) for c in ("node", "root", "size", "place")]
    need = least * (F.col("size_a") + F.col("size_b")) / (1 + least) - 1e-6
    short = rows.filter(F.col("size") - F.col("place") >= 2 * least / (1 + least) * F.col("size") - 1e-6)
    met = short.select("token", *name("_a")).join(rows.select("token", *name("_b")), "token").filter(
        (F.col("root_a") != F.col("root_b"))
        & (F.struct("size_a", "node_a") < F.struct("size_b", "node_b"))
        & (F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b")) >= need)
        & (F.col("size_a") >= need)
    )
    pairs = met.select("node_a", "node_b").distinct()
    fps = ids.select("fp", "node")
    return pairs.join(fps.select(F.col("fp").alias("a"), F.col("node").alias("node_a")), "node_a").join(fps.select(F.col("fp").alias("b"), F.col("node").alias("node_b")), "node_b").select("a", "b")


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root): the least node of each link's component, by alternating star contraction.

    Each step replaces links by links to a least neighbour and is written to the shared folder; it ends when a
    step changes nothing. Minima are combined before the shuffle, and a node with many links is split in the join.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
        # After a small star every edge points from a greater node u to a lesser v.
        least = publish(both.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("least", "u")), "star")
        joined = both.join(least, "u")
        if large:
            out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(least.select("u", F.col("least").alias("v")))
        return out.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    edges = publish(links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).filter(F.col("u") != F.col("v")).distinct(), "links")
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        seen = state
        edges = publish(star(star(edges, large=True), large=False), "links")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, class_id, row (a hash of id and text), class_fp, n_links, kept.

    Texts of equal word sequences (lower case, white space and punctuation aside) are one node. Each node is
    sketched: every sketch takes the least SAMPLED of the text's five-word shingles, labelled by occurrence, and
    keeps them in text order. Nodes that share a sketch are compared with their bucket's hub by banded alignment
    of the shingles, and pairs of similarity `least` or more are links. Buckets whose members are in one class then
    are done. Of the others all texts are compared that are in different classes and can reach `least` by their
    rarest shingles, so no link between classes is lost. Classes are the links' components; class_id is the least
    doc_id of a class, and of its rows one is kept, with that id. n_links counts the node's links that were needed
    to find its class, and its rows' equal texts beyond the first.

    Null text is empty; texts without words are one class. Texts under five words are alike if equal. Null ids are
    kept only in a class without other ids; rows repeated with their id are one class, and one of them is kept.
    Other columns are ignored. An empty table gives no rows. Very long texts are sketched and aligned whole: the
    alignment's time is their length times the width of its band, its memory their length.
    """
    ship(docs.sparkSession)
    signed = publish(signatures(docs), "near-signatures")
    nodes = publish(
        signed.groupBy("fp").agg(F.first("bands").alias("bands"), F.min("row").alias("row"), F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")), "near-nodes"
    )
    banded = nodes.select("fp", F.explode("bands").alias("band"))
    sizes = publish(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "near-buckets")
    members = publish(with_mark(banded, marks(sizes, "band"), "shared", "band").filter("shared").select("fp", "band").join(sizes, "band"), "near-members")
    pairs = publish(hub_pairs(members).select("a", "b").distinct(), "near-pairs")
    named = members.select("fp").distinct()
    words = publish(word_arrays(docs, nodes.join(named, "fp", "left_semi").select("row")), "near-words")
    checked = publish(verified(pairs, words, least), "near-checked")
    links = checked.filter(F.col("similarity") >= least).select("a", "b")
    roots = publish(components(links), "near-roots").withColumnRenamed("node", "fp")
    placed = members.select("fp", "band").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    open_bands = publish(placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("band"), "near-open")
    if not open_bands.isEmpty():
        asked = with_mark(placed, marks(open_bands, "band"), "open", "band").filter("open").select("fp", "root").distinct()
        asked = publish(asked, "near-asked")
        chosen = publish(with_mark(words, marks(asked, "fp"), "asked", "fp").filter("asked").select("fp", "words"), "near-asked-words")
        rest = publish(rest_pairs(chosen, asked, commonness(chosen), least), "near-rest")
        rechecked = publish(verified(rest, chosen, least), "near-checked")
        found = rechecked.filter(F.col("similarity") >= least).select("a", "b")
        if not found.isEmpty():
            links = links.unionByName(found)
            roots = publish(components(links), "near-roots").withColumnRenamed("node", "fp")
    ends = links.select(F.col("a").alias("fp")).unionByName(links.select(F.col("b").alias("fp"))).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    known = nodes.select("fp", "doc_id", "copies").join(roots, "fp", "left").join(ends, "fp", "left")
    linked = F.coalesce("n_links", F.lit(0).cast("long")) + F.col("copies") - 1
    rooted = publish(known.select("fp", "doc_id", F.coalesce("root", "fp").alias("root"), linked.alias("n_links")), "near-rooted")
    classes = publish(rooted.groupBy("root").agg(F.min("doc_id").alias("class_id")), "near-classes")
    named = publish(rooted.join(classes, "root").select("fp", "class_id", F.col("root").alias("class_fp"), "n_links"), "near-named")
    labelled_rows = signed.select("doc_id", "row", "fp").join(named, "fp").select("doc_id", "class_id", "row", "class_fp", "n_links")
    return with_keeper(labelled_rows)


def with_keeper(rows: DataFrame) -> DataFrame:
    """Mark one row of each class: its class_id's first. Only rows that carry the class's id are ranked."""
    from pyspark.sql import Window

    own = F.col("doc_id").eqNullSafe(F.col("class_id"))
    first = F.row_number().over(Window.partitionBy("doc_id", "class_fp").orderBy(F.lit(1))) == 1
    return rows.withColumn("kept", own & first)


def drop_near_copies(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """docs without the rows that near_duplicates does not keep; all columns stay as they are.

    Rows of classes of one pass without a shuffle; only others travel with their texts. Nulls, ties, repeated rows and
    very long texts are as near_duplicates says; an empty table gives no rows.
    """
    verdicts = publish(near_duplicates(docs.select("doc_id", "text"), least), "near-verdicts")
    dropped = verdicts.filter(~F.col("kept")).select("row")
    keepers = verdicts.filter("kept").select(F.col("row").alias("keeper")).distinct()
    rows = docs.select(F.struct("*").alias("all"), F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))).alias("row"))
    rows = with_mark(rows, marks(dropped, "row"), "suspect", "row")
    suspects = rows.filter("suspect")
    stay = suspects.join(keepers, suspects.row == keepers.keeper, "left_semi").dropDuplicates(["row"])
    return rows.filter(~F.col("suspect")).select("all.*").unionByName(stay.select("all.*"))

"""Best-fit packing of tokenised documents: local best fit, then rounds that merge underfull bins."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import publish, ship

CAPACITY = 1024
END_ID = 2
ITEMS_PER_TASK = 32_000
FAN_IN = 8
SLACK = 4
SPECIAL = "<|endoftext|>"


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def exact_tokenizer(path: str):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    exact.no_truncation()
    exact.no_padding()
    return exact


@lru_cache(maxsize=2)
def encoder(path: str):
    """Text -> ids, as the vocabulary file's own library gives them.

    The same vocabulary as ranks, beside the file, is several times faster; texts that hold the special token's
    string, which the file's library reads as that token, go through the file itself.
    """
    import public_tokenizers
    import tiktoken

    with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if SPECIAL in text:
            return exact_tokenizer(path).encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def pieces(count: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one if it fits, else full ones after a shorter first."""
    if count <= capacity:
        return [(0, count)]
    first = count % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, count, capacity)]


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_documents(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                ids = np.array([*encode(text), end_id], dtype="<u4")
                for number, (start, length) in enumerate(pieces(len(ids), capacity)):
                    rows.append((doc_id, number, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = pd.array(out["doc_id"], dtype="Int64")
            yield out

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return slim.mapInPandas(cut, PIECE)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing over sizes in descending order: each item's bin and offset, and the bins' fill.

    Open bins are kept by their room; a bit set of the rooms in use gives the tightest fit at once.
    """
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins, offsets, used = 0, np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    for i, size in enumerate(sizes.tolist()):
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            number = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            number, room = len(used), capacity
            used.append(0)
        bins[i], offsets[i] = number, used[number]
        used[number] += size
        if room > size:
            rooms[room - size].append(number)
            mask |= 1 << (room - size)
    return bins, offsets, np.array(used, np.int64)


BINNED = PIECE + ", task long, bin long, offset long, used long, closed boolean"


def nth_of_its_kind(values: np.ndarray) -> np.ndarray:
    """How many equal values stand before each."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    first = np.searchsorted(ordered, ordered)
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values)) - first
    return out


def pack_round(items: DataFrame, capacity: int, slack: int, fan_in: int, last: bool) -> DataFrame:
    """Pack the bins of each task's group anew; items have task, bin (theirs so far), offset in it, used.

    A task hands on fan_in open bins of each fill and closes the others, which no later round could fill: best fit
    leaves a task one bin at most that is no more than half full, so a round over fan_in tasks has fan_in such bins
    at most, each merge takes one, and so no more than fan_in of the fuller bins of any fill can find a partner.
    """

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece", "ids_crc32", "offset"], kind="stable").reset_index(drop=True)
        whole = frame.groupby(["from_task", "bin"], sort=False).ngroup().to_numpy()
        size = np.zeros(whole.max() + 1, np.int64)
        size[whole] = frame["used"].to_numpy()
        order = np.argsort(-size, kind="stable")
        bins, offsets, used = best_fit(size[order], capacity)
        place, base = np.empty_like(bins), np.empty_like(offsets)
        place[order], base[order] = bins, offsets
        closed = used >= capacity - slack
        if last:
            closed[:] = True
        else:
            closed |= nth_of_its_kind(used) >= fan_in
        frame["task"], frame["bin"] = key[0], place[whole]
        frame["offset"] += base[whole]
        frame["used"], frame["closed"] = used[frame["bin"]], closed[frame["bin"]]
        return frame.drop(columns="from_task")

    return items.groupBy("task").applyInPandas(pack, BINNED)


def pack_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    items_per_task: int = ITEMS_PER_TASK,
    fan_in: int = FAN_IN,
    slack: int = SLACK,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, used.

    Documents (doc_id, text) become ids plus end_id and are cut only if longer than a sequence. Pieces are dealt by
    hash to tasks of about items_per_task and packed by best fit in descending size. Bins with at most `slack` ids
    of room are done; the others become the items of the next round, in which each task takes those of fan_in
    tasks, until one task is left. A task hands on at most fan_in bins of each fill (see pack_round), so the last
    task's work is bounded however large the input is, and nothing is lost by it. Only ids, lengths and checksums
    are shuffled, and each round is written to the shared folder.

    Null text is the empty text (one id). Null ids and repeated rows are packed as rows of their own. Ties are
    broken by id, so reruns give the same sequences. Very long texts are cut whole into as many pieces as they need.
    Other columns are ignored. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    items = publish(cut_documents(docs, tokenizer or tokenizer_file(), capacity, end_id), "pieces")
    return pack_pieces(items, capacity, items_per_task, fan_in, slack)


def pack_pieces(items: DataFrame, capacity: int = CAPACITY, items_per_task: int = ITEMS_PER_TASK, fan_in: int = FAN_IN, slack: int = SLACK) -> DataFrame:
    """The packing of pieces (doc_id, piece, start, length, ids_crc32), each at most `capacity` long."""
    columns = [c.split()[0] for c in PIECE.split(", ")]
    full = items.filter(F.col("length") == capacity).select(
        *columns, (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(capacity).cast("long").alias("used")
    )
    short = items.filter(F.col("length") < capacity)
    tasks = max(1, -(-short.count() // items_per_task))
    open_bins = short.withColumns({
        "task": F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(tasks)),
        "from_task": F.lit(0).cast("long"),
        "bin": F.monotonically_increasing_id(),
        "offset": F.lit(0).cast("long"),
        "used": F.col("length"),
        "closed": F.lit(False),
    })
    done, number = full, 0
    while True:
        packed = publish(pack_round(open_bins, capacity, slack, fan_in, tasks == 1), f"bins-{number}")
        # Round, task and bin make the number; full pieces have odd ones.
        sequence = F.shiftleft((F.lit(number) * (1 << 36) + F.col("task")) * (1 << 16) + F.col("bin"), 1)
        done = done.unionByName(packed.filter("closed").select(*columns, sequence.alias("sequence_id"), "offset", "used"))
        if tasks == 1:
            return done
        open_bins = packed.filter("not closed").withColumn("from_task", F.col("task")).withColumn("task", F.floor(F.col("task") / fan_in))
        tasks, number = -(-tasks // fan_in), number + 1

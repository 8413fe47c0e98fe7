"""Items into containers of fixed capacity: cost-balanced packing.

The cost of an item is linear in its words plus quadratic (attention). Items are dealt to shards of bounded size; in a shard,
as many sequences as the words need at least are open, and items in descending order go to the cheapest sequence that has room.
An item above the capacity is cut: full pieces are containers of their own, what is left is an item like others.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from stylomill.functions.text import n_words
from stylomill.session import materialize, spread


def pack(size: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1 / 1024) -> np.ndarray:
    """Sequence of each item; sizes are 0 to capacity. Items without words go to the first sequence."""
    where = np.zeros(len(size), np.int64)
    cost_of = linear * size + quadratic * size.astype(float) ** 2
    room: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    top = np.full(capacity + 1, np.inf)
    n_open = -(-int(size.sum()) // capacity)
    room[capacity] = [(0.0, k) for k in range(n_open)]
    if n_open:
        top[capacity] = 0.0
    for i in np.argsort(-size, kind="stable"):
        w = int(size[i])
        if not w:
            break
        r = w + int(top[w:].argmin())
        if top[r] < np.inf:
            cost, seq = heapq.heappop(room[r])
            top[r] = room[r][0][0] if room[r] else np.inf
        else:
            cost, seq, r = 0.0, n_open, capacity
            n_open += 1
        where[i] = seq
        cost, r = cost + cost_of[i], r - w
        heapq.heappush(room[r], (cost, seq))
        top[r] = room[r][0][0]
    return where


def _shard(capacity: int):
    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_words", "id", "key"], ascending=[False, True, True]).reset_index(drop=True)
        n = pdf["n_words"].to_numpy(np.int64)
        full = np.where(n > capacity, n // capacity, 0)
        rest = n - full * capacity
        item = np.flatnonzero((rest > 0) | (full == 0))
        seq = pack(rest[item], capacity)
        whole = np.repeat(np.arange(len(n)), full)
        piece = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        first = seq.max(initial=-1) + 1
        row = np.concatenate((item, whole))
        out = pd.DataFrame({
            "id": pdf["id"].to_numpy()[row],
            "piece": np.concatenate((full[item], piece)).astype(np.int32),
            "n_pieces": (full + ((rest > 0) | (full == 0)))[row].astype(np.int32),
            "first_word": np.concatenate((full[item], piece)) * capacity,
            "n_words": np.concatenate((rest[item], np.full(len(whole), capacity))),
            "container": (int(pdf["shard"].iloc[0]) << 32) + np.concatenate((seq, first + np.arange(len(whole)))),
        })
        out["source_ids"] = pdf["source_ids"].to_numpy()[row]
        return out

    return place


def pack_segments(segments: DataFrame, capacity: int = 420, shard_size: int = 20_000) -> DataFrame:
    """(id, piece, n_pieces, first_word, n_words, container, source_ids): where each segment, or each piece of one, lies.

    Words are counted in the text (word_count may be wrong); NULL and blank texts have none and take no room. Rows repeated
    with one id and one text are one segment; an id with two texts is two. NULL ids are kept, as a segment each text.
    Container numbers are unique, not dense. No container holds more than the capacity.
    """
    rows = spread(segments.select("id", "text", "source_ids")).select("id", n_words("text").cast("bigint").alias("n_words"), F.xxhash64("text").alias("key"), "source_ids")
    once = rows.groupBy("id", "key").agg(F.max("n_words").alias("n_words"), F.max("source_ids").alias("source_ids"))
    once = materialize(once, "segments")
    shards = max(1, -(-once.count() // shard_size))
    shape = "id bigint, piece int, n_pieces int, first_word bigint, n_words bigint, container bigint, source_ids array<string>"
    return once.withColumn("shard", F.pmod(F.xxhash64("id", "key"), F.lit(shards))).groupBy("shard").applyInPandas(_shard(capacity), shape)


def fill_report(placed: DataFrame, capacity: int = 420) -> DataFrame:
    """One row: containers, words, share of the room that is used, lower bound of containers."""
    used = placed.groupBy("container").agg(F.sum("n_words").alias("w")).where("w > 0")
    return used.agg(F.count("*").alias("n_containers"), F.coalesce(F.sum("w"), F.lit(0)).alias("n_words"), F.max("w").alias("fullest")).select(
        "n_containers", "n_words", "fullest", F.try_divide(F.col("n_words"), F.col("n_containers") * capacity).alias("used"), F.ceil(F.col("n_words") / capacity).alias("least_containers")
    )

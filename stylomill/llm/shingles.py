"""Word shingles as 54-bit integers, computed in numpy for whole batches of texts.

A word is a maximal run of letters and digits, in lower case. A shingle is n successive words of one text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from stylomill.llm.cells import BLOCK, pairs_within
from stylomill.session import materialize

TOKEN = re.compile(r"[^\W_]+|\x00")
#: Texts handled together; the index of a text in its chunk takes the top 10 bits of a sort key.
CHUNK = 512
HASH_BITS = 54
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
#: One odd multiplier for each place in a shingle, from a fixed seed.
_ODD = np.random.default_rng(1).integers(1 << 62, 1 << 63, 64, np.uint64) | np.uint64(1)


class WordHashes(dict):
    """word -> 63-bit hash, remembered; NUL, the mark between texts, is 0. Emptied when it grows past `most` words."""

    def __init__(self, most: int = 1_000_000):
        super().__init__()
        self.most = most
        self["\x00"] = 0

    def __missing__(self, word: str) -> int:
        if len(self) > self.most:
            self.clear()
            self["\x00"] = 0
        h = self[word] = (xxhash.xxh3_64_intdigest(word) >> 1) | 1
        return h


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit multiplicative hash."""
    h = h ^ (h >> np.uint64(31))
    h = h * _MIX[0]
    h = h ^ (h >> np.uint64(29))
    h = h * _MIX[1]
    return h ^ (h >> np.uint64(32))


def tokens(texts: list[str | None], words: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of each word, of all texts in a row."""
    joined = "\x00".join((t or "").replace("\x00", " ") for t in texts).lower()
    found = TOKEN.findall(joined)
    h = np.fromiter(map(words.__getitem__, found), np.int64, len(found)).view(np.uint64)
    mark = h == 0
    at = np.cumsum(mark, dtype=np.int64)
    keep = ~mark
    return h[keep], at[keep]


def windows(h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text index and first word's position of each run of n words inside one text."""
    if len(h) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    m = len(h) - n + 1
    total = np.zeros(m, np.uint64)
    for k in range(n):
        total += h[k : k + m] * _ODD[k]
    inside = np.flatnonzero(at[:m] == at[n - 1 :])
    return mix(total[inside]) >> np.uint64(64 - HASH_BITS), at[inside], inside


def distinct(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ordered by text and hash, with their number of occurrences. Texts: at most 1,024."""
    key = (at.astype(np.uint64) << np.uint64(HASH_BITS)) | h
    key.sort()
    if not len(key):
        return h, at, np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    tf = np.diff(np.concatenate((first, [len(key)])))
    key = key[first]
    return key & np.uint64((1 << HASH_BITS) - 1), (key >> np.uint64(HASH_BITS)).astype(np.int64), tf


def bounds(at: np.ndarray, n: int) -> np.ndarray:
    """Where each of n texts begins in an array ordered by text index; n + 1 numbers."""
    return np.searchsorted(at, np.arange(n + 1))


#: Pairs that are held before they are written; keys that a task sorts before it sends them; keys in a part, about; keys that a
#: part may hold before those of more texts than a block leave it.
_PAIRS, _FLUSH, _PART, _MOST = 2_000_000, 2_000_000, 4_000_000, 12_000_000


def packed_keys(rows: Iterator[tuple[np.ndarray, np.ndarray]], parts: int) -> Iterator[pd.DataFrame]:
    """(part, n, data): keys of texts, in order, for the part that pairs them; few large rows in place of many small ones.

    48 bits of a key are sent, and texts by their place in a list: texts that meet by chance are told apart by verification.
    """
    keys, docs, size = [], [], 0

    def flush() -> pd.DataFrame:
        key, doc = np.concatenate(keys), np.concatenate(docs)
        part, key = (key % np.uint64(parts)).astype(np.int32), mix(key) >> np.uint64(16)
        by = np.lexsort((doc, key, part))
        part, key, doc = part[by], key[by], doc[by]
        cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
        data = []
        for lo, hi in zip(cut[:-1], cut[1:]):
            every, which = np.unique(doc[lo:hi], return_inverse=True)
            planes = np.ascontiguousarray(key[lo:hi]).view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()
            data.append(np.int64(len(every)).tobytes() + every.tobytes() + planes + which.reshape(-1).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())
        return pd.DataFrame({"part": part[cut[:-1]], "n": np.diff(cut).astype(np.int32), "data": data})

    for key, doc in rows:
        keys.append(key)
        docs.append(doc)
        size += len(key)
        if size >= _FLUSH:
            yield flush()
            keys, docs, size = [], [], 0
    if size:
        yield flush()


def _unpacked(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = int(np.frombuffer(data, np.int64, 1)[0])
    every, at = np.frombuffer(data, np.int64, k, 8), 8 + 8 * k
    key = np.zeros((n, 8), np.uint8)
    key[:, :6] = np.frombuffer(data, np.uint8, 6 * n, at).reshape(6, n).T
    which = np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, at + 6 * n).reshape(4, n).T).view("<u4").reshape(n)
    return key.view(np.int64).reshape(n), every[which]


def _all_pairs(key: np.ndarray, doc: np.ndarray) -> Iterator[pd.DataFrame]:
    """(a, b, n): pairs of texts with n keys in common; rows in order of key and text."""
    a, b, size = [], [], 0

    def counted() -> pd.DataFrame:
        x, y = np.concatenate(a), np.concatenate(b)
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        first = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
        return pd.DataFrame({"a": x[first], "b": y[first], "n": np.diff(np.concatenate((first, [len(x)]))), "key": pd.array([None] * len(first), "Int64")})

    near, step = np.arange(len(key)), 0
    while len(near):
        step += 1
        near = near[near + step < len(key)]
        near = near[key[near] == key[near + step]]
        a.append(doc[near])
        b.append(doc[near + step])
        size += len(near)
        if size > _PAIRS:
            yield counted()
            a, b, size = [], [], 0
    if size:
        yield counted()


def _meet(block: int, most: int):
    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held, size = None, [], 0
        hot = np.empty(0, np.int64)  # keys of more texts than a block, of which some have left

        def settle(last: bool) -> Iterator[pd.DataFrame]:
            """Lets the texts of hot keys leave; at the end of a part pairs the others."""
            nonlocal held, size, hot
            key, doc = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))[: len(key)]
            key, doc = key[fresh], doc[fresh]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
            n = np.diff(np.concatenate((first, [len(key)])))
            large = (n > block) | np.isin(key[first], hot)
            hot = np.union1d(hot, key[first[large]])
            leave = np.repeat(large, n)
            if leave.any():
                yield pd.DataFrame({"a": doc[leave], "b": pd.array([None] * int(leave.sum()), "Int64"), "n": 0, "key": pd.array(key[leave], "Int64"), "part": part})
            if last:
                several = np.repeat(n > 1, n) & ~leave
                for pairs in _all_pairs(key[several], doc[several]):
                    yield pairs.assign(part=part)
                held, size, hot = [], 0, np.empty(0, np.int64)
            else:
                held, size = [(key[~leave], doc[~leave])], int((~leave).sum())

        for pdf in batches:
            for p, k, data in zip(pdf["part"], pdf["n"], pdf["data"]):
                if p != part and held:
                    yield from settle(True)
                part = p
                held.append(_unpacked(k, data))
                size += k
                if size > most:
                    yield from settle(False)
        if held:
            yield from settle(True)

    return meet


def parts_for(keys: int, spark) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-keys // _PART))


def pairs_by_key(keys: DataFrame, parts: int, least: int, block: int = BLOCK, most: int = _MOST) -> DataFrame:
    """(a, b), a < b: texts with at least so many keys in common. `keys` are rows of packed_keys; keys of a text may repeat.

    A key of more than `block` texts is dealt to cells: each block of its texts meets each other block, and itself, once.
    """
    order = keys.repartition(parts, "part").sortWithinPartitions("part")
    met = materialize(order.mapInPandas(_meet(block, most), "a bigint, b bigint, n bigint, key bigint, part int"), "met")
    hot = met.where("key IS NOT NULL")
    cells = pairs_within(hot, F.struct("part", "key"), "a", block).select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(1).cast("bigint").alias("n"))
    every = met.where("key IS NULL").select("a", "b", "n").unionByName(cells)
    return every.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("a", "b")

"""Evaluation passages inside training text: Wu-Manber search for many patterns at once, over words.

The patterns are the word triples of the evaluation items. A table says, for each hashed block of two words, how far the
search may move on; only positions with a shift of 0 are looked at, their block's bucket names the patterns that end so, and
each is compared word by word. Cursors of many stretches of text move on together in numpy, each by its own shift. Documents
are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from stylomill.llm import shingles as S
from stylomill.session import materialize, spread

WIDTH = 3
_SHIFT_MOST = WIDTH - 2 + 1
#: Words of a stretch that one cursor searches.
STRETCH = 256
_A, _B = np.int64(0x2545F4914F6CDD1D), np.int64(0x27BB2EE687B0B0FD)


class Patterns:
    """Shift table, suffix buckets and owners of the distinct triples of some items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.words: dict[str, int] = {"\x00": 0}
        rows, self.ids, need = [], [], []
        for item, text in items:
            found = S.TOKEN.findall((text or "").replace("\x00", " ").lower())
            w = np.array([self.words.setdefault(x, len(self.words)) for x in found], np.int64)
            if len(w) < WIDTH:
                continue
            tri = np.unique(np.stack([w[k : len(w) - WIDTH + 1 + k] for k in range(WIDTH)], 1), axis=0)
            rows.append(np.column_stack([tri, np.full(len(tri), len(self.ids))]))
            self.ids.append(item)
            need.append(len(tri))
        every = np.concatenate(rows) if rows else np.empty((0, WIDTH + 1), np.int64)
        self.need = np.array(need, np.int64)
        pattern, which = np.unique(every[:, :WIDTH], axis=0, return_inverse=True) if len(every) else (every[:, :WIDTH], np.empty(0, np.int64))
        self.bits = max(12, int(8 * len(pattern)).bit_length())
        last = self.block(pattern[:, -2], pattern[:, -1]) if len(pattern) else np.empty(0, np.int64)
        order = np.argsort(last, kind="stable")
        self.pattern = pattern[order].astype(np.int32)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.start = np.searchsorted(last[order], np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.shift = np.full(1 << self.bits, _SHIFT_MOST, np.int8)
        for k in range(WIDTH - 1):  # the last block, at shift 0, is written last
            if len(pattern):
                self.shift[self.block(pattern[:, k], pattern[:, k + 1])] = WIDTH - 2 - k
        by = np.argsort(place[which.reshape(-1)], kind="stable")
        self.owner = every[by, WIDTH].astype(np.int32)
        self.owners = np.searchsorted(place[which.reshape(-1)][by], np.arange(len(pattern) + 1))

    def block(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((u * _A + v * _B) >> np.int64(20)) & np.int64((1 << self.bits) - 1)

    def _stops(self, w: np.ndarray) -> np.ndarray:
        """Places whose block of two words ends some pattern; the others are passed by, as far as the shift table says."""
        out = []
        cursor = np.arange(WIDTH - 1, len(w), STRETCH)  # the last word of the window that a cursor looks at
        stop = np.minimum(cursor + STRETCH, len(w))
        while len(cursor):
            u, v = w[cursor - 1], w[cursor]
            shift = np.where(v <= 0, WIDTH, np.where(u <= 0, WIDTH - 1, self.shift[self.block(u, v)]))  # no pattern has a mark or an unknown word
            out.append(cursor[shift == 0] - 1)
            cursor = cursor + np.maximum(shift, 1)
            on = cursor < stop
            cursor, stop = cursor[on], stop[on]
        return np.sort(np.concatenate(out)) if out else np.empty(0, np.int64)

    def search(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text index, item index, number of the item's distinct triples in the text), where there is any."""
        found = S.TOKEN.findall("\x00".join((t or "").replace("\x00", " ") for t in texts).lower())
        w = np.fromiter(map(self.words.get, found, repeat(-1)), np.int64, len(found))
        none = np.empty(0, np.int64)
        if len(w) < WIDTH or not len(self.pattern):
            return none, none, none
        at = np.cumsum(w == 0)
        end = self._stops(w)
        b = self.block(w[end], w[end + 1])
        n = self.start[b + 1] - self.start[b]
        pos = np.repeat(end, n)
        p = np.repeat(self.start[b].astype(np.int64) - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        same = np.ones(len(p), bool)
        for k in range(WIDTH):
            same &= self.pattern[p, k] == w[pos - (WIDTH - 2) + k]
        hit = np.unique((at[pos[same]] << np.int64(40)) | p[same])
        text, p = hit >> np.int64(40), hit & np.int64((1 << 40) - 1)
        n = self.owners[p + 1] - self.owners[p]
        item = self.owner[np.repeat(self.owners[p] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
        text, size = np.repeat(text, n), len(self.ids)
        if len(texts) * size <= 8_000_000:
            count = np.bincount(text * size + item, minlength=1)
            key = np.flatnonzero(count)
            return key // size, key % size, count[key]
        key, count = np.unique(text * size + item, return_counts=True)
        return key // size, key % size, count


def _find(patterns, least: float):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p: Patterns = patterns.value
        ids = np.array(p.ids, np.int64)
        for pdf in batches:
            every, docs = pdf["text"].tolist(), pdf["doc"].to_numpy(np.int64)
            for at in range(0, len(every), S.CHUNK):
                text, item, n = p.search(every[at : at + S.CHUNK])
                ok = n >= np.ceil(least * p.need[item] - 1e-9)
                text, item, n = text[ok], item[ok], n[ok]
                if len(n):
                    yield pd.DataFrame({"item_id": ids[item], "doc_id": docs[at + text], "n_shared": n, "n_item": p.need[item]})

    return find


def leaked_passages(items: DataFrame, docs: DataFrame, least: float = 0.4, doc_col: str = "doc_id", block_chars: int = 32_000_000) -> DataFrame:
    """(item_id, doc_id, n_shared, n_item): the document holds at least that share of the item's distinct word triples.

    Items (item_id, text) come to the driver in blocks of at most `block_chars` characters (one item at least). One block after
    the other is compiled, sent to the executors, searches all documents and is dropped: what is held at once is bounded
    however many items there are. NULL and blank texts, items without a triple and NULL ids are never found; rows repeated in the input are
    found once for each id. No documents or no items: no rows.
    """
    spark = docs.sparkSession
    source = spread(docs.select(docs[doc_col].cast("bigint").alias("doc"), "text").where("doc IS NOT NULL AND text IS NOT NULL"))
    parts, block, size = [], [], 0

    def search(last: bool) -> DataFrame:
        sent = spark.sparkContext.broadcast(Patterns(block))
        found = source.mapInPandas(_find(sent, least), "item_id bigint, doc_id bigint, n_shared bigint, n_item bigint")
        if last and not parts:  # the only block
            return found
        found = materialize(found, "found")
        sent.destroy()
        return found

    for r in items.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct().toLocalIterator():
        if block and size + len(r["text"]) > block_chars:
            parts.append(search(False))
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
    parts.append(search(True))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = out.groupBy("item_id", "doc_id").agg(F.max(F.struct("n_shared", "n_item")).alias("m"))
    return best.select("item_id", "doc_id", "m.n_shared", "m.n_item")

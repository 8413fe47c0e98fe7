"""Near-duplicate texts: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

1. Document frequencies of hashed shingles are counted over all texts (a table of fixed size, whatever the corpus).
2. Each text gets `bands * rows` consistent weighted samples; `rows` samples together are a band key.
3. Texts with two band keys in common are candidates. Rows meet by key, after copies were folded; a key of very many texts is
   dealt to blocks.
4. Candidates are verified with their whole shingle vectors.

Weights lie between 1 and 1 + SPAN. So the weighted likeness of two texts is never less than the plain one divided by 1 + SPAN,
and where the plain one is asked for, it is checked after the weighted one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from stylomill.llm import shingles as S
from stylomill.llm.cells import pairs_within
from stylomill.operators.graph import connected_components
from stylomill.session import materialize, spread

#: Size of the table of document frequencies: a shingle's hash modulo this.
DF_BUCKETS = 1 << 18
_PIECES = 16
#: A shingle weighs 1 + SPAN * idf * (1 - 2 ** -tf), idf from 0 (in every text) to 1, in LEVELS steps.
SPAN, LEVELS = 0.5, 8
#: Bands, of three samples each, where a plain likeness of 0.6 is asked for. Two texts alike by 0.6 whose common shingles are in
#: all texts and whose others are in no other have a weighted likeness of 0.55: fewer than two bands in common once in 500 times.
PLAIN_BANDS = 48
#: Rows of the tables of random draws; a shingle takes r and beta from one row, c from another.
_DRAWS = 1 << 12
#: Shingles that are sampled together; their draws stay in the processor's cache.
_PART = 4096
#: Texts a task remembers so as to leave out copies; after that many it begins anew, and the rest fold after the shuffle.
_SEEN = 500_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
WEIGHTS = 1 + SPAN * (np.arange(LEVELS) + 0.5) / LEVELS


class Sampler:
    """Ioffe's improved consistent weighted sampling, k samples at once; draws come from fixed tables, so no state is sent.

    As weights have few levels, all that depends on a weight, r and beta is computed once for each level and row of draws.
    """

    def __init__(self, k: int, weights: np.ndarray = WEIGHTS, seed: int = 7):
        g = np.random.default_rng(seed)
        self.k = k
        r, beta = g.gamma(2.0, 1.0, (_DRAWS, k)), g.random((_DRAWS, k))
        self.ln_c = np.log(g.gamma(2.0, 1.0, (_DRAWS, k))).astype(np.float32)
        t = np.floor(np.log(weights)[:, None, None] / r + beta)
        self.t = t.astype(np.int16).reshape(-1, k)
        self.ln_yr = (r * (t - beta) + r).astype(np.float32).reshape(-1, k)  # ln a = ln c - ln y - r
        self.room = [np.empty((_PART, k), np.float32) for _ in range(2)]

    def _draw(self, h: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ln a of each shingle and sample, in a buffer that the next call uses again, and the rows of t; at most _PART shingles."""
        low = np.uint64(_DRAWS - 1)
        row = level.astype(np.int64) * _DRAWS + (h & low).astype(np.int64)
        y, a = (x[: len(h)] for x in self.room)
        np.take(self.ln_yr, row, 0, out=y, mode="clip")
        np.take(self.ln_c, ((h >> np.uint64(20)) & low).astype(np.int64), 0, out=a, mode="clip")
        a -= y
        return a, row

    def __call__(self, h: np.ndarray, level: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """One row of k sample hashes for each text with shingles h[begin[i]:begin[i + 1]]; a text must have a shingle."""
        cols, n = np.arange(self.k), len(begin) - 1
        out = np.empty((n, self.k), np.uint64)

        def name(m: np.ndarray, row: np.ndarray, lo: int) -> np.ndarray:
            return h[lo + m] * _GOLD + self.t[row[m], cols].astype(np.int64).view(np.uint64) * _SECOND

        d = 0
        while d < n:
            lo = int(begin[d])
            last = max(d + 1, int(np.searchsorted(begin, lo + _PART, side="right")) - 1)
            hi = int(begin[last])
            if hi - lo <= _PART:
                a, row = self._draw(h[lo:hi], level[lo:hi])
                for k in range(d, last):
                    x = int(begin[k]) - lo
                    out[k] = name(a[x : int(begin[k + 1]) - lo].argmin(0) + x, row, lo)
            else:  # one long text, in parts
                best = np.full(self.k, np.inf, np.float32)
                for at in range(lo, hi, _PART):
                    a, row = self._draw(h[at : min(at + _PART, hi)], level[at : min(at + _PART, hi)])
                    m = a.argmin(0)
                    less = a[m, cols] < best
                    out[d, less] = name(m, row, at)[less]
                    best = np.minimum(best, a[m, cols])
            d = last
        return out


def _count_df(n: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, total, texts = S.WordHashes(), np.zeros(DF_BUCKETS, np.int64), 0
        for pdf in batches:
            texts += len(pdf)
            every = pdf["text"].tolist()
            for at in range(0, len(every), S.CHUNK):
                h, i = S.tokens(every[at : at + S.CHUNK], words)
                w, i, _ = S.windows(h, i, n)
                w, _, _ = S.distinct(w, i)
                total += np.bincount((w % np.uint64(DF_BUCKETS)).astype(np.int64), minlength=DF_BUCKETS)
        if texts:
            size = DF_BUCKETS // _PIECES
            yield pd.DataFrame({"piece": range(_PIECES), "texts": texts, "df": [total[p * size : (p + 1) * size].tobytes() for p in range(_PIECES)]})

    return count


def _add_df(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(x, np.int64) for x in pdf["df"]], axis=0)
    return pd.DataFrame({"piece": [pdf["piece"][0]], "texts": [pdf["texts"].sum()], "df": [total.astype(np.int64).tobytes()]})


def idf(texts: DataFrame, n: int) -> tuple[Broadcast, int]:
    """The idf of each class of shingles, 0 (in all texts) to 1 (in one), from counts over all texts; 1 MB, broadcast. And the number of texts."""
    shape = "piece int, texts bigint, df binary"
    rows = texts.mapInPandas(_count_df(n), shape).groupBy("piece").applyInPandas(_add_df, shape).collect()  # _PIECES rows of fixed size
    df = np.zeros(DF_BUCKETS, np.int64)
    size = DF_BUCKETS // _PIECES
    for r in rows:
        df[r["piece"] * size : (r["piece"] + 1) * size] = np.frombuffer(r["df"], np.int64)
    total = max([r["texts"] for r in rows], default=0)
    factor = np.log((total + 1) / np.clip(df, 1, total + 1)) / np.log(total + 2)
    return texts.sparkSession.sparkContext.broadcast(factor.astype(np.float32)), total


def _levels(h: np.ndarray, tf: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """The level of weight of each shingle."""
    x = factor[h.astype(np.int64) & (DF_BUCKETS - 1)] * (1 - np.exp2(-np.minimum(tf, 30).astype(np.float32)))
    return np.minimum(x * LEVELS, LEVELS - 1).astype(np.uint8)


def _band(n: int, bands: int, rows: int, least_words: int, factors: Broadcast, parts: int):
    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        words, sampler, factor = S.WordHashes(), Sampler(bands * rows), factors.value
        marks = S.mix(np.arange(1, bands + 1, dtype=np.uint64))
        seen: set[int] = set()
        for pdf in batches:
            pdf = pdf.drop_duplicates("doc")
            pdf = pdf[[x not in seen for x in pdf["doc"]]]  # copies leave here, before the shuffle
            seen = set(pdf["doc"]) if len(seen) > _SEEN else seen | set(pdf["doc"])
            every, docs = pdf["text"].tolist(), pdf["doc"].to_numpy(np.int64)
            for at in range(0, len(every), S.CHUNK):
                h, i = S.tokens(every[at : at + S.CHUNK], words)
                size = np.bincount(i, minlength=S.CHUNK)
                w, i, _ = S.windows(h, i, n)
                ok = size[i] >= least_words
                w, i, tf = S.distinct(w[ok], i[ok])
                if not len(w):
                    continue
                begin = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1], [True])))
                got = sampler(w, _levels(w, tf, factor), begin).reshape(len(begin) - 1, bands, rows)
                key = np.broadcast_to(marks, got.shape[:2])
                for k in range(rows):
                    key = S.mix(key * _GOLD + got[:, :, k])
                yield key.reshape(-1), np.repeat(docs[at + i[begin[:-1]]], bands)

    return lambda batches: S.packed_keys(keys(batches), parts)


def _vectors(n: int, factors: Broadcast):
    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, factor = S.WordHashes(), factors.value
        for pdf in batches:
            every = pdf["text"].tolist()
            for at in range(0, len(every), S.CHUNK):
                part = every[at : at + S.CHUNK]
                h, i = S.tokens(part, words)
                w, i, tf = S.distinct(*S.windows(h, i, n)[:2])
                # the level of weight takes the three bits above a shingle's own
                w, b = w | (_levels(w, tf, factor).astype(np.uint64) << np.uint64(S.HASH_BITS)), S.bounds(i, len(part))
                yield pd.DataFrame({"doc": pdf["doc"].iloc[at : at + S.CHUNK].to_numpy(), "sh": [w[x:y].tobytes() for x, y in zip(b[:-1], b[1:])]})

    return vectors


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    only = np.uint64((1 << S.HASH_BITS) - 1)

    def vector(x: bytes) -> tuple[np.ndarray, np.ndarray]:
        v = np.frombuffer(x, np.uint64)
        return v & only, WEIGHTS[(v >> np.uint64(S.HASH_BITS)).astype(np.int64)]

    for pdf in batches:
        like, weighted = np.zeros(len(pdf)), np.zeros(len(pdf))
        for k, (sa, sb) in enumerate(zip(pdf["sh_a"], pdf["sh_b"])):
            (a, wa), (b, wb) = vector(sa), vector(sb)
            _, x, y = np.intersect1d(a, b, assume_unique=True, return_indices=True)  # each is distinct and in order
            least = np.minimum(wa[x], wb[y]).sum()
            like[k] = len(x) / max(1, len(a) + len(b) - len(x))
            weighted[k] = least / max(1e-9, wa.sum() + wb.sum() - least)
        yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "likeness": like, "weighted": weighted})


def similar_texts(texts: DataFrame, n: int = 5, bands: int = 24, rows: int = 3, least_bands: int = 2, least_words: int | None = None, block: int = S.BLOCK) -> DataFrame:
    """(a, b, likeness, weighted): candidate pairs of different texts, a < b, with their plain and weighted Jaccard similarity.

    `texts` has doc BIGINT (equal for equal texts only) and text. A text with fewer than `least_words` (n, unless given) words
    has no partner. Thresholds are the caller's: nothing is dropped here but what shares fewer than `least_bands` bands.
    """
    texts = spread(texts.select("doc", "text").where("text IS NOT NULL"))
    factors, many = idf(texts, n)
    parts = S.parts_for(many * bands, texts.sparkSession)
    keys = texts.mapInPandas(_band(n, bands, rows, least_words or n, factors, parts), "part int, n int, data binary")
    pairs = materialize(S.pairs_by_key(keys, parts, least_bands, block), "candidates")
    need = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    vectors = texts.join(need, "doc", "left_semi").dropDuplicates(["doc"]).mapInPandas(_vectors(n, factors), "doc bigint, sh binary")
    a, b = (vectors.select(F.col("doc").alias(x), F.col("sh").alias(f"sh_{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").mapInPandas(_verify, "a bigint, b bigint, likeness double, weighted double")


def text_key(col: str = "text"):
    """Key of a text: equal texts have it in common."""
    return F.xxhash64(F.col(col))


def near_duplicate_pairs(docs: DataFrame, threshold: float, n: int, least_words: int, id_col: str = "id", bands: int = PLAIN_BANDS, block: int = S.BLOCK) -> DataFrame:
    """(id_a, id_b): every pair of different ids with texts of at least that plain likeness, copies included.

    Pairs are found and verified by the weighted likeness, which is at least threshold / (1 + SPAN) then; the plain one is checked after it.
    NULL ids and texts, and texts of fewer than `least_words` words, are in no pair.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col("text")).where("id IS NOT NULL AND text IS NOT NULL").withColumn("doc", text_key())
    alike = similar_texts(rows, n, bands, least_words=least_words, block=block)
    found = alike.where((F.col("weighted") >= threshold / (1 + SPAN)) & (F.col("likeness") >= threshold)).select("a", "b")
    # a text has least_words words where that many runs of letters and digits follow one another; the search ends there
    enough = F.col("text").rlike(r"(?:[\p{L}\p{N}]+[^\p{L}\p{N}]+){" + str(least_words - 1) + r"}[\p{L}\p{N}]")
    held = rows.select("doc", "id", enough.alias("enough")).distinct()
    # copies of one text: ids with the same key
    copies = pairs_within(held.where("enough"), "doc", "id", block)
    across = found.join(held.select(F.col("doc").alias("a"), F.col("id").alias("x")), "a").join(held.select(F.col("doc").alias("b"), F.col("id").alias("y")), "b").where("x <> y")
    return across.select("x", "y").unionByName(copies).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def near_duplicate_classes(docs: DataFrame, threshold: float = 0.8, n: int = 5, id_col: str = "id") -> DataFrame:
    """(id, class_id, n_links): one row per id; the class is the smallest id linked to it, links are between different texts.

    A link is a weighted Jaccard similarity of at least the threshold over n-word shingles. Equal texts are in one class
    without being compared. NULL and too short texts, and texts with no link, are classes of their own; ids of NULL are dropped.
    An id delivered with several texts belongs to the classes of all of them, which are one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col("text")).where("id IS NOT NULL").withColumn("doc", F.when(F.length(F.trim("text")) > 0, text_key()))
    links = materialize(similar_texts(rows.where("doc IS NOT NULL"), n).where(F.col("weighted") >= threshold).select("a", "b"), "links")
    held = materialize(rows.select("id", "doc").distinct(), "held")
    reps = held.where("doc IS NOT NULL").groupBy("doc").agg(F.min("id").alias("rep"))
    ra, rb = reps.select(F.col("doc").alias("a"), F.col("rep").alias("u")), reps.select(F.col("doc").alias("b"), F.col("rep").alias("v"))
    edges = links.join(ra, "a").join(rb, "b").select("u", "v").unionByName(held.join(reps, "doc").select(F.col("id").alias("u"), F.col("rep").alias("v")))
    comp = connected_components(edges, "u", "v")
    count = links.select(F.explode(F.array("a", "b")).alias("doc")).groupBy("doc").agg(F.count("*").alias("n"))
    degree = held.join(count, "doc", "left").groupBy("id").agg(F.sum(F.coalesce("n", F.lit(0))).cast("bigint").alias("n_links"))
    return degree.join(comp.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("class_id"), "n_links")

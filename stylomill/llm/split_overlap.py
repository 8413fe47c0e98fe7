"""Texts of evaluation splits that come again in the training split: a suffix array over partitioned, concatenated texts.

Suffixes are word sequences. Every suffix of every text is sent to the part of the array that its first three words name, and
sorted there by its first five words. An evaluation suffix beside a training suffix that begins with the same five words lies in
a shared span; spans that touch are merged, so longer ones come out whole, and give each record's coverage.

Runs of suffixes with the same first three words, of both splits, name candidate pairs. A text takes part with those of its
triples that are rarest in the whole corpus, as many as two texts alike by the threshold must have two in common of: in any
fixed order of triples, all but the last `ceil(threshold * n)` of its n, and two more. So no pair is lost, and no boilerplate
that half of the corpus shares makes pairs. A bitmap of each text's triples bounds from above how many two texts can have in
common; what is left is verified over whole texts. Where only pairs are asked for, only suffixes that name pairs are sent.

A prefix of very many suffixes is dealt to several parts of the array: its evaluation suffixes in blocks, each with all that
training has (suffixes that are alike once each); and for pairs each block of one split meets each block of the other once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from stylomill.llm import shingles as S
from stylomill.session import materialize, spread

#: Words of the prefix that names a suffix's part of the array, and words that the order goes by.
PREFIX, DEPTH = 3, 5
#: Triples that two texts must have in common among their rarest ones.
LEAST = 2
#: Suffixes of one prefix that are compared as a block, for pairs and for spans.
PAIR_BLOCK, SPAN_BLOCK = 2048, 1_000_000
#: Suffixes in a part of the array, about; suffixes that a task sorts before it sends them; pairs written at a time.
PART, FLUSH, PAIRS = 2_000_000, 1_000_000, 2_000_000
#: Counters of the corpus's triples, whatever its size; a prefix is called hot only far above what a counter holds by chance.
COUNTERS = 1 << 20
#: Bits of the table that picks candidate texts before they are shuffled: fixed, other texts pass by chance only.
PICK = 1 << 22
#: Texts a task remembers so as to leave out copies; copies beyond fold later.
_SEEN = 500_000
#: Places of a text's bitmap; texts of fewer triples than SIZES have a quarter and a half of them.
BITS, SIZES = 512, (80, 200)
_EVAL, _TRAIN, _RARE, _SPAN, _ONLY = 1, 2, 4, 8, 16
_KEY_BITS, _WORD_BITS = 40, 12
_REST = np.uint64(_WORD_BITS * (DEPTH - PREFIX))
#: A suffix: its order (key, then some bits of each word after it), all bits of those words mixed, text, place and role.
_RECORD = np.dtype([("order", "<u8"), ("rest", "<u4"), ("doc", "<i8"), ("at", "<i4"), ("role", "u1")])
_THREE_WORDS = r"[\p{L}\p{N}][^\p{L}\p{N}]+[\p{L}\p{N}]+[^\p{L}\p{N}]+[\p{L}\p{N}]"


def _fresh(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Texts, keys and sides in chunks, copies of one side left out as far as the task remembers."""
    seen: set[tuple[int, int]] = set()
    for pdf in batches:
        pdf = pdf.drop_duplicates(["doc", "side"])
        mine = list(zip(pdf["doc"], pdf["side"]))
        pdf = pdf[[x not in seen for x in mine]]
        seen = set(mine) if len(seen) > _SEEN else seen | set(mine)
        every, docs, sides = pdf["text"].tolist(), pdf["doc"].to_numpy(np.int64), pdf["side"].to_numpy(np.uint8)
        for at in range(0, len(every), S.CHUNK):
            yield every[at : at + S.CHUNK], docs[at : at + S.CHUNK], sides[at : at + S.CHUNK]


def _bitmaps(w: np.ndarray, i: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text its number of distinct triples, the class of its size, and for each of BITS places whether an odd number falls on it.

    Two texts with x and y triples have at most (x + y - number of places that differ) / 2 in common.
    """
    w, i, _ = S.distinct(w, i)
    size = np.bincount(i, minlength=n)
    odd = np.bincount(i * BITS + ((w >> np.uint64(13)) % np.uint64(BITS)).astype(np.int64), minlength=n * BITS).reshape(n, BITS) & 1
    bits = np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view("<u8")
    return size.astype(np.uint32), np.searchsorted(SIZES, size, side="right").astype(np.uint8), bits


def _fold(bits: np.ndarray) -> np.ndarray:
    """The bitmap of half as many places."""
    half = bits.shape[1] // 2
    return bits[:, :half] ^ bits[:, half:]


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words, total = S.WordHashes(), np.zeros(COUNTERS, np.int64)
    for texts, _, _ in _fresh(batches):
        w, _, _ = S.windows(*S.tokens(texts, words), PREFIX)
        total += np.bincount((w % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
    size = COUNTERS // 16
    if total.any():
        yield pd.DataFrame({"piece": range(16), "n": [total[k * size : (k + 1) * size].tobytes() for k in range(16)]})


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "n": [np.sum([np.frombuffer(x, np.int64) for x in pdf["n"]], axis=0).astype(np.int64).tobytes()]})


def triple_counts(texts: DataFrame) -> np.ndarray:
    """How often each of COUNTERS classes of triples occurs in the corpus."""
    shape, total = "piece int, n binary", np.zeros(COUNTERS, np.int64)
    for r in texts.mapInPandas(_counts, shape).groupBy("piece").applyInPandas(_add, shape).collect():  # 16 rows of fixed size
        size = COUNTERS // 16
        total[r["piece"] * size : (r["piece"] + 1) * size] = np.frombuffer(r["n"], np.int64)
    return total


def _blocks(count: np.ndarray, chance: float, block: int) -> np.ndarray:
    """Blocks that the suffixes of a prefix are dealt to: one, unless far more share it than a counter holds by chance."""
    return np.where(count > 8 * chance + block, -(-count // block), 1)


def _rarest(w: np.ndarray, i: np.ndarray, count: np.ndarray, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of triples with their texts: which take part in pairs (once in a text), and which are their text's only one."""
    order = np.lexsort((w, count, i))
    w, i = w[order], i[order]
    once = np.concatenate(([True], (w[1:] != w[:-1]) | (i[1:] != i[:-1]))) if len(w) else np.zeros(0, bool)
    order, i = order[once], i[once]
    size = np.bincount(i, minlength=n)
    rank = np.arange(len(i)) - (np.cumsum(size) - size)[i]
    take = order[rank < size[i] - np.ceil(threshold * size[i] - 1e-9).astype(np.int64) + LEAST]
    rare = np.zeros(len(once), bool)
    rare[take] = True
    only = np.zeros(len(once), bool)
    only[order[size[i] == 1]] = True
    return rare, only


def _spread_out(x: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices repeated so often, and each repetition's number."""
    rep = np.repeat(x, times)
    return rep, np.arange(len(rep)) - np.repeat(np.cumsum(times) - times, times)


def _suffixes(counts: Broadcast, parts: int, threshold: float, pair_block: int, span_block: int, spans: bool):
    """Rows of (part, data): suffixes of the texts, in order, as records for the part of the array they belong to."""

    def suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, held, texts_of, size = S.WordHashes(), [], [], 0
        table = counts.value
        chance = table.sum() / COUNTERS
        for texts, docs, sides in _fresh(batches):
            h, i = S.tokens(texts, words)
            whole = np.concatenate((h, np.zeros(DEPTH, np.uint64)))
            low = ((whole >> np.uint64(20)) & np.uint64((1 << _WORD_BITS) - 1)) | (whole > 0)  # odd: 0 is no word
            last = np.concatenate((i, np.full(DEPTH, -1)))
            w, j, at = S.windows(h, i, PREFIX)
            if not len(w):
                continue
            order = w & np.uint64((1 << _KEY_BITS) - 1)
            rest = np.zeros(len(w), np.uint64)
            for k in range(PREFIX, DEPTH):
                there = last[at + k] == j
                order = (order << np.uint64(_WORD_BITS)) | np.where(there, low[at + k], np.uint64(0))
                rest = S.mix(rest + np.where(there, whole[at + k], np.uint64(0)))
            count = table[(w % np.uint64(COUNTERS)).astype(np.int64)]
            rare, only = _rarest(w, j, count, len(texts), threshold)
            side, doc = sides[j], docs[j]
            where = at - S.bounds(i, len(texts))[j]
            s_span, s_pair = _blocks(count, chance, span_block), _blocks(count, chance, pair_block)
            apart = s_pair > 1  # pairs of a hot prefix have records of their own
            role = side | np.where(rare & ~apart, _RARE, 0).astype(np.uint8) | np.where(only, _ONLY, 0).astype(np.uint8) | np.uint8(_SPAN * spans)
            texts_of.append((docs, *_bitmaps(w, j, len(texts))))
            block = S.mix(doc.view(np.uint64)) >> np.uint64(8)
            # training suffixes, but for those in pairs, need neither text nor place: alike ones are one
            bare = (side == _TRAIN) & ((role & _RARE) == 0)
            base, n = _spread_out(np.arange(len(w)), np.where(side == _TRAIN, s_span, 1) if spans else (rare & ~apart).astype(np.int64))
            salt = np.where(side[base] == _TRAIN, n, (block[base] % s_span[base].astype(np.uint64)).astype(np.int64))
            rows = [(base, salt, role[base], bare[base])]
            hot = np.flatnonzero(rare & apart)
            if len(hot):
                base, other = _spread_out(hot, s_pair[hot])
                own = (block[base] % s_pair[base].astype(np.uint64)).astype(np.int64)
                e, t = np.where(side[base] == _EVAL, own, other), np.where(side[base] == _EVAL, other, own)
                rows.append((base, 1 + e * s_pair[base] + t, side[base] | np.uint8(_RARE) | (role[base] & np.uint8(_ONLY)), np.zeros(len(base), bool)))
            for base, salt, r, no_text in rows:
                out = np.zeros(len(base), _RECORD)
                out["order"], out["rest"], out["role"] = order[base], rest[base] & np.uint64(0xFFFFFFFF), r
                out["doc"], out["at"] = np.where(no_text, 0, doc[base]), np.where(no_text, 0, where[base])
                part = (S.mix(w[base] + salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(parts)).astype(np.int32)
                held.append((part, out))
                size += len(out)
            if size >= FLUSH:
                yield _flush(held, texts_of)
                held, texts_of, size = [], [], 0
        if held:
            yield _flush(held, texts_of)

    return suffixes


def _flush(held: list[tuple[np.ndarray, np.ndarray]], texts_of: list[tuple]) -> pd.DataFrame:
    part, rows = np.concatenate([p for p, _ in held]), np.concatenate([r for _, r in held])
    table = _texts_table(*(np.concatenate([t[k] for t in texts_of]) for k in range(4)))
    by = np.lexsort((rows["doc"], rows["rest"], rows["order"], part))
    part, rows = part[by], rows[by]
    keep = np.concatenate(([True], (part[1:] != part[:-1]) | (rows[1:] != rows[:-1]))) if len(rows) else np.zeros(0, bool)
    part, rows = part[keep], rows[keep]
    cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(rows) else np.zeros(1, np.int64)
    return pd.DataFrame({"part": part[cut[:-1]], "n": np.diff(cut).astype(np.int32), "data": [_pack(rows[a:b], table) for a, b in zip(cut[:-1], cut[1:])]})


def _texts_table(docs: np.ndarray, size: np.ndarray, level: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
    docs, first = np.unique(docs, return_index=True)
    return docs, size[first], level[first], bits[first]


def _pack(rows: np.ndarray, table: tuple[np.ndarray, ...]) -> bytes:
    """Records column by column, bytes of like weight together, texts by their place in a list: so they compress.

    The list has the texts in pairs with their bitmaps, each folded to its class.
    """
    docs, which = np.unique(rows["doc"], return_inverse=True)
    paired = np.zeros(len(docs), bool)
    paired[which[(rows["role"] & _RARE) > 0]] = True
    at = np.searchsorted(table[0], docs[paired])
    size, level, bits = np.zeros(len(docs), "<u4"), np.full(len(docs), 255, np.uint8), []
    size[paired], level[paired] = table[1][at], table[2][at]
    half = _fold(table[3][at])
    for k, b in enumerate((_fold(half), half, table[3][at])):
        bits.append(np.ascontiguousarray(b[table[2][at] == k]).tobytes())
    columns = [which.reshape(-1).astype("<u4"), *(np.ascontiguousarray(rows[c]) for c in ("order", "rest", "at", "role"))]
    return np.int64(len(docs)).tobytes() + docs.tobytes() + size.tobytes() + level.tobytes() + b"".join(bits) + b"".join(c.view(np.uint8).reshape(len(rows), -1).T.tobytes() for c in columns)


def _unpack(n: int, data: bytes) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """The records, and the texts with sizes, classes and bitmaps (of their class's places, at the front)."""
    out, k = np.empty(n, _RECORD), int(np.frombuffer(data, np.int64, 1)[0])
    at = 8

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(data, kind, count, at)
        at += got.nbytes
        return got

    def column(kind: str) -> np.ndarray:
        size = np.dtype(kind).itemsize
        return np.ascontiguousarray(take("u1", n * size).reshape(size, n).T).view(kind).reshape(n)

    docs, size, level = take("<i8", k), take("<u4", k), take("u1", k)
    bits = np.zeros((k, BITS // 64), "<u8")
    for c in range(3):
        own, wide = level == c, BITS // 64 >> (2 - c)
        bits[own, :wide] = take("<u8", int(own.sum()) * wide).reshape(-1, wide)
    out["doc"] = docs[column("<u4")]
    for c in ("order", "rest", "at", "role"):
        out[c] = column(_RECORD[c].str)
    paired = level < 3
    return out, (docs[paired], size[paired], level[paired], bits[paired])


def _array(threshold: float):
    def array(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each part of the array, put together from its rows: candidate pairs (a, b, n) and places in shared spans (a, places)."""
        held: list[tuple[int, bytes]] = []
        part = None
        for pdf in batches:
            for p, n, data in zip(pdf["part"], pdf["n"], pdf["data"]):
                if p != part and held:
                    yield from _look(held, threshold)
                    held = []
                part = p
                held.append((n, data))
        if held:
            yield from _look(held, threshold)

    return array


class _Bound:
    """Tells which pairs of texts can be alike by the threshold, going by their sizes and bitmaps."""

    def __init__(self, texts: list[tuple[np.ndarray, ...]], threshold: float):
        self.docs, self.size, self.level, bits = _texts_table(*(np.concatenate([t[k] for t in texts]) for k in range(4)))
        self.size, self.share = self.size.astype(np.int64), threshold / (1 + threshold)
        wide = bits.shape[1]
        half, quarter = bits[:, : wide // 2].copy(), bits[:, : wide // 4].copy()
        half[self.level == 2] = _fold(bits[self.level == 2])
        quarter[self.level > 0] = _fold(half[self.level > 0])
        self.bits = (quarter, half, bits)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = np.searchsorted(self.docs, a), np.searchsorted(self.docs, b)
        both, less, level = self.size[x] + self.size[y], np.minimum(self.size[x], self.size[y]), np.minimum(self.level[x], self.level[y])
        apart = np.zeros(len(a), np.int64)
        for k, bits in enumerate(self.bits):
            own = np.flatnonzero(level == k)
            apart[own] = np.bitwise_count(bits[x[own]] ^ bits[y[own]]).sum(1, dtype=np.int64)
        return np.minimum((both - apart) / 2, less) >= self.share * both - 1e-6


def _look(held: list[tuple[int, bytes]], threshold: float) -> Iterator[pd.DataFrame]:
    got = [_unpack(n, d) for n, d in held]
    rows, bound = np.concatenate([r for r, _ in got]), _Bound([t for _, t in got], threshold)
    del got
    rows = rows[np.lexsort((rows["at"], rows["doc"], rows["rest"], rows["order"]))]
    rows = rows[np.concatenate(([True], rows[1:] != rows[:-1]))]
    yield from _spans(rows[(rows["role"] & _SPAN) > 0])
    yield from _pairs(rows[(rows["role"] & _RARE) > 0], bound)


def _spans(rows: np.ndarray) -> Iterator[pd.DataFrame]:
    """Places of evaluation suffixes that begin as an adjacent training suffix does, in as many words as the order goes by."""
    order, rest, n = rows["order"], rows["rest"], len(rows)
    train = (rows["role"] & _TRAIN) > 0
    # the nearest training suffix before and after each suffix in order
    before = np.maximum.accumulate(np.where(train, np.arange(n), -1)) if n else np.empty(0, np.int64)
    after = np.minimum.accumulate(np.where(train, np.arange(n), n)[::-1])[::-1] if n else np.empty(0, np.int64)
    same = np.zeros(n, bool)
    for k, there in ((before, before >= 0), (after, after < n)):
        k = np.clip(k, 0, max(0, n - 1))
        same |= there & (order[k] == order) & (rest[k] == rest)
    whole = (order & np.uint64((1 << _WORD_BITS) - 1)) != 0  # suffixes of fewer words have no five in common
    at = np.flatnonzero(same & whole & ((rows["role"] & _EVAL) > 0))
    if len(at):
        at = at[np.argsort(rows["doc"][at], kind="stable")]
        doc, where = rows["doc"][at], rows["at"][at]
        cut = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1], [True])))
        yield pd.DataFrame({"a": doc[cut[:-1]], "b": pd.array([None] * (len(cut) - 1), "Int64"), "n": np.diff(cut), "places": [where[x:y].astype("<i4").tobytes() for x, y in zip(cut[:-1], cut[1:])]})


def _pairs(rows: np.ndarray, bound: _Bound) -> Iterator[pd.DataFrame]:
    """Pairs of an evaluation and another training text for each prefix that both have among their rarest."""
    key = rows["order"] >> _REST
    rows = rows[np.argsort(key, kind="stable")]
    key = rows["order"] >> _REST
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    ev = (rows["role"] & _EVAL) > 0
    n_all = np.diff(np.concatenate((first, [len(rows)])))
    n_ev = np.add.reduceat(ev.astype(np.int64), first) if len(first) else n_all
    by = np.lexsort((~ev, np.repeat(np.arange(len(first)), n_all)))  # in a run, evaluation suffixes come first
    rows = rows[by]
    n_tr = n_all - n_ev
    runs = np.flatnonzero((n_ev > 0) & (n_tr > 0))
    todo = n_ev[runs] * n_tr[runs]
    upto = np.cumsum(todo)
    at = 0
    while at < len(runs):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
        r = runs[at:end]
        if end == at + 1 and todo[at] > PAIRS:  # one large run, in blocks of its evaluation suffixes
            step = max(1, int(PAIRS // n_tr[r[0]]))
            blocks = [(np.array([first[r[0]] + x]), np.array([min(step, n_ev[r[0]] - x)]), np.array([first[r[0]] + n_ev[r[0]]]), n_tr[r]) for x in range(0, int(n_ev[r[0]]), step)]
        else:
            blocks = [(first[r], n_ev[r], first[r] + n_ev[r], n_tr[r])]
        for e0, ne, t0, nt in blocks:
            run, k = _spread_out(np.arange(len(e0)), ne * nt)
            x, y = rows[e0[run] + k // nt[run]], rows[t0[run] + k % nt[run]]
            ok = (x["doc"] != y["doc"]) & bound(x["doc"], y["doc"])
            x, y = x[ok], y[ok]
            if not len(x):
                continue
            weight = np.where((x["role"] & y["role"] & _ONLY) > 0, LEAST, 1)  # texts of a single triple have one in common at most
            pairs, which = np.unique(np.stack([x["doc"], y["doc"]]), axis=1, return_inverse=True)
            yield pd.DataFrame({"a": pairs[0], "b": pd.array(pairs[1], "Int64"), "n": np.bincount(which.reshape(-1), weight).astype(np.int64), "places": None})
        at = end


def suffix_array(texts: DataFrame, threshold: float, pair_block: int = PAIR_BLOCK, span_block: int = SPAN_BLOCK, spans: bool = True) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b) of texts alike by the threshold, and places in shared spans (doc, places), a row for each part.

    `texts` has doc (key), text and side (1 evaluation, 2 training). Without `spans` the array holds only what names pairs.
    """
    counts = triple_counts(texts)
    parts = max(texts.sparkSession.sparkContext.defaultParallelism, math.ceil(int(counts.sum()) / PART))
    sent = texts.sparkSession.sparkContext.broadcast(counts)  # 8 MB
    rows = texts.mapInPandas(_suffixes(sent, parts, threshold, pair_block, span_block, spans), "part int, n int, data binary").repartition(parts, "part").sortWithinPartitions("part")
    found = materialize(rows.mapInPandas(_array(threshold), "a bigint, b bigint, n bigint, places binary"), "suffixes")
    pairs = found.where("b IS NOT NULL").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).select("a", "b")
    return pairs, found.where("b IS NULL").select(F.col("a").alias("doc"), "places")


def _coverage(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        covered, spans = [], []
        for places in pdf["places"]:
            p = np.unique(np.concatenate([np.frombuffer(x, "<i4") for x in places]))
            step = np.diff(p)
            covered.append(DEPTH + int(np.minimum(step, DEPTH).sum()))
            spans.append(1 + int((step > DEPTH).sum()))
        yield pd.DataFrame({"doc": pdf["doc"], "n_covered": covered, "n_spans": spans})


def span_coverage(places: DataFrame) -> DataFrame:
    """(doc, n_covered, n_spans): words of an evaluation text inside spans it shares with training, touching ones merged."""
    return places.groupBy("doc").agg(F.collect_list("places").alias("places")).mapInPandas(_coverage, "doc bigint, n_covered bigint, n_spans bigint")  # the places of one text


def _triples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words = S.WordHashes()
    for pdf in batches:
        pdf = pdf.drop_duplicates("doc")
        every = pdf["text"].tolist()
        for at in range(0, len(every), S.CHUNK):
            part = every[at : at + S.CHUNK]
            w, i, _ = S.windows(*S.tokens(part, words), 3)
            w, i, _ = S.distinct(w, i)
            b = S.bounds(i, len(part))
            yield pd.DataFrame({"doc": pdf["doc"].iloc[at : at + S.CHUNK].to_numpy(), "sh": [w[x:y].tobytes() for x, y in zip(b[:-1], b[1:])]})


def _likeness(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        like, cover = np.zeros(len(pdf)), np.zeros(len(pdf))
        for k, (x, y) in enumerate(zip(pdf["sh_a"], pdf["sh_b"])):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))  # each is distinct and in order
            like[k], cover[k] = both / max(1, len(x) + len(y) - both), both / max(1, len(x))
        yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "likeness": like, "coverage": cover})


def _picked(texts: DataFrame, need: DataFrame) -> DataFrame:
    """The rows of texts whose doc is in `need`, and by chance some others: by a table of bits of fixed size, without a shuffle."""
    slot = F.pmod(F.xxhash64("doc"), F.lit(PICK))
    words = need.select(slot.alias("s")).groupBy((F.col("s") / 64).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1L, CAST(s % 64 AS INT)))").alias("bits"))
    table = texts.sparkSession.createDataFrame([r for r in words.collect()], "at int, bits bigint")  # at most PICK / 64 rows of two numbers
    rows = texts.withColumn("_s", slot).withColumn("_at", (F.col("_s") / 64).cast("int")).join(F.broadcast(table), F.col("_at") == F.col("at"))
    return rows.where(F.expr("(shiftright(bits, CAST(_s % 64 AS INT)) & 1) = 1")).drop("_s", "_at", "at", "bits")


def text_overlaps(sides: DataFrame, threshold: float, pairs: DataFrame) -> DataFrame:
    """(a, b, likeness, coverage): the candidate pairs whose triples are alike by the threshold, verified over whole texts.

    coverage is the share of a's triples that b holds.
    """
    pairs = materialize(pairs, "candidates")
    need = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    sets = materialize(_picked(sides.select("doc", "text"), need).mapInPandas(_triples, "doc bigint, sh binary").dropDuplicates(["doc"]), "triples")
    a, b = (sets.select(F.col("doc").alias(x), F.col("sh").alias(f"sh_{x}")) for x in "ab")
    found = pairs.join(a, "a").join(b, "b").mapInPandas(_likeness, "a bigint, b bigint, likeness double, coverage double")
    return found.where(F.col("likeness") >= threshold)


def _sides(pairs: DataFrame) -> DataFrame:
    """Both sides of every pair: dataset, split, id, text, doc (the text's key) and side (1 evaluation, 2 training)."""
    both = F.explode(F.array(F.struct(F.col("id0").alias("id"), F.col("text0").alias("text")), F.struct(F.col("id1").alias("id"), F.col("text1").alias("text"))))
    rows = pairs.where("split IN ('train', 'val', 'test')").select("dataset", "split", both.alias("s")).select("dataset", "split", "s.id", "s.text").where("id IS NOT NULL")
    return rows.withColumn("doc", F.xxhash64("text")).withColumn("side", F.when(F.col("split") == "train", _TRAIN).otherwise(_EVAL))


def _held(sides: DataFrame) -> DataFrame:
    """Which record of which dataset and split has which text."""
    wordy = F.coalesce(F.col("text").rlike(_THREE_WORDS), F.lit(False))
    return materialize(sides.select("dataset", "split", "id", "doc", "side", wordy.alias("wordy")).distinct(), "sides")


def _texts(sides: DataFrame) -> DataFrame:
    return spread(sides.where("text IS NOT NULL").select("doc", "text", "side"))


def _overlaps(held: DataFrame, alike: DataFrame) -> DataFrame:
    ev, tr = held.where("side = 1"), held.where("side = 2")
    alike = alike.unionByName(
        # texts that both sides hold, letter for letter
        held.where("wordy").groupBy("doc").agg(F.min("side").alias("lo"), F.max("side").alias("hi")).where("lo < hi").select(F.col("doc").alias("a"), F.col("doc").alias("b"), F.lit(1.0).alias("likeness"), F.lit(1.0).alias("coverage"))
    )
    evals = ev.select("dataset", "split", F.col("id").alias("id_eval"), F.col("doc").alias("a"))
    trains = tr.select(F.col("id").alias("id_train"), F.col("doc").alias("b")).distinct()
    near = alike.join(evals, "a").join(trains, "b").where("id_eval <> id_train")
    texts = near.groupBy("dataset", "split", "id_eval", "id_train").agg(F.max("likeness").alias("likeness"), F.max("coverage").alias("coverage"))
    ids = ev.select("dataset", "split", "id").distinct().join(tr.select("id").distinct(), "id", "left_semi")
    none = F.lit(None).cast("double")
    same = ids.select("dataset", "split", F.col("id").alias("id_eval"), F.col("id").alias("id_train"), none.alias("likeness"), none.alias("coverage"))
    return texts.unionByName(same)


def split_overlaps(pairs: DataFrame, threshold: float = 0.6, pair_block: int = PAIR_BLOCK, span_block: int = SPAN_BLOCK) -> DataFrame:
    """(dataset, split, id_eval, id_train, likeness, coverage): every val or test record that is, or resembles, a train record.

    Records with one id overlap whatever their texts (likeness and coverage NULL); others do by the likeness of their triples.
    NULL ids are in no overlap, NULL texts and texts of under three words only by id; datasets of NULL are kept as they are.
    Repeated rows and swapped sides give one row.
    """
    sides = _sides(pairs)
    texts = _texts(sides)
    candidates, _ = suffix_array(texts, threshold, pair_block, span_block, spans=False)
    return _overlaps(_held(sides), text_overlaps(texts, threshold, candidates))


def overlap_report(pairs: DataFrame, threshold: float = 0.6, pair_block: int = PAIR_BLOCK, span_block: int = SPAN_BLOCK) -> DataFrame:
    """Per dataset and split: val or test records, and how many of them the training split has.

    n_records, n_same_id (a train record has the id), n_near_text (another train record's text is alike by the threshold),
    n_overlapping (either), n_with_spans (some five words in a row stand in training), n_half_covered (half of the words at least lie
    in such spans) and mean_coverage, the mean share of words in such spans. A record of several texts counts with the one most covered.
    """
    sides = _sides(pairs)
    texts, held = _texts(sides), _held(sides)
    candidates, places = suffix_array(texts, threshold, pair_block, span_block)
    hit = _overlaps(held, text_overlaps(texts, threshold, candidates)).groupBy("dataset", "split", "id_eval").agg(F.max((F.col("id_eval") == F.col("id_train")).cast("int")).alias("same"), F.max("likeness").alias("best"))
    found = hit.groupBy("dataset", "split").agg(F.sum("same").alias("n_same_id"), F.count("best").alias("n_near_text"), F.count("*").alias("n_overlapping"))
    size = F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    n_words = sides.where("side = 1").select("dataset", "split", "id", "doc", F.when(F.col("text").isNull(), 0).otherwise(size).alias("n_words")).distinct()
    share = n_words.join(span_coverage(places), "doc", "left").withColumn("share", F.coalesce(F.try_divide("n_covered", "n_words"), F.lit(0.0)))
    record = share.groupBy("dataset", "split", "id").agg(F.max("share").alias("share"))
    total = record.groupBy("dataset", "split").agg(F.count("*").alias("n_records"), F.sum((F.col("share") > 0).cast("int")).alias("n_with_spans"), F.sum((F.col("share") >= 0.5).cast("int")).alias("n_half_covered"), F.round(F.avg("share"), 6).alias("mean_coverage"))
    t, f = total.alias("t"), found.alias("f")
    return t.join(f, (F.col("t.dataset").eqNullSafe(F.col("f.dataset"))) & (F.col("t.split") == F.col("f.split")), "left").select(
        "t.dataset", "t.split", "n_records", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_overlapping", "n_same_id", "n_near_text")), "n_with_spans", "n_half_covered", "mean_coverage"
    )

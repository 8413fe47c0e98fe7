"""One form of texts that look the same: a longest-match transducer over grapheme clusters.

The mapping is compiled once from rules (widths, ligatures and numeral signs, blanks, invisible signs, composed accents) and
from the table of look-alike letters below; compiling checks that no cluster has two images and that images are final.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata as U
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from stylomill.llm.cells import pairs_within
from stylomill.session import spread

# Letters of other scripts, and of phonetic Latin, and the Latin letters of the same shape.
CYRILLIC = dict(zip("ёЁїЇАВЕЅІЈКМНОРСТУХЬаеѕіјорсухһԁԛԝѵӏԌԚԜѴҮӀ", "ëËïÏABESIJKMHOPCTYXbaesijopcyxhdqwvlGQWVYI"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνοϲϳ", "ABEZHIKMNOPTYXvocj"))
ARMENIAN = dict(zip("օսհոՕՍ", "ouhnOU"))
LATIN = dict(zip("ɑɡ", "ag"))
#: Letters with a hook or stroke that no reader takes for b: kept apart.
del CYRILLIC["Ь"]

_MARKS = "̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯"
_PICTURE = "[©®‼-㊙\U0001f000-\U0001faff]"
_SHAPE = re.compile("[Ͱ-ϿЀ-ԯ԰-֏ɑɡ]")
_SCRIPTS = ((CYRILLIC, "Ѐ", "ԯ"), (GREEK, "Ͱ", "Ͽ"), (ARMENIAN, "԰", "֏"))
_WORD = re.compile("[^\\W\\d_]+")


class Transducer:
    """Grapheme clusters to their one form. Longest match: picture sequences, then a base with its marks, then one character."""

    def __init__(self):
        self.one: dict[str, str] = {}
        for cp in range(0x80, sys.maxunicode + 1):
            if 0xD800 <= cp <= 0xDFFF or 0x3400 <= cp <= 0x9FFF or 0xAC00 <= cp <= 0xD7A3:
                continue
            c = chr(cp)
            tag, _, parts = U.decomposition(c).partition(" ")
            if U.category(c) == "Zs":
                self._add(c, " ")
            elif U.category(c) == "Cf" or 0xFE00 <= cp <= 0xFE0F or cp == 0x034F:
                self._add(c, "")
            elif tag in ("<wide>", "<narrow>") or tag == "<compat>" and (0xFB00 <= cp <= 0xFB06 or 0x2160 <= cp <= 0x217F):
                self._add(c, U.normalize("NFKC", c))
        for c in "\u2010\u2011":
            self._add(c, "-")
        self.to_latin = CYRILLIC | GREEK | ARMENIAN | LATIN
        self.from_latin = [{v: k for k, v in reversed(table.items())} for table, _, _ in _SCRIPTS]
        self.shared = {v for table in self.from_latin for v in table} | set(self.to_latin)
        for k, v in self.to_latin.items():
            if not (v.isascii() or v in "ëËïÏ") or v in self.to_latin or self.one.get(k, v) != v:
                raise ValueError(f"{k!r} has two images")
        for k, v in self.one.items():
            if any(self.one.get(x, x) != x for x in v):
                raise ValueError(f"the image of {k!r} isn't final")
        self.cluster = re.compile(f"{_PICTURE}️?(?:‍{_PICTURE}️?)+|.[­​-‍⁠﻿]*[{_MARKS}]+|[^\x00-\x7f]", re.S)
        self.seen: dict[str, str] = {}

    def _add(self, c: str, image: str) -> None:
        if self.one.setdefault(c, image) != image:
            raise ValueError(f"{c!r} has two images")

    def _image(self, m: re.Match) -> str:
        c = m[0]
        found = self.seen.get(c)
        if found is None:
            if len(c) > 1 and "‍" in c and re.match(_PICTURE, c) and c[-1] not in "‍":
                found = c.replace("️", "")
            elif len(c) > 1:
                found = U.normalize("NFC", "".join(self.one.get(x, x) for x in c))
            else:
                found = self.one.get(c, c)
            if len(self.seen) < 100_000:
                self.seen[c] = found
        return found

    def _script(self, m: re.Match) -> str:
        """A word with letters of two scripts, or of look-alikes only, in the script that its other letters show; else Latin."""
        w = m[0]
        if not _SHAPE.search(w):
            return w
        own = [any(lo <= c <= hi and c not in table for c in w) for table, lo, hi in _SCRIPTS]
        latin = any(c not in self.shared and U.name(c, "").startswith("LATIN") for c in w)
        base = "".join(self.to_latin.get(c, c) for c in w)
        if sum(own) == 1 and not latin:
            back = self.from_latin[own.index(True)]
            return "".join(back.get(c, c) for c in base)
        return base if latin or not any(own) else w

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text.strip()
        out = self.cluster.sub(self._image, text)
        if not out.isascii():
            out = U.normalize("NFC", out)
            if _SHAPE.search(out):
                out = _WORD.sub(self._script, out)
        return out.strip()


@lru_cache(1)
def transducer() -> Transducer:
    return Transducer()


def _canonical(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    t = transducer()
    for pdf in batches:
        yield pdf.assign(canonical=[x if x is None else t(x) for x in pdf["text"]])[["doc", "canonical"]]


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    t, h = transducer(), lambda x: hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    for pdf in batches:
        forms = [t(x) for x in pdf["text"]]
        out = pd.DataFrame({"doc": pdf["doc"], "look": [h(x) for x in forms], "raw": [h(x) for x in pdf["text"]]})
        yield out[[bool(x) for x in forms]]


def canonical_texts(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, canonical): each row's text in its one form. NULL stays NULL, blank becomes empty; rows are kept as they are."""
    rows = spread(docs.select(F.col(id_col).alias("doc"), "text"))
    return rows.mapInPandas(_canonical, "doc bigint, canonical string").withColumnRenamed("doc", id_col)


def look_alike_pairs(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: non-blank texts with one form but different code points.

    Only ids and two 128-bit digests are shuffled; forms that occur with one spelling leave at the first aggregate. NULL ids and
    texts are in no pair, an id with several texts is in the pairs of each, never with itself.
    """
    rows = spread(docs.select(F.col(id_col).alias("doc"), "text").where(f"{id_col} IS NOT NULL AND text IS NOT NULL"))
    keys = rows.mapInPandas(_keys, "doc bigint, look binary, raw binary").distinct()
    several = keys.groupBy("look").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("look")
    kept = keys.join(several, "look", "left_semi")
    met = pairs_within(kept, "look", F.struct("doc", "raw"))
    return met.where("x.doc <> y.doc AND x.raw <> y.raw").select(F.col("x.doc").alias("doc_a"), F.col("y.doc").alias("doc_b")).distinct()

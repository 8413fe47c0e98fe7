"""Personal details in free text: found by a conditional random field over word-shape features and masked.

The labelled table is small and made here (carriers.py): sentences with places for details, filled with invented values. Every
token of every text is decoded, and the model decides what is a detail. Given names taken from the corpus's own author column
are one feature among others; no list lets a name in or keeps it out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from stylomill.llm import carriers as C
from stylomill.llm.crf import KINDS, PARTICLES, STREETS, Base, Crf
from stylomill.session import spread

#: Characters of texts that are decoded together.
BATCH = 400_000


class _Maker:
    """Fills carriers with invented values."""

    SLOT = re.compile(r"\{(\w+)\}")

    def __init__(self, seed: int):
        self.g = np.random.default_rng(seed)
        self.kinds = {"E": ("email", self.email), "P": ("phone", self.phone), "I": ("id_number", self.id_number), "A": ("address", self.address), "N": ("name", self.name)}
        self.others = {
            "M": lambda: self.one(C.GIVEN).title() + " " + self.family(), "F": lambda: self.one(C.GIVEN).title(), "f": lambda: self.one(C.GIVEN), "L": self.foreign, "T": self.town, "G": self.body, "R": self.street, "h": self.handle,
            "B": lambda: self.cased(self.one(C.THINGS) + self.one(C.THING_ENDS)), "Z": self.thing_number, "K": lambda: f"{self.street()} {self.one(C.STREET_KINDS)}", "c": lambda: self.one(C.NOUNS), "v": lambda: self.one(C.VERBS), "a": lambda: self.one(C.ADJECTIVES), "y": lambda: self.one(C.ADVERBS), "w": lambda: self.one(C.DAYS),
            "k": lambda: self.one([f"{int(self.g.integers(1, 60))},{self.digits(3)}", str(int(self.g.integers(2, 99))), self.digits(4)]), "X": lambda: "".join(self.one("ABCDEFGHJKLMNPRSTUVWXYZ") for _ in range(int(self.g.integers(1, 4)))),
        }

    def one(self, x):
        return x[int(self.g.integers(len(x)))]

    def chance(self, p: float) -> bool:
        return self.g.random() < p

    def digits(self, n: int) -> str:
        return "".join(map(str, self.g.integers(0, 10, n)))

    def family(self) -> str:
        f = (self.one(C.FAMILY_A) + self.one(C.FAMILY_B)).title()
        f = f"Mc{f}" if self.chance(0.03) else f"O’{f}" if self.chance(0.03) else f"O'{f}" if self.chance(0.02) else f
        return f + ("-" + (self.one(C.FAMILY_A) + self.one(C.FAMILY_B)).title() if self.chance(0.1) else "")

    def name(self) -> str:
        first = self.one(C.GIVEN).title() + ("-" + self.one(C.GIVEN).title() if self.chance(0.1) else "")
        known = not self.chance(0.55)
        if not known:
            first = (self.one(C.FIRST_A) + self.one(C.FIRST_B)).title() if self.chance(0.75) else self.one("ABCDEFGHJKLMNPRSTUVWXZ") + "."
        mid = self.g.random()
        mid = f" {self.one('ABCDEFGHJKLMNPRSTUVWXZ')}." if mid < 0.18 else f" {self.one(['van', 'de', 'von', 'van der', 'della', 'bin', 'al'])}" if mid < 0.25 else f" {self.one(C.GIVEN).title()}" if mid < 0.28 else ""
        n = first + mid + (" " if self.chance(0.95) else "  ") + self.family()
        c = self.g.random()
        return n.upper() if c < 0.1 else n.lower() if c < 0.2 and known else n

    def email(self) -> str:
        a, b = self.one(C.GIVEN), self.one(C.FAMILY_A) + self.one(C.FAMILY_B)
        local = self.one([a + self.one([".", "_", "-", ""]) + b, a[0] + b, b + "." + a[0], a + self.digits(2), self.one(C.NOUNS), self.one(["info", "desk", "news", "office", "hello"])])
        local += (self.digits(2) if self.chance(0.25) else "") + ("+" + self.one(C.NOUNS) if self.chance(0.12) else "")
        host = self.one([self.one(C.NOUNS), f"{self.one(C.NOUNS)}-{self.one(C.NOUNS)}", f"mail.{self.one(C.FAMILY_A)}{self.one(C.FAMILY_B)}", self.one(C.FIRST_A) + self.one(C.FIRST_B)])
        host += "." + self.one(["example", "test", "invalid", "org", "com", "net", "co.uk", "de"])
        if self.chance(0.22):
            l, r = self.one(["()", "[]", "()", "{}"])
            host = host.replace(".", f" {l}dot{r} ") if self.chance(0.6) else host
            e = f"{local} {l}at{r} {host}"
        else:
            e = f"{local}@{host}"
        return e.upper() if self.chance(0.1) else e

    def phone(self) -> str:
        d = self.digits
        v = self.one([
            lambda: f"0{d(4)} {d(6)}", lambda: f"0{d(4)}-{d(3)}-{d(3)}", lambda: f"0{d(3)}-{d(3)}-{d(4)}", lambda: f"+{d(12)}", lambda: f"+44 ({d(2)}) {d(4)} {d(4)}", lambda: f"(0{d(4)}) {d(6)}", lambda: f"(0{d(4)}) {d(3)} {d(3)}", lambda: f"020 {d(4)} {d(4)}", lambda: f"020-{d(4)}-{d(4)}", lambda: f"+44 (0){d(2)} {d(4)} {d(4)}", lambda: f"+44 {d(2)} {d(4)} {d(4)}",
            lambda: f"+447{d(9)}", lambda: f"07{d(3)} {d(6)}", lambda: f"07{d(9)}", lambda: f"0044 {d(4)} {d(3)} {d(3)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}",
            lambda: f"+1 {d(3)} {d(3)} {d(4)}", lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}", lambda: f"+49 {d(2)} {d(5)} {d(3)}", lambda: f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"0{d(3)} {d(3)} {d(4)}", lambda: f"+{d(2)} {d(3)} {d(6)}", lambda: f"+1-{d(3)}-{d(3)}-{d(4)}",
            lambda: f"0{d(2)}/{d(7)}", lambda: f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}",
        ])()
        return v.replace("-", self.one("–‑")) if self.chance(0.15) else v

    def id_number(self) -> str:
        d, x = self.digits, lambda: self.one("ABCEGHJKLMNPRSTWXYZ")
        return self.one([
            lambda: f"{x()}{x()} {d(2)} {d(2)} {d(2)} {self.one('ABCD')}", lambda: f"{x()}{x()}{d(6)}{self.one('ABCD')}", lambda: f"QQ {d(2)} {d(2)} {d(2)} {self.one('ABCD')}", lambda: f"QQ{d(6)}{self.one('ABCD')}",
            lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{d(3)} {d(2)} {d(4)}", lambda: f"{x()}{d(8)}", lambda: f"{x()}{d(7)}{x()}", lambda: f"{x()}{x()}{d(7)}", lambda: f"{d(9)}",
        ])()

    def address(self) -> str:
        n = str(int(self.g.integers(1, self.one([10, 100, 450, 450])))) + (self.one("abcABC") if self.chance(0.2) else "")
        unit = f"{self.one(['Flat', 'Apt', 'Apt.', 'Unit', 'Suite', 'Apartment'])} {int(self.g.integers(1, 45))}" + (self.one("ABC") if self.chance(0.2) else "")
        a = f"{n} {self.street()} {self.one(C.STREET_KINDS)}"
        c = self.g.random()
        a = f"{unit}, {a}" if c < 0.17 else f"{a}, {unit}" if c < 0.38 else f"{a} {unit}" if c < 0.41 else a
        return a.lower() if self.chance(0.2) else a.upper() if self.chance(0.04) else a

    def street(self) -> str:
        first = self.one(C.STREETS_OF) if self.chance(0.7) else (self.one(C.FAMILY_A) + self.one(C.FAMILY_B)).title()
        return first + (f" {self.one(C.STREET_ENDS)}" if self.chance(0.3) else "")

    def town(self) -> str:
        return self.one(C.PLACE_FIRST) + (self.one(C.FAMILY_A) + self.one(C.PLACE_END)).title()

    def body(self) -> str:
        first = self.one([lambda: self.one(C.ORG_FIRST), self.town, lambda: f"{self.town()} {self.one(C.ORG_FIRST)}", lambda: self.one(C.NOUNS).title()])()
        return f"{first} {self.one(C.ORGS)}"

    def cased(self, words: str) -> str:
        return words if self.chance(0.5) else words[0].upper() + words[1:]

    def thing_number(self) -> str:
        d, x = self.digits, self.others["X"]
        groups = lambda sep: sep.join(d(int(n)) for n in self.g.integers(2, 6, int(self.g.integers(2, 5))))
        return self.one([
            lambda: groups(" "), lambda: groups(" "), lambda: groups("-"), lambda: groups("-"), lambda: groups(self.one("./–")),
            lambda: d(int(self.g.integers(4, 14))), lambda: f"{d(4)}-{d(4)}", lambda: f"{d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(3)}", lambda: f"{d(4)} {d(4)} {d(4)}", lambda: f"{d(4)} {d(4)}", lambda: f"{d(2)}-{d(4)}-{d(4)}",
            lambda: f"{x()}{d(6)}", lambda: f"{x()}-{d(4)}-{d(2)}", lambda: f"{x()}{d(4)}{x()}", lambda: f"{d(2)}/{d(6)}", lambda: f"{d(3)}.{d(3)}.{d(3)}", lambda: f"{d(3)} {d(3)} {d(3)}", lambda: f"{x()} {d(5)}", lambda: f"{d(6)}/{d(2)}", lambda: f"#{d(6)}",
            lambda: f"97{self.one('89')}-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"{d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"{d(5)}-{d(3)}", lambda: f"{d(1)}.{d(4)}/{d(4)}.{d(5)}", lambda: f"{d(4)}-{d(4)}-{d(4)}-{d(4)}",
        ])()

    def foreign(self) -> str:
        words = self.one(C.OTHER_LANGUAGES)
        text = " ".join(self.one(words) for _ in range(int(self.g.integers(4, 14))))
        return (text[0].upper() + text[1:] if self.chance(0.5) else text) + self.one(["", ".", ".", "!", "?"])

    def handle(self) -> str:
        return self.one(C.GIVEN) + self.one(["_", "_", "", "."]).replace(".", "x") + self.one([*C.FAMILY_A, *C.NOUNS]) + self.one(["", "", self.digits(2)])

    def fill(self, carrier: str) -> tuple[str, list[tuple[int, int, str]]]:
        text, spans, at = "", [], 0
        # some of a carrier's words give way to others, so that the model doesn't lean on them
        carrier = re.sub(r"(?<![{\w])[a-z]{3,}\b(?!})", lambda m: self.one(C.NOUNS) if self.chance(0.12) else m[0], carrier)
        for m in self.SLOT.finditer(carrier):
            text, at, k = text + carrier[at : m.start()], m.end(), m[1]
            if k[0] == "d" and len(k) > 1:
                text += self.digits(int(k[1:]))
            elif k in self.others:
                text += self.others[k]()
            else:
                kind, make = self.kinds[k]
                v = make()
                if v.endswith(".") and carrier[at : at + 1] == ".":
                    v = v[:-1]
                spans.append((len(text), len(text) + len(v), kind))
                text += v
        text += carrier[at:]
        if self.chance(0.4) and text[:1].islower() and not (spans and spans[0][0] == 0):
            text = text[0].upper() + text[1:]
        elif self.chance(0.06) and not any(k == "name" for _, _, k in spans):
            text = text.lower()
        return text, spans


def _lines(block: str) -> list[str]:
    return [x for x in block.split("\n") if x.strip()]


def labelled_table(seed: int = 17, copies: int = 24, keep=lambda k: True) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, spans with kinds): carriers filled several times, some joined, some as cells of a line or a block.

    `keep` says by its number whether a carrier with details is used, so that tests can hold some out.
    """
    mk = _Maker(seed)
    kinds = [[x for k, x in enumerate(_lines(b)) if keep(k)] for b in (C.EMAIL, C.PHONE, C.ID, C.ADDRESS, C.NAME)]
    plain = [*_lines(C.NUMBERS), *_lines(C.NOT_PEOPLE)]
    rows = []

    def join(parts: list[tuple[str, str]]) -> None:
        text, spans = "", []
        for gap, carrier in parts:
            t, sp = mk.fill(carrier)
            gap = gap if text else ""
            spans += [(a + len(text) + len(gap), b + len(text) + len(gap), k) for a, b, k in sp]
            text += gap + t
        rows.append((text, spans))

    for _ in range(copies):
        every = [*sum(kinds, []), *plain, *plain, *_lines(C.NOT_PEOPLE)]
        every = [every[i] for i in mk.g.permutation(len(every))]
        at = 0
        while at < len(every):
            n = int(mk.g.integers(1, 5))
            join([(mk.one([" ", " ", " ", " ", "\n", "\n\n", " – "]), x) for x in every[at : at + n]])
            at += n
        for _ in range(60):
            sep = mk.one(["\n", "\n", " | ", " / ", ", ", "; ", " · "])
            cells = [C.CELLS[i] for i in mk.g.choice(len(C.CELLS), int(mk.g.integers(2, 5)), replace=False)]
            join([("", mk.one(plain)), (mk.one(["\n\n", "\n", " "]), cells[0]), *((sep, x) for x in cells[1:])])
    return rows


def context_words(least: int = 3) -> list[str]:
    """Words that at least so many carriers have beside their slots."""
    seen: Counter = Counter()
    for block in (C.EMAIL, C.PHONE, C.ID, C.ADDRESS, C.NAME, C.NUMBERS, C.NOT_PEOPLE):
        for x in _lines(block):
            seen.update({w.lower() for w in re.findall(r"[^\W\d_]+", _Maker.SLOT.sub(" ", x))})
    return [w for w, n in seen.items() if n >= least]


@lru_cache(4)
def trained(seed: int = 17, held_out: int | None = None) -> Crf:
    """The model, fitted once in a process; the same on every machine. Its given names are replaced for decoding.

    With `held_out`, every fifth carrier with details, from that one on, is left out of the training.
    """
    rows = labelled_table(seed, keep=lambda k: held_out is None or k % 5 != held_out)
    return Crf(Base([*context_words(), "at", "dot"], C.GIVEN)).fit([t for t, _ in rows], [s for _, s in rows])


class NameTable:
    """Hashed words in a bitmap of fixed size: which first words author names have. Another word is in it by chance only."""

    SLOTS = 1 << 22

    def __init__(self, bits: np.ndarray | None = None):
        self.bits = np.zeros(self.SLOTS // 64, np.uint64) if bits is None else bits

    def __contains__(self, word: str) -> bool:
        slot = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 42) % self.SLOTS  # as Spark's xxhash64
        return bool(int(self.bits[slot // 64]) >> (slot % 64) & 1)


class Finder:
    """Details in batches of texts; every token is decoded."""

    def __init__(self, crf: Crf, given: NameTable | frozenset[str]):
        self.crf = crf
        crf.base.given = given
        crf.forget()

    def __call__(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        t = self.crf.tokens(texts)
        label = self.crf.labels(t)
        text, begin, end = (x[t.real] for x in (t.text, t.begin, t.end))
        first = np.flatnonzero((label > 0) & (label % 2 == 1))
        goes_on = (label > 0) & (label % 2 == 0)  # I labels follow only their own kind
        stop = np.flatnonzero(np.concatenate((~goes_on, [True])))
        last = stop[np.searchsorted(stop, first, side="right")] - 1 if len(first) else first
        for b, e in zip(first, last):
            k = int(text[b])
            out[k] += tidy(texts[k], int(begin[b]), int(end[e]), KINDS[(int(label[b]) - 1) // 2])
        return out


_NAME_CHARS = re.compile(r"[^\W\d_]")
_LEAD = re.compile(r"^[\s<(\[\"“'‘:;,.|/-]+")
_TRAIL = re.compile(r"[\s>\"”'’:;,.!?|/\])-]+$")
_MAIL = re.compile(r"[\w.+-]*\w(?:@|\s?[(\[{]\s?at\s?[)\]}]\s?)[\w-]+(?:(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?)[\w-]+)+", re.I)
_SENTENCE_END = re.compile(r"[!?;:,\n]|(?<=[^\W\d_]{3})\.")
_SMALL_END = re.compile(r"\s+([a-zß-öø-ÿ]+)$")
_INITIALS = re.compile(r"(?:[^\W\d_]\.)+")
_BOOK = re.compile(r"\bISBN\W*[\d-]*$", re.I)
_UNIT = r"(?:flat|apt\.?|apartment|unit|suite|room|floor)\s*#?\d+[a-z]?\b"
#: From unit or house number to the street word, with the point of a short one if the sentence goes on, or to the unit.
_PLACE = re.compile(
    rf"(?:{_UNIT},?\s+)?(?<![\w.-])\d+(?:[a-z]\b|-\d+\b)?,?\s+(?:[^\W\d_][\w’'-]*\.?[^\S\n]+){{1,5}}(?:" + "|".join(sorted(STREETS, key=lambda x: (-len(x), x)))
    + r")(?![\w’'-])(?:(?<=\bst)\.|(?<=\b(?:rd|ln|dr|ct|pl))\.(?=\s*(?:[a-z,|/\n]|$))|(?<=\b(?:ave))\.(?=\s*(?:[a-z,|/\n]|$))|(?<=\bblvd)\.(?=\s*(?:[a-z,|/\n]|$)))?(?:,?\s+" + _UNIT + ")?",
    re.I,
)


def tidy(text: str, lo: int, hi: int, kind: str) -> list[tuple[int, int, str]]:
    """The exact spans: without enclosing signs, and only if they have what their kind must have."""
    if kind == "email":
        found = [(lo + m.start(), lo + m.end(), kind) for m in _MAIL.finditer(text[lo : hi + 60]) if m.start() < hi - lo]
        return found
    if kind == "address":
        return [(lo + m.start(), lo + m.end(), kind) for m in _PLACE.finditer(text[lo : hi + 1])]
    if kind == "id_number":  # a code is never cut
        while lo and text[lo - 1].isalnum():
            lo -= 1
        while hi < len(text) and text[hi].isalnum():
            hi += 1
    if kind == "phone":
        while lo and text[lo - 1] in "+(":
            lo -= 1
        s = text[lo:hi]
        if s.startswith("(") and s.count("(") > s.count(")"):
            lo += 1
    else:
        m = _LEAD.match(text[lo:hi])
        lo += m.end() if m else 0
    m = _TRAIL.search(text[lo:hi])
    hi -= len(m.group()) if m else 0
    if kind == "name":
        m = _SENTENCE_END.search(text[lo:hi])
        hi = lo + m.start() if m else hi
        while not text[lo:hi].islower() and (m := _SMALL_END.search(text[lo:hi])) and m[1] not in PARTICLES:
            hi = lo + m.start()
    s = text[lo:hi]
    digits = sum(c.isdigit() for c in s)
    if kind == "phone":
        ok = 7 <= digits <= 15 and "," not in s and not _BOOK.search(text[max(0, lo - 20) : lo])
    elif kind == "id_number":
        ok = 6 <= digits <= 12
    else:
        parts = s.split()
        ok = 2 <= len(parts) <= 5 and not digits and "_" not in s and text[lo - 1 : lo] not in ("@", "#") and all(_NAME_CHARS.search(x) for x in parts) and len(parts[-1]) > 1 and not any(x[-1] in ".!?,;:" and len(x) > 3 and not _INITIALS.fullmatch(x) for x in parts[:-1])
    return [(lo, hi, kind)] if ok else []


def given_names(docs: DataFrame, column: str = "author") -> NameTable:
    """The first words of all author names of two words or more, in lower case, in a bitmap of 512 KB."""
    first = F.lower(F.regexp_extract(F.coalesce(F.col(column), F.lit("")), r"^\s*(\p{L}+)\s+\S", 1))
    slot = F.pmod(F.xxhash64("w"), F.lit(NameTable.SLOTS))
    words = docs.select(first.alias("w")).where("w <> ''").select(slot.alias("s")).groupBy((F.col("s") / 64).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1L, CAST(s % 64 AS INT)))").alias("bits"))
    table = NameTable()
    for r in words.collect():  # at most SLOTS / 64 rows of two numbers
        table.bits[r["at"]] = r["bits"] & ((1 << 64) - 1)
    return table


def _find(model, masked: bool):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(*model.value)
        for pdf in batches:
            every, ids = pdf["text"].tolist(), pdf["id"].tolist()
            size = np.cumsum([len(x or "") + 50 for x in every])
            lo = 0
            while lo < len(every):
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + BATCH)))
                part = every[lo:hi]
                found = finder([x or "" for x in part])
                if masked:
                    yield pd.DataFrame({"id": ids[lo:hi], "masked": [x if x is None else mask(x, f) for x, f in zip(part, found)], "n_items": [len(f) for f in found]})
                else:
                    rows = [(i, k, x[a:b]) for i, x, f in zip(ids[lo:hi], part, found) for a, b, k in f]
                    if rows:
                        yield pd.DataFrame(rows, columns=["id", "kind", "found_text"])
                lo = hi

    return find


def mask(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with <KIND> in place of each detail."""
    out, at = [], 0
    for lo, hi, kind in sorted(found):
        if lo >= at:
            out += [text[at:lo], f"<{kind.upper()}>"]
            at = hi
    return "".join([*out, text[at:]])


def _model(docs: DataFrame):
    """The fitted model and the table of given names, sent to the executors: weights of some 700 features, and 512 KB."""
    names = given_names(docs) if "author" in docs.columns else NameTable()
    return docs.sparkSession.sparkContext.broadcast((trained(), names))


def personal_items(docs: DataFrame) -> DataFrame:
    """(id, kind, found_text), distinct: every detail in the texts, as written. NULL and blank texts have none."""
    rows = spread(docs.select("id", "text").where("text IS NOT NULL"))
    return rows.mapInPandas(_find(_model(docs), False), "id bigint, kind string, found_text string").distinct()


def masked_texts(docs: DataFrame) -> DataFrame:
    """(id, masked, n_items): each row's text with placeholders for details; rows are kept as they are, NULL stays NULL."""
    return spread(docs.select("id", "text")).mapInPandas(_find(_model(docs), True), "id bigint, masked string, n_items int")

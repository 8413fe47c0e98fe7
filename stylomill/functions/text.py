"""Scalar text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The 29 code points that count as blanks between words.
BLANKS = r"\u0009-\u000D\u001C-\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028-\u2029\u202F\u205F\u3000"
WS = f"[{BLANKS}]+"
NOT_WS = f"[^{BLANKS}]+"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: str | Column) -> Column:
    """The words between blanks; NULL has none."""
    return F.coalesce(F.filter(F.split(col(text), WS), lambda x: x != ""), F.array().cast("array<string>"))


def n_words(text: str | Column) -> Column:
    """Number of words; NULL and blank texts have 0. A word begins where the text or a blank ends."""
    return F.coalesce(F.regexp_count(col(text), F.lit(NOT_WS)), F.lit(0)).cast("int")


def squash(text: str | Column) -> Column:
    """Words joined by single blanks; NULL is the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), WS, " "))


def name_key(name: str | Column) -> Column:
    """A name in lower case, trimmed, with single blanks; NULL if nothing is left."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(col(name), WS, " "))), F.lit(""))


# Patterns and punctuation of the corpus's cleaning rules.
PUNCTUATION_OR_SYMBOL = r"[.,!?:;\-–—…“”‘’()\[\]]|\p{So}"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
URL = r"(?i)(?:https?://|www\.)\S+"
MENTION = r"@([A-Za-z0-9_]{1,15})"
NEEDS_MASK = r"(?i)@|https?://|www\.|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def trim_words(text: str | Column, most: int | None) -> Column:
    """The first `most` words joined by blanks; the text as it is if `most` is none or not positive."""
    return F.array_join(F.slice(words(text), 1, most), " ") if most and most > 0 else col(text)


def marks(text: str | Column) -> Column:
    """Punctuation marks and symbols in order of the text; NULL has none."""
    return F.coalesce(F.regexp_extract_all(col(text), F.lit(PUNCTUATION_OR_SYMBOL), F.lit(0)), F.array().cast("array<string>"))


def ngrams(items: Column, most: int) -> Column:
    """All runs of 1 to `most` items, each joined by '|', with repeats."""
    every = [items]
    for n in range(2, most + 1):
        size = F.greatest(F.size(items) - (n - 1), F.lit(0))
        every.append(F.zip_with(F.slice(every[-1], F.lit(1), size), F.slice(items, F.lit(n), size), lambda a, b: F.concat(a, F.lit("|"), b)))
    return F.flatten(F.array(*every))


def strip_symbols(text: str | Column, instead: str = "") -> Column:
    """Without control, format, unassigned and symbol characters; line ends go too, with nothing in their place by default."""
    return F.regexp_replace(col(text), r"[\p{C}\p{So}]", instead)


def english_share(text: str | Column) -> Column:
    """Share of a text's letters that are ASCII (with the two that lower to ASCII); NULL without letters."""
    letters = F.length(F.regexp_replace(col(text), r"[^\p{L}]", ""))
    return F.length(F.regexp_replace(col(text), "[^A-Za-z\\u0130\\u212A]", "")) / F.nullif(letters, F.lit(0))


def mask_handles(text: str | Column) -> Column:
    """E-mails and links as <EMAIL> and <URL>; mentions as USER_n, n the order of first appearance, letter case aside.

    A mention is at most 15 characters; what is longer leaves its tail.
    """
    t = F.regexp_replace(F.regexp_replace(col(text), EMAIL, "<EMAIL>"), URL, "<URL>")
    parts = F.split(t, r"(?=@[A-Za-z0-9_])")
    who = lambda p: F.lower(F.regexp_extract(p, "^" + MENTION, 1))
    users = F.array_distinct(F.filter(F.transform(parts, who), lambda u: u != ""))
    one = lambda p: F.when(who(p) != "", F.concat(F.lit("USER_"), F.array_position(users, who(p)).cast("string"), F.regexp_replace(p, "^" + MENTION, ""))).otherwise(p)
    return F.array_join(F.transform(parts, one), "")


def mask_tweet(text: str | Column, genre: str | Column) -> Column:
    """mask_handles for tweets that have something to mask; other texts as they are."""
    return F.when((F.lower(col(genre)) == "tweet") & col(text).rlike(NEEDS_MASK), mask_handles(text)).otherwise(col(text))


def genre_is(genre: str | Column, what: str) -> Column:
    """Genre test, letter case aside; never NULL."""
    return F.lower(F.coalesce(col(genre), F.lit(""))) == what.lower()


def text_hash(text: str | Column) -> Column:
    """SHA-1 of the squashed text; NULL counts as empty."""
    return F.sha1(squash(text))


def hash_index(key: str | Column, n: int | Column) -> Column:
    """int(sha1(key)[:8], 16) mod n; 0 if n isn't positive."""
    h = F.conv(F.substring(F.sha1(col(key)), 1, 8), 16, 10).cast("bigint")
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n <= 0, F.lit(0).cast("bigint")).otherwise(F.pmod(h, n))


def hash_order(seed: int, *keys: str | Column) -> Column:
    """md5(seed|key|...): a reproducible stand-in for a seeded shuffle."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(col(k).cast("string"), F.lit("")) for k in keys]))


def hash_uniform(seed: int, *keys: str | Column) -> Column:
    """A reproducible number in [0, 1)."""
    return F.conv(F.substring(hash_order(seed, *keys), 1, 8), 16, 10).cast("double") / float(1 << 32)


def length_bin(n: Column, edges: tuple[int, ...] = (200, 400, 800)) -> Column:
    """Label of the length class, like '0-199', '200-399', '800+'; NULL counts as 0."""
    n = F.coalesce(n, F.lit(0))
    low, out = (0, *edges), F.lit(f"{edges[-1]}+")
    for a, b in reversed(list(zip(low, edges))):
        out = F.when(n < b, F.lit(f"{a}-{b - 1}")).otherwise(out)
    return out


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; NULL if a norm is 0 or the lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))

"""Building pair sets: author-disjoint splits, same-author pairs, one-use different-author pairs, balanced sets.

Where a procedure is random, its order here is a hash of seed and key; what is promised are its invariants, not its draws.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from stylomill.functions.text import genre_is, hash_order
from stylomill.operators.ranks import numbered, numbered_within
from stylomill.session import materialize


def author_split(corpus: DataFrame, share: float = 0.2, seed: int = 7, rounding: str = "half_even") -> DataFrame:
    """(author, split): val gets the first round(n * share) authors in hashed order, train the others.

    rounding 'half_even' sizes val; 'floor' sizes train as floor(n * (1 - share)) and leaves the rest to val. NULL is no author.
    """
    authors = corpus.select("author").where("author IS NOT NULL").distinct().withColumn("k", hash_order(seed, "author"))
    ranked = numbered(authors, "k", "author")
    n = F.broadcast(ranked.agg(F.count("*").alias("n")))  # one row
    n_val = F.bround(F.col("n") * share) if rounding == "half_even" else F.col("n") - F.floor(F.col("n") * (1 - share) + 1e-9)
    return ranked.crossJoin(n).select("author", F.when(F.col("rn") <= n_val, "val").otherwise("train").alias("split"))


def _side(corpus: DataFrame, genre: str, seed: int) -> DataFrame:
    """id, author and place of each document in its author's hashed order."""
    docs = corpus.where(genre_is("genre", genre)).where("author IS NOT NULL AND id IS NOT NULL").select("id", "author")
    return numbered_within(docs, "author", hash_order(seed, "id"), "id")


def positives(corpus: DataFrame, mode: str, seed: int = 7) -> DataFrame:
    """(author, id0, id1, k): same-author pairs in which a document occurs once; mode AA, TT or AT.

    AA and TT pair neighbours in the author's hashed order and drop an odd last one; AT zips articles with tweets.
    k numbers an author's pairs in hashed order.
    """
    if mode == "AT":
        a, t = _side(corpus, "article", seed), _side(corpus, "tweet", seed)
        p = a.withColumnRenamed("id", "id0").join(t.withColumnRenamed("id", "id1"), ["author", "r"]).select("author", "id0", "id1")
    else:
        s = _side(corpus, {"AA": "article", "TT": "tweet"}[mode], seed).withColumn("p", F.floor((F.col("r") - 1) / 2))
        # the two of a pair differ in the parity of their place
        p = s.where("r % 2 = 1").select("author", "p", F.col("id").alias("id0")).join(s.where("r % 2 = 0").select("author", "p", F.col("id").alias("id1")), ["author", "p"]).select("author", "id0", "id1")
    return numbered_within(p, "author", hash_order(seed, "id0", "id1"), "id0", "id1", name="k")


def capped(pairs: DataFrame, cap: int) -> DataFrame:
    """Pairs within the cap on an author's documents: a same-author pair uses two, so ceil(cap / 2) pairs are left."""
    return pairs.where(F.col("k") <= -(-cap // 2))


def dedup_unordered(pairs: DataFrame, *order: str) -> DataFrame:
    """Of pairs that differ in nothing but their sides' order the first."""
    w = Window.partitionBy(F.least("id0", "id1"), F.greatest("id0", "id1")).orderBy(*order)
    return pairs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def one_use_negatives(docs: DataFrame, seed: int = 7) -> DataFrame:
    """(id0, id1): different-author pairs in which each document occurs at most once, over docs (id, author).

    Documents are laid out author by author, in hashed orders, and each of the first half is paired with the one half a length
    further on: authors differ wherever no author has more than half of all; pairs within an author's block are dropped.
    """
    d = docs.select("id", "author").withColumns({"ka": hash_order(seed, "author"), "kd": hash_order(seed, "id")})
    r = materialize(numbered(d, "ka", "author", "kd", "id").select("id", "author", "rn"), "laid")
    n = F.broadcast(r.agg(F.floor(F.count("*") / 2).alias("h")))  # one row
    lo = r.crossJoin(n).where("rn <= h").select(F.col("id").alias("id0"), F.col("author").alias("x"), (F.col("rn") + F.col("h")).alias("rn"))
    return lo.join(r.select(F.col("id").alias("id1"), F.col("author").alias("y"), "rn"), "rn").where("x <> y").select("id0", "id1")


def one_use_negatives_at(pos: DataFrame, seed: int = 7) -> DataFrame:
    """(id0, id1): different-author article-tweet pairs over the documents of AT positives, each used once.

    Both sides are laid out author by author; the tweet of place i + h meets the article of place i, h being the largest block
    of one author, which suffices wherever no author has more than half.
    """
    d = pos.select("author", "id0", "id1").withColumn("ka", hash_order(seed, "author"))
    a = materialize(numbered(d, "ka", "author", hash_order(seed, "id0"), "id0").select(F.col("id0"), F.col("author").alias("x"), F.col("rn").alias("ra")), "articles")
    t = materialize(numbered(d, "ka", "author", hash_order(seed, "id1"), "id1").select(F.col("id1"), F.col("author").alias("y"), F.col("rn").alias("rt")), "tweets")
    size = d.groupBy("author").agg(F.count("*").alias("n")).agg(F.max("n").alias("h"), F.sum("n").alias("m"))
    placed = a.crossJoin(F.broadcast(size)).withColumn("rt", F.pmod(F.col("ra") - 1 + F.col("h"), F.col("m")) + 1)  # one row
    return placed.join(t, "rt").where("x <> y").select("id0", "id1")


def balanced(corpus: DataFrame, mode: str, target: int | None, cap: int = 100, seed: int = 7) -> DataFrame:
    """(label, id0, id1, author0, author1, text0, text1): as many same-author as different-author pairs, at most target together (None: all).

    Same-author pairs are capped per author; different-author pairs are made of the documents of those. Ids must be unique
    (schemas.latest). Too few documents of either kind give fewer pairs, never uneven ones.
    """
    corpus = corpus.where("id IS NOT NULL")
    pos = materialize(capped(positives(corpus, mode, seed), cap), "positives")
    if mode == "AT":
        neg = one_use_negatives_at(pos, seed)
    else:
        neg = one_use_negatives(pos.select("author", F.explode(F.array("id0", "id1")).alias("id")), seed)
    both = pos.select(F.lit(1).alias("label"), "id0", "id1").unionByName(neg.select(F.lit(0).alias("label"), "id0", "id1")).withColumn("k", hash_order(seed, "label", "id0", "id1"))
    both = materialize(both, "pairs")
    n = {r["label"]: r["n"] for r in both.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    k = min(n.get(0, 0), n.get(1, 0))
    k = k if target is None else min(k, target // 2)
    first = lambda lab: numbered(both.where(F.col("label") == lab), "k", "id0", "id1").where(F.col("rn") <= k).drop("rn", "k")
    chosen = first(1).unionByName(first(0))
    docs = corpus.select("id", "author", "text")
    for s in "01":
        chosen = chosen.join(docs.toDF(f"id{s}", f"author{s}", f"text{s}"), f"id{s}")
    return chosen.select("label", "id0", "id1", "author0", "author1", "text0", "text1")

"""Checks on pair tables: self-pairs, labels, leakage between splits, balance."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stylomill.functions.text import text_hash


def sides(pairs: DataFrame, *extra: str) -> DataFrame:
    """Both sides of every pair as rows: the extra columns, id, author, text."""
    s = [F.struct(F.col(f"id{k}").alias("id"), F.col(f"author{k}").alias("author"), F.col(f"text{k}").alias("text")) for k in (0, 1)]
    return pairs.select(*extra, F.explode(F.array(*s)).alias("s")).select(*extra, "s.id", "s.author", "s.text")


def self_pairs(pairs: DataFrame, *keys: str) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.count_if(F.col("id0") == F.col("id1")).alias("n_self"), F.count("*").alias("n_pairs"))


def label_conflicts(pairs: DataFrame, *keys: str) -> DataFrame:
    """Pairs whose label says otherwise than their authors; pairs with an unknown author or label can't tell."""
    wrong = (F.col("author0") == F.col("author1")) != (F.col("label") == 1)
    return pairs.groupBy(*keys).agg(F.count_if(wrong).alias("n_conflicts"), F.count_if(wrong.isNull()).alias("n_unknown"))


def id_leakage(pairs: DataFrame, split: str = "train") -> DataFrame:
    """(split, id): ids of other splits that occur in the given one too."""
    ids = pairs.select("split", F.explode(F.array("id0", "id1")).alias("id")).where("id IS NOT NULL").distinct()
    return ids.where(F.col("split") != split).join(ids.where(F.col("split") == split).select("id"), "id", "left_semi").select("split", "id")


def text_leakage(pairs: DataFrame, split: str = "train") -> DataFrame:
    """Per other split: distinct squashed texts, and those that the given split has too. Digests are compared, NULL texts aside."""
    h = sides(pairs, "split").where("text IS NOT NULL").select("split", text_hash("text").alias("h")).distinct()
    base = h.where(F.col("split") == split).select("h").withColumn("hit", F.lit(1))
    return h.where(F.col("split") != split).join(base, "h", "left").groupBy("split").agg(F.count("*").alias("n_texts"), F.count("hit").alias("n_leaked"))


def doc_balance(pairs: DataFrame) -> DataFrame:
    """(id, diff): positive less negative pairs of each document; an id twice in a pair counts twice."""
    each = pairs.select("label", F.explode(F.array("id0", "id1")).alias("id")).where("id IS NOT NULL AND label IS NOT NULL")
    return each.groupBy("id").agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(-1)).alias("diff"))


def balance_summary(pairs: DataFrame, most: float = 1.5) -> DataFrame:
    d = doc_balance(pairs).agg(F.count("*").alias("n_docs"), F.round(F.avg(F.abs("diff")), 6).alias("mean_abs_diff"), F.max(F.abs("diff")).alias("max_abs_diff"))
    return d.withColumn("unbalanced", F.coalesce(F.col("mean_abs_diff") > most, F.lit(False)))


def repeated_documents(pairs: DataFrame) -> DataFrame:
    """(label, id, n): documents in more than one pair of a label; none is the invariant of one-use pairs."""
    each = pairs.select("label", F.explode(F.array("id0", "id1")).alias("id"))
    return each.groupBy("label", "id").agg(F.count("*").alias("n")).where("n > 1")


def preview(pairs: DataFrame, n: int, width: int = 80, seed: int = 7) -> DataFrame:
    """n pairs in hashed order, with the beginning of their texts."""
    from stylomill.functions.text import hash_order

    cut = lambda c: F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("…"))).otherwise(F.col(c))
    k = hash_order(seed, "id0", "id1", "label", "split", "dataset")
    return pairs.select("label", "id0", "id1", cut("text0").alias("text0"), cut("text1").alias("text1"), k.alias("k")).orderBy("k", "text0", "text1").limit(n).drop("k")

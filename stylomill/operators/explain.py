"""Token attributions: normalising tokens, merging pieces into words, importance by model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Signs that tokenizers put into tokens.
WORD_START, PIECE, SPECIALS = "Ġ", "##", ("[CLS]", "[SEP]", "[PAD]", "<s>", "</s>", "<pad>")


def normal_token(token: str | Column) -> Column:
    """A token in lower case without the word-start sign and outer blanks; NULL if nothing is left."""
    t = F.col(token) if isinstance(token, str) else token
    return F.nullif(F.trim(F.lower(F.replace(t, F.lit(WORD_START), F.lit("")))), F.lit(""))


def merge_words(tokens: DataFrame, kind: str = "wordpiece", keys: tuple[str, ...] = ("model", "sample")) -> DataFrame:
    """(keys, word_no, word, score): tokens joined into words, s1 added up; special tokens are skipped.

    'wordpiece': a token with ## goes on with the word before (the first begins one anyway); 'byte_bpe': a token with the
    word-start sign begins a word.
    """
    t = tokens.where(~F.col("token").isin(*SPECIALS) & F.col("token").isNotNull())
    w = Window.partitionBy(*keys).orderBy("pos")
    begins = ~F.startswith("token", F.lit(PIECE)) if kind == "wordpiece" else F.startswith("token", F.lit(WORD_START))
    bare = F.regexp_replace("token", "^##", "") if kind == "wordpiece" else F.replace(F.col("token"), F.lit(WORD_START), F.lit(""))
    rn = t.withColumn("_first", F.row_number().over(w) == 1)
    numbered = rn.withColumn("word_no", F.sum(F.when(begins | F.col("_first"), 1).otherwise(0)).over(w))
    each = numbered.groupBy(*keys, "word_no").agg(F.array_sort(F.collect_list(F.struct("pos", bare.alias("t")))).alias("p"), F.sum("s1").alias("score"))
    return each.select(*keys, "word_no", F.lower(F.array_join(F.transform("p", lambda x: x["t"]), "")).alias("word"), "score").where("word <> ''")


def token_importance(tokens: DataFrame) -> DataFrame:
    """(model, token, importance): absolute attributions of each normal token added up."""
    return tokens.withColumn("t", normal_token("token")).where("t IS NOT NULL").groupBy("model", F.col("t").alias("token")).agg(F.sum(F.abs("s1")).alias("importance"))


def sample_scores(tokens: DataFrame) -> DataFrame:
    """(model, sample, token, score): signed attributions of each normal token in a sample added up."""
    return tokens.withColumn("t", normal_token("token")).where("t IS NOT NULL").groupBy("model", "sample", F.col("t").alias("token")).agg(F.sum("s1").alias("score"))


def min_max(importance: DataFrame, value: str = "importance", key: str = "model") -> DataFrame:
    """With the value scaled to 0..1 within each key, 0 if all are equal. Extremes are aggregates joined back, not a window."""
    ends = importance.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return importance.join(F.broadcast(ends), key).withColumn("scaled", F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))).drop("_lo", "_hi")  # a row for each model


def common_top(importance: DataFrame, k: int, models: int) -> DataFrame:
    """(token, mean_scaled): the k tokens, of those that all models have, with the greatest mean of scaled importances."""
    scaled = min_max(importance)
    return scaled.groupBy("token").agg(F.count("*").alias("m"), F.avg("scaled").alias("mean_scaled")).where(F.col("m") == models).select("token", "mean_scaled").orderBy(F.desc(F.round("mean_scaled", 9)), "token").limit(k)

"""Models as Arrow-batched functions: token counts, text vectors. The model itself is the caller's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Words and signs, the tokenizer where no other is given.
PLAIN_TOKENS = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def plain_token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(PLAIN_TOKENS)), F.lit(0))


def token_count(make: Callable[[], Callable[[list[str]], list[int]]]):
    """A function of a text column; `make` is called once in each task and returns a counter of tokens of texts."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = make()
        for s in batches:
            yield pd.Series(counter([x or "" for x in s]), dtype="int32")

    return count


def texts_of(df: DataFrame) -> DataFrame:
    """(text): both sides of pairs where there are text0 and text1, else the column text; ValueError if there is neither."""
    if {"text0", "text1"} <= set(df.columns):
        return df.select(F.explode(F.array("text0", "text1")).alias("text"))
    if "text" in df.columns:
        return df.select("text")
    raise ValueError("neither text0 and text1 nor text")


def token_stats(texts: DataFrame, count: Callable[[Column], Column] = plain_token_count) -> DataFrame:
    """One row: texts and the mean, least and most of their tokens."""
    return texts.select(count(F.col("text")).alias("n")).agg(F.count("*").alias("n_texts"), F.round(F.avg("n"), 6).alias("mean_tokens"), F.min("n").alias("min_tokens"), F.max("n").alias("max_tokens"))


def encoder(make: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 256):
    """A function of a text column to ARRAY<FLOAT>; `make` is called once in each task and returns a batch encoder."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in batches:
            texts = [x or "" for x in s]
            parts = [np.asarray(model(texts[i : i + batch]), np.float32) for i in range(0, len(texts), batch)]
            yield pd.Series(list(np.concatenate(parts))) if parts else pd.Series([], dtype=object)

    return encode


def hashing_encoder(size: int = 256) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """An encoder without weights: counts of hashed character trigrams, scaled to length 1."""

    def make():
        import xxhash

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), size), np.float32)
            for r, t in enumerate(texts):
                t = f"  {t.lower()} "
                for i in range(len(t) - 2):
                    out[r, xxhash.xxh3_64_intdigest(t[i : i + 3]) % size] += 1
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

        return encode

    return make

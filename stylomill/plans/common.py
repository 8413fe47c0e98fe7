"""Tables and relations that the queries start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from stylomill.functions.text import n_words
from stylomill.schemas import latest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, author, genre, text of each document, deliveries folded."""
    return latest(table(spark, sf_dir, "docs"), "author", "genre", "text")


def featured(spark: SparkSession, sf_dir: str, *columns: str, **features: Column) -> DataFrame:
    """id, columns and features of each document's latest delivery: features are computed in the scan, texts aren't shuffled."""
    names = [*columns, *features]
    return latest(table(spark, sf_dir, "docs").select("id", "ingested_at", *columns, *[f.alias(n) for n, f in features.items()]), *names)


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with n_words in place of the text: words are counted in the scan, texts aren't shuffled."""
    docs = table(spark, sf_dir, "docs").withColumn("n_words", n_words("text"))
    return latest(docs, "author", "genre", "n_words")

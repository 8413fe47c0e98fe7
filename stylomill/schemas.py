"""Relations of the corpus and the guards on their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

CORPUS = "id BIGINT, author STRING, genre STRING, text STRING"
CORPUS_CLEAN = CORPUS + ", pe_seq STRING, pe_len INT, pe_counts MAP<STRING,INT>"
SEGMENTS = "id BIGINT, author STRING, genre STRING, text STRING, word_count INT, source_ids ARRAY<STRING>, pe_seq STRING, pe_len INT"
PAIRS = "label INT, text0 STRING, text1 STRING, author0 STRING, author1 STRING, id0 BIGINT, id1 BIGINT"
REWRITTEN = "id BIGINT, author STRING, impersonator STRING, impersonated_text STRING, obfuscated_text STRING, paraphrased_text STRING, support_ids ARRAY<BIGINT>, obfuscated_from STRING, error STRING"
ADVERSARIAL = PAIRS + ", genre0 STRING, genre1 STRING, pair_type STRING, swap BOOLEAN, left_text STRING, right_text STRING, impersonator STRING, support_ids ARRAY<BIGINT>, obfuscated_from STRING"
PAIR_STATS = "dataset STRING, mode STRING, split STRING, pairs_total BIGINT, pairs_pos BIGINT, pairs_neg BIGINT, pos_ratio DOUBLE, unique_docs BIGINT, unique_authors BIGINT"
SCORED = "pair_id BIGINT, label INT, score DOUBLE"
ATTRIBUTIONS = "model STRING, sample INT, pos INT, token STRING, s0 DOUBLE, s1 DOUBLE"
EXAMPLES = "author STRING, original STRING, rewritten STRING"
SAMPLES = "author STRING, text1 STRING, text2 STRING, same_author BOOLEAN, type STRING"
INTERVIEWS = "author STRING, source STRING, text STRING, type STRING, note STRING"
LINES = "file STRING, line_no BIGINT, value STRING"
ERROR_RESULTS = "error_rate DOUBLE, patterns MAP<STRING,BIGINT>, category_distribution STRUCT<FP:BIGINT,FN:BIGINT>"
AUTHOR_COUNTS = "author STRING, total BIGINT, article BIGINT, tweet BIGINT"


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """df, or ValueError naming the columns that it lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def ensure_columns(df: DataFrame, schema: str) -> DataFrame:
    """Just the columns of a DDL schema, in its order; those that df lacks are NULL."""
    want = df.sparkSession.createDataFrame([], schema).schema
    return df.select([F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in want])


def coerce_ids(df: DataFrame, *names: str) -> DataFrame:
    """Columns as BIGINT; rows where one isn't a whole number go."""
    for n in names:
        df = df.withColumn(n, F.expr(f"try_cast(`{n}` AS BIGINT)"))
    return df.na.drop(subset=list(names))


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """df, or ValueError if a key occurs twice."""
    twice = df.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} {twice[0][0]} occurs {twice[0][1]} times")
    return df


def latest(docs: DataFrame, *columns: str, key: str = "id", order: str = "ingested_at") -> DataFrame:
    """One row per key, of its latest delivery: key and the columns, of which the last may be long (a text).

    An aggregate with a map-side part, so a key with many deliveries is no hot task. Every column is an aggregate of its own:
    those that a query doesn't use are neither read nor shuffled. Of deliveries that tie one is taken whole: the greatest by a
    hash of all columns but the last, then by the last. Keys of NULL go.
    """
    tie = F.xxhash64(*[x for c in columns[:-1] for x in (F.col(c), F.col(c).isNull())]) if len(columns) > 1 else F.lit(0)
    best = docs.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(F.struct(F.col(order).alias("o"), tie.alias("t"), F.col(c).alias("v"))).alias(f"_{c}") for c in columns])
    return best.select(key, *[F.col(f"`_{c}`.v").alias(c) for c in columns])

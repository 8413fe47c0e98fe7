"""Queries on lines of texts, token counts, events and result files."""

from __future__ import annotations

from pyspark.sql import functions as F

from stylomill.functions.models import encoder, hashing_encoder, texts_of, token_stats
from stylomill.functions.text import cosine
from stylomill.operators import lines as L
from stylomill.plans.common import corpus, table
from stylomill.plans.registry import query
from stylomill.plans.sql import CORPUS
from stylomill.streaming.streams import run_complete, windowed_counts

_LINES = f"{CORPUS}, l AS (SELECT id, unnest(string_split(text, chr(10))) v, unnest(range(1, len(string_split(text, chr(10))) + 1)) line_no FROM corpus WHERE text IS NOT NULL)"
_CLEAN = r"trim(translate(regexp_replace(trim(v, ' '), '<\d{2}:\d{2}:\d{2}\.\d{3}><c>|</c>', '', 'g'), '“”\"', ''), ' ')"


def _lines(spark, d):
    c = corpus(spark, d).where("text IS NOT NULL")
    return c.select(F.col("id").cast("string").alias("file"), F.posexplode(F.split("text", "\n")).alias("p", "value")).select("file", (F.col("p") + 1).cast("bigint").alias("line_no"), "value")


@query(rf"WITH {_LINES} SELECT CAST(id AS VARCHAR) AS file, line_no, {_CLEAN} AS value FROM l WHERE trim(v, ' ') NOT IN ('', '[Music]', '[Applause]', '♪') AND NOT starts_with(trim(v, ' '), 'WEBVTT') AND NOT contains(v, '-->')".replace('\\"', '"'))
def subtitle_lines(spark, d):
    return L.speech_lines(_lines(spark, d))


@query(f"WITH {_LINES} SELECT CAST(id AS VARCHAR) AS file, string_agg(translate(trim(v[4:], ' '), '“”\"', ''), ' ' ORDER BY line_no) AS text FROM l WHERE starts_with(v, 'RT ') GROUP BY id")
def speaker_text(spark, d):
    return L.speaker_text(_lines(spark, d), "RT ")


@query()
def subtitle_dedup(spark, d):
    """Each document's lines, those like the last kept one left out; a fold that SQL can't say."""
    return L.without_repeats(L.speech_lines(_lines(spark, d)))


_TOKENS = r"len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\s\p{Z}\p{L}\p{N}]'))"


@query(r"WITH t AS (SELECT len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\t\n\x0B\f\r \p{L}\p{N}]')) n FROM (SELECT text0 AS text FROM pairs UNION ALL SELECT text1 FROM pairs)) SELECT count(*) AS n_texts, round(avg(n), 6) AS mean_tokens, CAST(min(n) AS INT) AS min_tokens, CAST(max(n) AS INT) AS max_tokens FROM t")
def token_stats_pairs(spark, d):
    return token_stats(texts_of(table(spark, d, "pairs")))


@query(r"SELECT count(*) AS n_texts, round(avg(n), 6) AS mean_tokens, CAST(min(n) AS INT) AS min_tokens, CAST(max(n) AS INT) AS max_tokens FROM (SELECT len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\t\n\x0B\f\r \p{L}\p{N}]')) n FROM segments)")
def token_stats_segments(spark, d):
    """Of a table with one text a row."""
    return token_stats(texts_of(table(spark, d, "segments")))


@query()
def encoded_pairs(spark, d):
    """Scores of pairs from an encoder without weights, standing where a trained one would."""
    p = table(spark, d, "pairs").where("text0 IS NOT NULL AND text1 IS NOT NULL")
    e = encoder(hashing_encoder(64))
    return p.select("id0", "id1", "label", F.round(cosine(e("text0"), e("text1")), 5).alias("score"))


_WINDOWS = "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


@query(_WINDOWS)
def event_windows(spark, d):
    return windowed_counts(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query(_WINDOWS)
def event_windows_stream(spark, d):
    """The same counts from a stream over the table's files."""
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")  # a pattern: the table may be a file or a folder
    return run_complete(windowed_counts(events, late=None), "windows").withColumn("total", F.round("total", 4))


@query("""WITH r AS (SELECT dataset AS model, mode AS test_set, count(*) FILTER ((author0 = author1) <> (label = 1)) / count(*) error_rate, count(*) FILTER (author0 <> author1 AND label = 1) fp, count(*) FILTER (author0 = author1 AND label = 0) fn,
count(*) FILTER (id0 = id1) self_pair, count(*) FILTER (abs(length(text0) - length(text1)) > 500) length_imbalance FROM pairs GROUP BY 1, 2) SELECT model, test_set, round(error_rate, 4) AS error_rate, fp, fn, self_pair, length_imbalance FROM r""")
def error_rollup(spark, d):
    """Result records (nested, made from the pairs' labels) rolled up."""
    p = table(spark, d, "pairs")
    same = F.col("author0") == F.col("author1")
    r = p.groupBy(F.col("dataset").alias("model"), F.col("mode").alias("test_set")).agg(
        (F.count_if(same != (F.col("label") == 1)) / F.count("*")).alias("error_rate"),
        F.struct(F.count_if(~same & (F.col("label") == 1)).alias("FP"), F.count_if(same & (F.col("label") == 0)).alias("FN")).alias("category_distribution"),
        F.map_from_arrays(F.array(F.lit("self_pair"), F.lit("length_imbalance")), F.array(F.count_if(F.col("id0") == F.col("id1")), F.count_if(F.abs(F.length("text0") - F.length("text1")) > 500))).alias("patterns"),
    )
    return L.error_rollup(r, ("self_pair", "length_imbalance"))

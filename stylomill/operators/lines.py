"""Transcripts: speakers' lines, subtitle lines without their repeats, error reports."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

# Lines that are no speech, time tags, quotation marks.
SKIP = ("[Music]", "[Applause]", "♪", "")
TIME_TAG = r"<\d{2}:\d{2}:\d{2}\.\d{3}><c>|</c>"
QUOTES = '“”"'


def clean_line(line: Column) -> Column:
    """Without time tags, quotation marks and outer blanks."""
    return F.trim(F.translate(F.regexp_replace(line, TIME_TAG, ""), QUOTES, ""))


def speech_lines(lines: DataFrame) -> DataFrame:
    """Subtitle lines that are speech, cleaned: no header, no cue times, no sounds, none blank."""
    v = F.trim("value")
    return lines.where(F.col("value").isNotNull() & ~v.isin(*SKIP) & ~v.startswith("WEBVTT") & ~v.contains("-->")).withColumn("value", clean_line(v))


def speaker_text(lines: DataFrame, speaker: str) -> DataFrame:
    """(file, text): what one speaker (the lines' prefix, like 'JH:') says in each file, joined by blanks."""
    said = lines.where(F.col("value").startswith(speaker)).select("file", "line_no", F.translate(F.trim(F.expr(f"substring(value, {len(speaker) + 1})")), QUOTES, "").alias("t"))
    # a file's lines were one value of the scan, so they fit one row again
    each = said.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line_no", "t"))).alias("s"))
    return each.select("file", F.array_join(F.transform("s", lambda x: x["t"]), " ").alias("text"))


def _alike(a: str, b: str, near: float) -> bool:
    """Whether the ratio of a and b is above near; its cheaper upper bounds are asked first."""
    m = SequenceMatcher(None, a, b)
    return m.real_quick_ratio() > near and m.quick_ratio() > near and m.ratio() > near


def _keep(near: float):
    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_no")
        last, rows = "", []
        for at, v in zip(pdf["line_no"], pdf["value"]):
            if v != last and not _alike(v, last, near):
                rows.append((pdf["file"].iloc[0], at, v))
                last = v
        return pd.DataFrame(rows, columns=["file", "line_no", "value"])

    return keep


def without_repeats(lines: DataFrame, near: float = 0.95) -> DataFrame:
    """Lines that differ from the last kept line of their file, by a Ratcliff-Obershelp ratio of at most `near`.

    What is kept depends on what was kept before: a fold over each file's lines, one file a task.
    """
    return lines.select("file", "line_no", "value").groupBy("file").applyInPandas(_keep(near), "file string, line_no bigint, value string")


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two texts; NULL if one is."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def error_rollup(results: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """Error rate, false positives and negatives and the counts of some patterns (0 if absent) of each result."""
    return results.select("model", "test_set", F.round("error_rate", 4).alias("error_rate"), F.coalesce("category_distribution.FP", F.lit(0)).alias("fp"), F.coalesce("category_distribution.FN", F.lit(0)).alias("fn"),
                          *[F.coalesce(F.try_element_at("patterns", F.lit(p)), F.lit(0)).alias(p) for p in patterns])


def split_pair(text: str | Column, separator: str) -> tuple[Column, Column]:
    """The two sides of a text joined by a separator, at its first place; the second is empty if there is none."""
    t = F.col(text) if isinstance(text, str) else text
    at = F.instr(t, separator)
    return F.when(at > 0, F.substring(t, F.lit(1), at - 1)).otherwise(t), F.when(at > 0, F.substring(t, at + len(separator), F.length(t))).otherwise("")

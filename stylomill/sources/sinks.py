"""Sinks: JSON lines, appending, one JSON array for small results, CSV, text, reports."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", keep_nulls: bool = False) -> None:
    """One record a line; fields of NULL are left out unless kept. mode 'append' adds files to what is there."""
    df.write.mode(mode).option("ignoreNullFields", not keep_nulls).json(path)


def write_json_array(df: DataFrame, path: str, most: int = 100_000) -> int:
    """One local file with one array, for results of bounded size; ValueError beyond `most` rows. Returns the number of rows."""
    rows = df.limit(most + 1).toJSON().collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: use write_jsonl")
    with open(path, "w", encoding="utf-8") as f:
        json.dump([json.loads(r) for r in rows], f, ensure_ascii=False, indent=4)
    return len(rows)


def append_json_array(df: DataFrame, path: str, most: int = 100_000) -> int:
    """Adds rows to the array in one local file (made if it isn't there) and puts the new file in its place; returns the rows it has then."""
    old = []
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            old = json.load(f)
        if not isinstance(old, list):
            raise ValueError(f"{path} doesn't hold an array")
    new = df.limit(most + 1 - len(old)).toJSON().collect() if len(old) <= most else []
    if len(old) + len(new) > most:
        raise ValueError(f"more than {most} rows: use write_jsonl")
    with open(path + ".new", "w", encoding="utf-8") as f:
        json.dump([*old, *(json.loads(r) for r in new)], f, ensure_ascii=False, indent=2)
    os.replace(path + ".new", path)
    return len(old) + len(new)


def write_attributions(df: DataFrame, path: str, most: int = 1_000_000) -> int:
    """(sample, pos, token, s0, s1) of one model as a local NPZ file: values, tokens as plain strings, lengths. Returns the samples."""
    import numpy as np

    rows = df.select("sample", "pos", "token", "s0", "s1").orderBy("sample", "pos").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} tokens")
    samples = sorted({r["sample"] for r in rows})
    of: dict[int, list] = {}
    for r in rows:
        of.setdefault(r["sample"], []).append(r)
    wide = max(map(len, of.values()), default=0)
    values = np.zeros((len(samples), wide, 2))
    tokens = np.full((len(samples), wide), "", dtype=f"<U{max([len(r['token']) for r in rows], default=1) or 1}")
    for i, k in enumerate(samples):
        for j, r in enumerate(of[k]):
            values[i, j], tokens[i, j] = (r["s0"], r["s1"]), r["token"]
    np.savez_compressed(path, values=values, tokens=tokens, lengths=np.array([len(of[k]) for k in samples], np.int64))
    return len(samples)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """With a header; fields are quoted where they need it."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_text(df: DataFrame, path: str, *columns: str, sep: str = "\t", mode: str = "overwrite") -> None:
    """The columns joined by a separator, a row a line."""
    df.select(F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])).write.mode(mode).text(path)


def markdown(df: DataFrame, order: str) -> DataFrame:
    """One row: the (small) table as a Markdown table, rows by a column."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |"))
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n"
    return df.agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n")).alias("report"))

"""Texts packed into segments of 300 to 420 words, author by author, in the order of the corpus.

Both packers are folds over an author's documents whose state is the number of words waiting, 0 to 299. An author may hold a
large part of the corpus, so the fold is cut into runs of documents: each run is folded for all 300 states at once (a table of
where it ends and how much it emits), the runs' tables are strung together, and each run is folded again from its true state.
No task holds more of an author than a run's word counts and the tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from stylomill.functions import text as X
from stylomill.operators.stats import words_of
from stylomill.operators.ranks import numbered, numbered_within
from stylomill.session import materialize

LEAST, MOST = 300, 420
SEPARATOR = "\n<SEP>\n"


def tweet_step(s: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """State after a text of w words, and how many segments end with it; whole texts only, waiting ones are lost at a flush."""
    if w <= 0:
        return s, np.zeros_like(s)
    if w > MOST:  # cut to a segment of its own
        return np.zeros_like(s), np.ones_like(s)
    t = np.where(s + w <= MOST, s + w, w)
    return np.where(t >= LEAST, 0, t), (t >= LEAST).astype(s.dtype)


def article_step(s: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for a word stream: segments are filled up to MOST while the text lasts and end once they hold LEAST."""
    fill = MOST - s
    rest = np.maximum(w - fill, 0)
    tail = rest % MOST
    short = s + w
    state = np.where(w >= fill, np.where(tail >= LEAST, 0, tail), np.where(short >= LEAST, 0, short))
    n = np.where(w >= fill, 1 + rest // MOST + (tail >= LEAST), (short >= LEAST).astype(s.dtype))
    return state, n.astype(s.dtype)


STEPS = {"tweet": tweet_step, "article": article_step}


def _table(genre: str):
    step = STEPS[genre]

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        s, n = np.arange(LEAST), np.zeros(LEAST, np.int64)
        for w in pdf.sort_values("r")["n_words"]:
            s, k = step(s, int(w))
            n = n + k
        return pd.DataFrame({"author": pdf["author"].iloc[:1], "run": pdf["run"].iloc[:1], "ends": [s.tolist()], "emits": [n.tolist()]})

    return table


def _string(pdf: pd.DataFrame) -> pd.DataFrame:
    """Runs of an author in order, with the state and the number of segments before each."""
    pdf = pdf.sort_values("run")
    s, n, state, before = 0, 0, [], []
    for ends, emits in zip(pdf["ends"], pdf["emits"]):
        state.append(s)
        before.append(n)
        s, n = int(ends[s]), n + int(emits[s])
    return pd.DataFrame({"author": pdf["author"], "run": pdf["run"], "state": state, "before": before})


def _cut(genre: str):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Parts (document, first word, words) with the number of the segment they are waiting for or complete. Rows come run by
        run in order; the state is carried from batch to batch."""
        now, s, seg = None, 0, 0
        for pdf in batches:
            out: list[tuple] = []
            for author, run, r, i, w, state, before in zip(*(pdf[c].tolist() for c in ("author", "run", "r", "id", "n_words", "state", "before"))):
                if (author, run) != now:
                    now, s, seg = (author, run), state, before
                if w <= 0:
                    continue
                if genre == "tweet":
                    if w > MOST:
                        out.append((author, r, i, 0, MOST, seg, "alone"))
                        s, seg = 0, seg + 1
                        continue
                    fresh = s + w > MOST
                    out.append((author, r, i, 0, w, seg, "fresh" if fresh else "on"))
                    s = w if fresh else s + w
                    if s >= LEAST:
                        s, seg = 0, seg + 1
                else:
                    at = 0
                    while at < w:
                        n = min(MOST - s, w - at)
                        out.append((author, r, i, at, n, seg, "on"))
                        at, s = at + n, s + n
                        if s >= LEAST:
                            s, seg = 0, seg + 1
            yield pd.DataFrame(out, columns=["author", "r", "id", "first", "n", "seg_no", "status"])

    return cut


def segment_parts(corpus: DataFrame, genre: str, order: str = "id", run: int = 4000) -> DataFrame:
    """(author, seg_no, part, id, first, n): the stretches of documents that make up each segment of at least LEAST words."""
    docs = corpus.where(X.genre_is("genre", genre)).where("author IS NOT NULL AND id IS NOT NULL").select("id", "author", F.col(order).alias("o"), words_of(corpus).cast("bigint").alias("n_words"))
    rows = numbered_within(docs, "author", "o", "id").select("author", "id", "r", "n_words", F.floor((F.col("r") - 1) / run).alias("run"))
    rows = materialize(rows, "documents")
    # only authors with several runs need tables to start the later ones
    several = rows.groupBy("author").agg(F.max("run").alias("last")).where("last > 0").select("author")
    tables = rows.join(several, "author", "left_semi").groupBy("author", "run").applyInPandas(_table(genre), "author string, run bigint, ends array<bigint>, emits array<bigint>")
    states = tables.groupBy("author").applyInPandas(_string, "author string, run bigint, state bigint, before bigint")
    started = rows.join(states, ["author", "run"], "left").withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("state", "before")})
    order_ = started.repartition("author", "run").sortWithinPartitions("author", "run", "r")
    parts = order_.mapInPandas(_cut(genre), "author string, r bigint, id bigint, first bigint, n bigint, seg_no bigint, status string")
    parts = materialize(parts, "parts")
    # what waits when a flush comes belongs to no segment: of a segment's parts only those since its last fresh start count
    w = Window.partitionBy("author", "seg_no")
    kept = parts.withColumn("start", F.max(F.when(F.col("status") != "on", F.struct("r", "first"))).over(w)).where("start IS NULL OR struct(r, first) >= start")
    kept = kept.withColumn("total", F.sum("n").over(w)).where(F.col("total") >= LEAST)
    return kept.select("author", "seg_no", F.row_number().over(w.orderBy("r", "first")).alias("part"), "id", "first", "n")


def segment_table(parts: DataFrame) -> DataFrame:
    """(author, seg_no, word_count, source_ids): segments without their text; source_ids in order, each once."""
    each = parts.groupBy("author", "seg_no").agg(F.sum("n").cast("int").alias("word_count"), F.array_sort(F.collect_list(F.struct("part", "id"))).alias("s"))
    return each.select("author", "seg_no", "word_count", F.array_distinct(F.transform("s", lambda x: x["id"].cast("string"))).alias("source_ids"))


def numbered_segments(table: DataFrame, start: int = 0) -> DataFrame:
    """With id: segments counted through all authors in order of author and seg_no. Only the authors' counts are added up."""
    n = table.groupBy("author").agg(F.count("*").alias("c"))
    ranked = materialize(numbered(n, "author"), "authors")
    before = ranked.withColumn("block", F.floor(F.col("rn") / 10_000))
    blocks = before.groupBy("block").agg(F.sum("c").alias("bc")).withColumn("bb", F.coalesce(F.sum("bc").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    base = before.join(blocks, "block").withColumn("base", F.col("bb") + F.coalesce(F.sum("c").over(Window.partitionBy("block").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    order = F.row_number().over(Window.partitionBy("author").orderBy("seg_no"))
    return table.withColumn("o", order).join(base.select("author", "base"), "author").select((F.col("base") + F.col("o") - 1 + start).alias("id"), *table.columns)


def with_texts(parts: DataFrame, corpus: DataFrame, genre: str) -> DataFrame:
    """(author, seg_no, text): the words of each part, joined; parts of different tweets by SEPARATOR. A segment has at most MOST words."""
    cut = parts.join(corpus.select("id", "text"), "id").select("author", "seg_no", "part", F.array_join(F.slice(X.words("text"), (F.col("first") + 1).cast("int"), F.col("n").cast("int")), " ").alias("t"))
    made = cut.groupBy("author", "seg_no").agg(F.array_sort(F.collect_list(F.struct("part", "t"))).alias("p"))
    return made.select("author", "seg_no", F.array_join(F.transform("p", lambda x: x["t"]), SEPARATOR if genre == "tweet" else " ").alias("text"))


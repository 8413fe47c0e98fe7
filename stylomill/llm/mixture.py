"""A mixture of sources with given shares of tokens: entropy balancing.

Per source, document rates exp(lambda * tokens), at most the cap, are the ones closest to one use of each document (in relative
entropy) that reach the source's tokens; lambda solves a convex dual by Newton steps, each one aggregate over the table of
(source, tokens, number of documents). Rates are rounded into copies so that token sums hold in every bucket of documents.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from stylomill.functions.text import name_key
from stylomill.session import materialize, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the vocabulary's merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(sent):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = _encoding(sent.value)
        for pdf in batches:
            n = [len(e.encode_ordinary(t.encode("utf-8", "replace").decode())) if t else 0 for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": n})

    return count


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens); source by name_key, texts of NULL have no token."""
    with open(vocabulary, "rb") as f:  # read here and sent: executors need no such file
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = spread(docs.select("doc_id", "text", name_key("source").alias("source")))
    return rows.mapInPandas(_count(sent), "doc_id bigint, source string, tokens bigint")


def feasible_size(sources: list[dict]) -> float:
    """Tokens of the largest mixture in which every source with a share has it, its documents used as often as allowed."""
    return min((s["supply"] * s["cap"] / s["share"] for s in sources if s["share"] and s["share"] > 0), default=0.0)


def solve_rates(counts: DataFrame, targets: DataFrame, size: float | str | None = None, steps: int = 40, tolerance: float = 1e-9) -> dict[str, dict]:
    """lambda of each source of the targets, in 1/tokens, with its goal and supply of tokens. counts: source, tokens, n.

    size: tokens of the mixture; None for as many as the table has, "feasible" for the most with which all shares hold.
    """
    total = size if isinstance(size, (int, float)) else counts.agg(F.sum(F.col("tokens") * F.col("n")).alias("t")).first()["t"] or 0
    wanted = targets.select(name_key("source").alias("source"), F.col("target_share").cast("double").alias("share"), F.greatest(F.lit(0), F.coalesce("max_repeats", F.lit(1))).alias("cap"))
    wanted = wanted.where("source IS NOT NULL").groupBy("source").agg(F.sum("share").alias("share"), F.max("cap").alias("cap"))
    have = counts.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("supply"), F.max("tokens").alias("longest"))
    state = {r["source"]: r.asDict() | {"supply": r["supply"] or 0, "lam": 0.0, "lo": -np.inf, "hi": np.inf, "done": False} for r in wanted.join(have, "source", "left").collect()}  # a row for each target
    if size == "feasible":
        total = min(total, feasible_size(list(state.values())))
    for s in state.values():
        s["goal"] = s["share"] * total
        if s["supply"] * s["cap"] <= s["goal"] or not s["longest"]:
            s |= {"lam": np.inf, "done": True}  # all of it, as often as allowed
        elif s["goal"] <= 0:
            s |= {"lam": -np.inf, "done": True}
        else:
            s["lam"] = math.log(max(1e-12, s["goal"] / s["supply"])) / s["longest"] if s["goal"] < s["supply"] else 0.0
    spark = counts.sparkSession
    for _ in range(steps):
        open_ = [(k, float(s["lam"]), float(s["cap"])) for k, s in state.items() if not s["done"]]
        if not open_:
            break
        lam = F.broadcast(spark.createDataFrame(open_, "source string, lam double, cap double"))  # a row for each target
        x = F.col("lam") * F.col("tokens")
        rate = F.least(F.exp(F.least(x, F.lit(50.0))), F.col("cap"))
        free = F.when(F.exp(F.least(x, F.lit(50.0))) < F.col("cap"), 1.0).otherwise(0.0)
        now = counts.join(lam, "source").groupBy("source").agg(F.sum(rate * F.col("tokens") * F.col("n")).alias("f"), F.sum(free * rate * F.col("tokens") ** 2 * F.col("n")).alias("d")).collect()
        for r in now:
            s = state[r["source"]]
            gap = r["f"] - s["goal"]
            if abs(gap) <= tolerance * max(1.0, s["goal"]):
                s["done"] = True
                continue
            s["hi" if gap > 0 else "lo"] = s["lam"]
            step = s["lam"] - gap / r["d"] if r["d"] else np.nan
            wide = 30.0 / s["longest"]
            lo, hi = max(s["lo"], s["lam"] - wide), min(s["hi"], s["lam"] + wide)
            s["lam"] = step if lo < step < hi else (lo + hi) / 2
    return state


def mixture(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, bucket: int = 5000, seed: int = 5, size: float | str | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents with copies (doc_id, source, tokens, copies >= 1), and the shares reached for each source of the targets.

    The mixture is as large in tokens as the whole table (or as `size` says, see solve_rates) where the sources' caps allow; a source that falls short even with all
    documents at their cap is used up, and its shortfall shows in the report (it isn't filled with other sources, whose shares
    it would shift). Documents of NULL or unwanted sources and documents without tokens are left out.
    """
    counted = materialize(token_counts(docs, vocabulary), "tokens")
    counts = materialize(counted.groupBy("source", "tokens").agg(F.count("*").alias("n")), "counts")
    state = solve_rates(counts, targets, size)
    spark = docs.sparkSession
    rows = [(k, float(np.clip(s["lam"], -1e9, 1e9)), int(s["cap"]), float(s["share"]), float(s["goal"])) for k, s in state.items()]
    solved = spark.createDataFrame(rows, "source string, lam double, cap int, target_share double, goal double")
    use = counted.where("tokens > 0").join(F.broadcast(solved), "source")  # a row for each target
    rate = F.least(F.exp(F.least(F.greatest(F.col("lam") * F.col("tokens"), F.lit(-700.0)), F.lit(50.0))), F.col("cap").cast("double"))
    many = counts.groupBy("source").agg(F.sum("n").alias("docs")).select("source", F.ceil(F.col("docs") / bucket).alias("buckets"))
    use = use.withColumn("rate", rate).withColumn("frac", F.col("rate") - F.floor("rate")).join(F.broadcast(many.join(solved.select("source"), "source")), "source")
    use = use.withColumn("u", F.xxhash64("doc_id", F.lit(seed))).withColumn("b", F.pmod("u", F.col("buckets")))
    from pyspark.sql import Window

    w = Window.partitionBy("source", "b").orderBy("tokens", "u", "doc_id")
    start = F.pmod(F.xxhash64("source", "b", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    upto = F.sum("frac").over(w.rowsBetween(Window.unboundedPreceding, 0)) + start
    # a document gets its extra copy where the running sum passes a whole number
    extra = F.floor(upto + 1e-9) - F.floor(F.coalesce(F.lag("upto").over(w), start) + 1e-9)
    use = use.withColumn("upto", upto).withColumn("copies", F.least((F.floor("rate") + extra).cast("int"), F.col("cap")))
    chosen = use.where("copies > 0").select("doc_id", "source", "tokens", "copies")
    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("n_documents"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"))
    r = solved.select("source", "target_share", F.round("goal").cast("bigint").alias("target_tokens"), "cap").join(got, "source", "left").fillna(0, ["tokens", "n_documents", "n_copies", "most_copies"])
    all_ = r.agg(F.sum("tokens").alias("sum"))
    goal = solved.agg((F.sum("goal") / F.sum("target_share")).alias("table"))  # tokens of the whole mixture
    report = r.crossJoin(F.broadcast(all_)).crossJoin(F.broadcast(goal)).select(  # one row each
        "source", "target_share", F.round(F.try_divide("tokens", "table"), 6).alias("share_of_goal"), F.round(F.try_divide("tokens", "sum"), 6).alias("share_of_mixture"),
        "target_tokens", "tokens", "n_documents", "n_copies", "most_copies", F.col("cap").alias("max_repeats"),
    )
    return chosen, report

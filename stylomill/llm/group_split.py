"""Train, validation and test splits that keep linked records together: component swap search by parallel annealing.

Authors that a row names together are linked; a component of linked authors goes to one split whole. Components with more than
1/`heavy` of all rows (at most `heavy` of them, whatever the data) are placed first, together; the light ones are dealt to
shards of bounded size that share out what the heavy ones left. Every shard is annealed by several chains at once, from a
hashed assignment, by moving one component or exchanging two; the best chain of each shard is kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from stylomill.functions.text import name_key
from stylomill.llm.cells import pairs_within
from stylomill.operators.graph import connected_components
from stylomill.session import materialize

SPLITS = ("train", "val", "test")


def linked_authors(pairs: DataFrame) -> DataFrame:
    """(author, component) of every author of pairs; NULL and blank names link nothing and are left out."""
    a, b = name_key("author0"), name_key("author1")
    ends = pairs.select(a.alias("a"), b.alias("b")).select(F.coalesce("a", "b").alias("a"), F.coalesce("b", "a").alias("b"))
    return connected_components(ends.distinct()).select(F.col("node").alias("author"), "component")


def linked_pairs(pairs: DataFrame) -> DataFrame:
    """(author_a, author_b), author_a < author_b: different authors of one component."""
    comp = materialize(linked_authors(pairs), "authors")
    return pairs_within(comp, "component", "author").select(F.col("x").alias("author_a"), F.col("y").alias("author_b"))


def anneal(size: np.ndarray, label: np.ndarray, target: np.ndarray, seed: int, steps_each: int = 12, most_steps: int = 60_000) -> tuple[np.ndarray, float]:
    """Split of each component, and its cost: squared deviation of sizes from target * total and of labels from their mean."""
    g = np.random.default_rng(seed)
    n, k = len(size), len(target)
    total = max(1.0, float(size.sum()))
    rate = float(label.sum()) / total
    where = np.searchsorted(np.cumsum(target)[:-1] / max(target.sum(), 1e-9), g.random(n), side="right")
    have, lab = (np.bincount(where, w, minlength=k).astype(float) for w in (size, label))
    goal = target / max(target.sum(), 1e-9) * total

    def cost_of(h, p):
        return float((((h - goal) / total) ** 2).sum() + 0.25 * (((p - rate * h) / total) ** 2).sum())

    cost = cost_of(have, lab)
    best, best_cost = where.copy(), cost
    steps = min(most_steps, max(400, steps_each * n * 4))
    heat = max(1e-9, cost)
    picks, moves, luck = g.integers(0, n, (steps, 2)), g.integers(1, k, steps), g.random(steps)
    for t in range(steps):
        i, j = picks[t]
        a = where[i]
        h, p = have.copy(), lab.copy()
        swap = t % 2 and where[j] != a
        b = where[j] if swap else (a + moves[t]) % k
        di, pi = size[i] - (size[j] if swap else 0), label[i] - (label[j] if swap else 0)
        h[a] -= di
        h[b] += di
        p[a] -= pi
        p[b] += pi
        new = cost_of(h, p)
        if new < cost or luck[t] < np.exp((cost - new) / (heat * (1 - t / steps) ** 3 * 0.05 + 1e-15)):
            have, lab, cost, where[i] = h, p, new, b
            if swap:
                where[j] = a
            if cost < best_cost:
                best, best_cost = where.copy(), cost
    return best, best_cost


def _place(target: np.ndarray, seed: int):
    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("component")
        got, cost = anneal(pdf["n_rows"].to_numpy(float), pdf["n_label"].to_numpy(float), target, seed + 1000 * int(pdf["chain"].iloc[0]) + int(pdf["shard"].iloc[0]))
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "chain": pdf["chain"].iloc[:1], "cost": [cost], "placed": [[{"component": c, "s": int(x)} for c, x in zip(pdf["component"], got)]]})

    return place


def split_by_author(pairs: DataFrame, docs: DataFrame, shares: tuple[float, float, float] = (0.7, 0.1, 0.2), heavy: int = 2000, shard_size: int = 4000, chains: int = 4, seed: int = 11) -> DataFrame:
    """(author, component, split, n_rows): every author of either table in one split, no pair row's two authors apart.

    Shares are of rows of both tables together; the label whose mean is kept is that of pairs (docs count as the mean).
    Authors are compared by name_key; rows without any author are bound to nothing and are no row here (split_rows places them).
    """
    a, b = name_key("author0"), name_key("author1")
    by_pair = pairs.select(F.coalesce(a, b).alias("author"), (F.col("label") == 1).cast("int").alias("y")).groupBy("author").agg(F.count("*").alias("n"), F.sum(F.coalesce("y", F.lit(0))).alias("y"))
    by_doc = docs.select(name_key("author").alias("author")).groupBy("author").agg(F.count("*").alias("n"))
    rows = by_pair.unionByName(by_doc.withColumn("y", F.lit(None).cast("bigint"))).where("author IS NOT NULL")
    mean = by_pair.agg((F.sum("y") / F.sum("n")).alias("m")).first()["m"] or 0.0
    rows = rows.groupBy("author").agg(F.sum("n").alias("n"), F.sum(F.coalesce(F.col("y").cast("double"), F.col("n") * F.lit(float(mean)))).alias("y"))
    linked = linked_authors(pairs)
    authors = rows.join(linked, "author", "full").select("author", F.coalesce("component", "author").alias("component"), F.coalesce("n", F.lit(0)).alias("n_rows"), F.coalesce("y", F.lit(0.0)).alias("y"))
    authors = materialize(authors, "authors")
    comp = authors.groupBy("component").agg(F.sum("n_rows").alias("n_rows"), F.sum("y").alias("n_label"))
    total = authors.agg(F.sum("n_rows").alias("n")).first()["n"] or 0
    big = F.col("n_rows") * heavy > F.lit(total)
    weight = comp.groupBy(big.alias("big")).agg(F.count("*").alias("n"), F.sum("n_rows").alias("rows")).collect()  # two rows
    light = next((r for r in weight if not r["big"]), None)
    want = np.array(shares, float)
    schema = "shard int, chain int, cost double, placed array<struct<component:string,s:int>>"

    def run(part: DataFrame, shard, target: np.ndarray) -> DataFrame:
        copies = part.withColumn("shard", shard).withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1))))
        tried = copies.groupBy("shard", "chain").applyInPandas(_place(target, seed), schema)
        best = tried.groupBy("shard").agg(F.min_by("placed", F.struct("cost", "chain")).alias("placed"))
        return best.select(F.explode("placed").alias("p")).select("p.component", "p.s")

    done = materialize(run(comp.where(big), F.lit(0), want), "heavy")
    if light:
        have = {r["s"]: r["n"] for r in done.join(comp, "component").groupBy("s").agg(F.sum("n_rows").alias("n")).collect()}  # three rows
        left = np.maximum(want * total - [have.get(k, 0) for k in range(3)], 0)
        shards = max(1, -(-light["n"] // shard_size))
        done = done.unionByName(run(comp.where(~big), F.pmod(F.xxhash64("component", F.lit(seed)), F.lit(shards)).cast("int"), left if left.sum() else want))
    name = F.element_at(F.array(*map(F.lit, SPLITS)), F.col("s") + 1)
    return authors.join(done.withColumn("split", name), "component").select("author", "component", "split", "n_rows")


def split_rows(pairs: DataFrame, docs: DataFrame, shares: tuple[float, float, float] = (0.7, 0.1, 0.2), seed: int = 11) -> DataFrame:
    """(source, id, other_id, author, split): every row of both tables, source 'pairs' or 'docs'; docs have no other_id.

    Rows with an author have its split. The others are placed by their hashed id (or text), in shares that fill what those lack.
    """
    none = F.lit(None).cast("bigint")
    in_pairs = pairs.select(F.lit("pairs").alias("source"), F.col("id0").alias("id"), F.col("id1").alias("other_id"), F.coalesce(name_key("author0"), name_key("author1")).alias("author"), F.coalesce("text0", "text1").alias("text"))
    rows = in_pairs.unionByName(docs.select(F.lit("docs").alias("source"), "id", none.alias("other_id"), name_key("author").alias("author"), "text"))
    authors = materialize(split_by_author(pairs, docs, shares, seed=seed), "split")
    have = {r["split"]: r["n"] for r in authors.groupBy("split").agg(F.sum("n_rows").alias("n")).collect()}  # three rows
    free = rows.where("author IS NULL")
    want = np.array(shares, float) / sum(shares)
    held = np.array([have.get(x, 0) for x in SPLITS], float)
    left = np.maximum(want * (held.sum() + free.count()) - held, 0)
    cut = np.cumsum(left) / left.sum() if left.sum() else np.cumsum(want)
    key = F.coalesce(F.col("id").cast("string"), F.col("other_id").cast("string"), "text", F.lit(""))
    u = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    placed = free.withColumn("split", F.when(u < float(cut[0]), SPLITS[0]).when(u < float(cut[1]), SPLITS[1]).otherwise(SPLITS[2]))
    bound = rows.where("author IS NOT NULL").join(authors.select("author", "split"), "author")
    return bound.select("source", "id", "other_id", "author", "split").unionByName(placed.select("source", "id", "other_id", "author", "split"))

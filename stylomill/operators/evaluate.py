"""Verification metrics of scored pairs: ROC, equal error rate, metrics at a threshold, AUC, average precision.

Curves live on distinct scores: rows are folded by score first, so windows run over distinct scores only. For continuous scores
of a corpus too large for one sorted task, round them (`digits`): the error of the curve is then below half a step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stylomill.functions.text import cosine
from stylomill.operators.ranks import numbered_within


def cosine_pairs(vectors: DataFrame) -> DataFrame:
    """(pair_id, label, score): each vector with the next one of its label and with one of another, score the cosine mapped to [0, 1].

    `vectors` has vec_id (one row each), embedding and label. pair_id is twice the first vector's id, and one more for pairs of
    different labels. Ids alone are put in order, whatever the size of a label; vectors are fetched for the pairs.
    """
    v = vectors.where("embedding IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL")
    r = numbered_within(v.select("vec_id", "label"), "label", "vec_id")
    x, y = r.alias("x"), r.alias("y")
    same = x.join(y, (F.col("x.label") == F.col("y.label")) & (F.col("x.r") + 1 == F.col("y.r"))).select(F.col("x.vec_id").alias("u"), F.col("y.vec_id").alias("v"), F.lit(1).alias("label"))
    other = x.join(y, (F.col("x.r") == F.col("y.r")) & (F.col("x.label") + 1 == F.col("y.label"))).select(F.col("x.vec_id").alias("u"), F.col("y.vec_id").alias("v"), F.lit(0).alias("label"))
    both = same.unionByName(other).join(v.select(F.col("vec_id").alias("u"), F.col("embedding").alias("a")), "u").join(v.select(F.col("vec_id").alias("v"), F.col("embedding").alias("b")), "v")
    return both.select((F.col("u") * 2 + 1 - F.col("label")).cast("bigint").alias("pair_id"), "label", ((cosine(F.col("a"), F.col("b")) + 1) / 2).alias("score"))


def _keys(keys: list[str]) -> list[Column]:
    return [F.col(k) for k in keys] or [F.lit(1)]


def roc(scored: DataFrame, keys: list[str] = [], digits: int | None = None) -> DataFrame:  # noqa: B006
    """Per key: threshold, fpr, tpr, precision and counts at each distinct score, highest first; NULL scores and labels are left out.

    The starting point (threshold infinity) isn't a row. Rates without a class are NULL.
    """
    s = F.round("score", digits) if digits is not None else F.col("score")
    by = scored.where("score IS NOT NULL AND label IN (0, 1)").groupBy(*keys, s.alias("threshold")).agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    w = Window.partitionBy(*_keys(keys)).orderBy(F.desc("threshold"))
    every = Window.partitionBy(*_keys(keys))
    c = by.select(*keys, "threshold", "p", "n", F.sum("p").over(w).alias("tp"), F.sum("n").over(w).alias("fp"), F.sum("p").over(every).alias("pos"), F.sum("n").over(every).alias("neg"))
    return c.select(*keys, "threshold", "p", "n", "tp", "fp", "pos", "neg", F.try_divide("fp", "neg").alias("fpr"), F.try_divide("tp", "pos").alias("tpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def roc_points(scored: DataFrame, keys: list[str] = [], digits: int | None = None) -> DataFrame:  # noqa: B006
    """The corners of the curve: points where neighbours lie on one line with them are dropped; the last point stays."""
    w = Window.partitionBy(*_keys(keys)).orderBy(F.desc("threshold"))
    r = roc(scored, keys, digits)
    # at the first point the one before is (0, 0), at threshold infinity
    flat = (F.col("p") * F.lead("n").over(w)) == (F.lead("p").over(w) * F.col("n"))
    return r.withColumn("drop", F.coalesce(flat, F.lit(False))).where("NOT drop").select(*keys, "threshold", "fpr", "tpr", "tp", "fp")


def eer(scored: DataFrame, keys: list[str] = [], digits: int | None = None) -> DataFrame:  # noqa: B006
    """(eer, tau) per key: at the corner (the start, at infinity, included) where false accept and reject rates are closest, the first of equals."""
    c = roc_points(scored, keys, digits)
    start = c.groupBy(*keys).agg(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")) if keys else c.agg(F.count("*").alias("c")).where("c > 0").select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    pts = c.select(*keys, "threshold", "fpr", "tpr").unionByName(start.select(*keys, "threshold", "fpr", "tpr")).where("fpr IS NOT NULL AND tpr IS NOT NULL")
    gap = F.abs(1 - F.col("tpr") - F.col("fpr"))
    best = pts.groupBy(*keys).agg(F.min_by(F.struct("threshold", "fpr", "tpr"), F.struct(F.round(gap, 12), -F.col("threshold"))).alias("b"))
    return best.where("b IS NOT NULL").select(*keys, ((F.col("b.fpr") + 1 - F.col("b.tpr")) / 2).alias("eer"), F.col("b.threshold").alias("tau"))


def confusion(scored: DataFrame, tau: DataFrame | float, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """tn, fp, fn, tp per key; predicted positive from tau on. tau: a number, or one row (or one per key) with a column tau."""
    s = scored.where("score IS NOT NULL AND label IN (0, 1)")
    s = s.withColumn("tau", F.lit(tau)) if not isinstance(tau, DataFrame) else s.join(F.broadcast(tau.select(*keys, "tau")), keys) if keys else s.crossJoin(F.broadcast(tau.select("tau")))  # a row for each experiment
    hit = F.col("score") >= F.col("tau")
    one = F.col("label") == 1
    return s.groupBy(*keys, "tau").agg(F.count_if(~one & ~hit).alias("tn"), F.count_if(~one & hit).alias("fp"), F.count_if(one & ~hit).alias("fn"), F.count_if(one & hit).alias("tp"))


def metrics_at(scored: DataFrame, tau: DataFrame | float, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Accuracy, precision, recall and F1 at tau; 0 where nothing is predicted or there."""
    c = confusion(scored, tau, keys)
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(*keys, "tau", div(tp + tn, tp + tn + fp + fn).alias("accuracy"), div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def roc_auc(scored: DataFrame, keys: list[str] = [], digits: int | None = None) -> DataFrame:  # noqa: B006
    """Area under the curve, ties counting half; NULL if a class is missing."""
    r = roc(scored, keys, digits)
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2))
    return r.groupBy(*keys).agg(F.try_divide(area, F.max("pos") * F.max("neg")).alias("roc_auc"))


def average_precision(scored: DataFrame, keys: list[str] = [], digits: int | None = None) -> DataFrame:  # noqa: B006
    """Sum of recall steps times precision, over distinct scores; NULL without positives."""
    r = roc(scored, keys, digits)
    return r.groupBy(*keys).agg(F.try_divide(F.sum(F.col("p") * F.col("precision")), F.max("pos")).alias("average_precision"))


def evaluation(scored: DataFrame, validation: DataFrame | None = None, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """One row per key with tau and every metric; tau comes from the validation scores if given, else (optimistically) from the same."""
    tau = eer(validation if validation is not None else scored, keys if validation is None else [])
    m = metrics_at(scored, tau, keys if validation is None else [])
    if keys:
        return m.join(eer(scored, keys).select(*keys, "eer"), keys).join(roc_auc(scored, keys), keys).join(average_precision(scored, keys), keys)
    return m.crossJoin(eer(scored).select("eer")).crossJoin(roc_auc(scored)).crossJoin(average_precision(scored))  # one row each

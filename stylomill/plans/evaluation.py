"""Queries on scored pairs and on token attributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from stylomill.functions.text import hash_uniform, words
from stylomill.operators import evaluate as V, explain as P
from stylomill.plans.common import corpus, table
from stylomill.plans.registry import query
from stylomill.session import materialize
from stylomill.plans.sql import CORPUS, hash_uniform as hash_uniform_sql, words as words_sql

_COS = "list_sum([CAST(x[i] AS DOUBLE) * CAST(y[i] AS DOUBLE) for i in range(1, len(x) + 1)]) / (sqrt(list_sum([CAST(v AS DOUBLE) * CAST(v AS DOUBLE) for v in x])) * sqrt(list_sum([CAST(v AS DOUBLE) * CAST(v AS DOUBLE) for v in y])))"
_SCORED = f"""WITH r AS (SELECT vec_id, embedding, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) r FROM embeddings),
pr AS (SELECT a.vec_id u, b.vec_id v, a.embedding x, b.embedding y, 1 label FROM r a JOIN r b ON a.label = b.label AND b.r = a.r + 1
UNION ALL SELECT a.vec_id, b.vec_id, a.embedding, b.embedding, 0 FROM r a JOIN r b ON b.label = a.label + 1 AND a.r = b.r),
sc AS (SELECT CAST(u * 2 + 1 - label AS BIGINT) pair_id, CAST(label AS INT) label, round(({_COS} + 1) / 2, 4) score FROM pr),
g AS (SELECT score threshold, count(*) FILTER (label = 1) p, count(*) FILTER (label = 0) n FROM sc GROUP BY score),
c AS (SELECT *, sum(p) OVER (ORDER BY threshold DESC) tp, sum(n) OVER (ORDER BY threshold DESC) fp, sum(p) OVER () pos, sum(n) OVER () neg FROM g),
k AS (SELECT *, lead(p) OVER (ORDER BY threshold DESC) p2, lead(n) OVER (ORDER BY threshold DESC) n2 FROM c),
corners AS (SELECT threshold, fp / neg fpr, tp / pos tpr, tp, fp FROM k WHERE NOT coalesce(p * n2 = p2 * n, false)),
pts AS (SELECT threshold, fpr, tpr FROM corners UNION ALL SELECT 'infinity'::DOUBLE, 0, 0),
best AS (SELECT * FROM pts ORDER BY round(abs(1 - tpr - fpr), 12), threshold DESC LIMIT 1),
cm AS (SELECT count(*) FILTER (label = 0 AND score < t.threshold) tn, count(*) FILTER (label = 0 AND score >= t.threshold) fp, count(*) FILTER (label = 1 AND score < t.threshold) fn, count(*) FILTER (label = 1 AND score >= t.threshold) tp, any_value(t.threshold) tau FROM sc, best t)
"""


def _scored(spark, d):
    return V.cosine_pairs(table(spark, d, "embeddings")).withColumn("score", F.round("score", 4))


@query(_SCORED + "SELECT pair_id, label, score FROM sc")
def cosine_pairs(spark, d):
    return _scored(spark, d)


@query(_SCORED + "SELECT round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM corners")
def roc_points(spark, d):
    r = V.roc_points(_scored(spark, d))
    return r.select(*[F.round(c, 6).alias(c) for c in ("threshold", "fpr", "tpr")], "tp", "fp")


@query(_SCORED + "SELECT round((fpr + 1 - tpr) / 2, 6) AS eer, round(threshold, 6) AS tau FROM best")
def eer_tau(spark, d):
    return V.eer(_scored(spark, d)).select(F.round("eer", 6).alias("eer"), F.round("tau", 6).alias("tau"))


@query(_SCORED + "SELECT round(tau, 6) AS tau, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM cm")
def metrics_at_tau(spark, d):
    s = _scored(spark, d)
    return V.metrics_at(s, V.eer(s)).select(*[F.round(c, 6).alias(c) for c in ("tau", "accuracy", "precision", "recall", "f1")])


@query(_SCORED + "SELECT round(sum(n * (tp - p / 2)) / (max(pos) * max(neg)), 6) AS roc_auc FROM c")
def roc_auc(spark, d):
    return V.roc_auc(_scored(spark, d)).select(F.round("roc_auc", 6).alias("roc_auc"))


@query(_SCORED + "SELECT round(sum(p * (tp / (tp + fp))) / max(pos), 6) AS average_precision FROM c")
def average_precision(spark, d):
    return V.average_precision(_scored(spark, d)).select(F.round("average_precision", 6).alias("average_precision"))


@query(_SCORED + "SELECT tn, fp, fn, tp FROM cm")
def confusion_matrix(spark, d):
    s = _scored(spark, d)
    return V.confusion(s, V.eer(s)).select("tn", "fp", "fn", "tp")


_BY = "PARTITION BY model, test_set, seed"
_GRID = f"""WITH RECURSIVE base AS ({_SCORED.replace('WITH r AS', 'WITH r AS', 1)} SELECT * FROM sc), sc3 AS (SELECT *, CASE WHEN pair_id % 7 < 4 THEN 'a' ELSE 'b' END model, CASE WHEN pair_id % 5 < 3 THEN 'AA' ELSE 'AT' END test_set, pair_id % 3 AS seed FROM base),
g3 AS (SELECT model, test_set, seed, score threshold, count(*) FILTER (label = 1) p, count(*) FILTER (label = 0) n FROM sc3 GROUP BY ALL),
c3 AS (SELECT *, sum(p) OVER ({_BY} ORDER BY threshold DESC) tp, sum(n) OVER ({_BY} ORDER BY threshold DESC) fp, sum(p) OVER ({_BY}) pos, sum(n) OVER ({_BY}) neg FROM g3),
k3 AS (SELECT *, lead(p) OVER ({_BY} ORDER BY threshold DESC) p2, lead(n) OVER ({_BY} ORDER BY threshold DESC) n2 FROM c3),
pts3 AS (SELECT model, test_set, seed, threshold, fp / neg fpr, tp / pos tpr FROM k3 WHERE NOT coalesce(p * n2 = p2 * n, false) UNION ALL SELECT DISTINCT model, test_set, seed, 'infinity'::DOUBLE, 0, 0 FROM c3),
best3 AS (SELECT model, test_set, seed, (fpr + 1 - tpr) / 2 eer, threshold tau FROM pts3 QUALIFY row_number() OVER ({_BY} ORDER BY round(abs(1 - tpr - fpr), 12), threshold DESC) = 1),
cm3 AS (SELECT model, test_set, seed, any_value(tau) tau, any_value(eer) eer, count(*) n, count(*) FILTER (label = 0 AND score < tau) tn, count(*) FILTER (label = 0 AND score >= tau) fp, count(*) FILTER (label = 1 AND score < tau) fn, count(*) FILTER (label = 1 AND score >= tau) tp FROM sc3 JOIN best3 USING (model, test_set, seed) GROUP BY ALL),
a3 AS (SELECT model, test_set, seed, round(sum(n * (tp - p / 2)) / (max(pos) * max(neg)), 6) roc_auc, round(sum(p * (tp / (tp + fp))) / max(pos), 6) average_precision FROM c3 GROUP BY ALL)
SELECT model, test_set, seed, n, round(tau, 6) AS tau, round(eer, 6) AS eer, round((tp + tn) / n, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, roc_auc, average_precision FROM cm3 JOIN a3 USING (model, test_set, seed)"""


@query(_GRID)
def experiment_grid(spark, d):
    """Every metric of each experiment (model, test set, seed); here remainders of the pair id stand in for what names it."""
    i, keys = F.col("pair_id"), ["model", "test_set", "seed"]
    s = _scored(spark, d).withColumns({"model": F.when(i % 7 < 4, "a").otherwise("b"), "test_set": F.when(i % 5 < 3, "AA").otherwise("AT"), "seed": i % 3})
    s = materialize(s, "scored")
    n = s.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.join(V.evaluation(s, keys=keys), keys).select(*keys, "n", *[F.round(c, 6).alias(c) for c in ("tau", "eer", "accuracy", "precision", "recall", "f1", "roc_auc", "average_precision")])


# attributions for the words of tweets, invented by hash: three models, score in (-1, 1); marks of word starts and pieces on some
_SHAP = f"""WITH {CORPUS}, w AS (SELECT id, {words_sql('text')} a FROM corpus WHERE lower(genre) = 'tweet'), t AS (SELECT id, unnest(a) token, unnest(range(1, len(a) + 1)) pos FROM w),
s AS (SELECT m.model, id AS sample, pos, CASE WHEN pos % 5 = 0 THEN '##' || token WHEN pos % 3 = 0 THEN 'Ġ' || token ELSE token END token, round(2 * {hash_uniform_sql(7, 'm.model', 'id', 'pos')} - 1, 3) s1 FROM t, (VALUES ('a'), ('b'), ('c')) m(model)),
imp AS (SELECT model, nullif(trim(lower(replace(token, 'Ġ', ''))), '') token, sum(abs(s1)) importance FROM s GROUP BY 1, 2 HAVING nullif(trim(lower(replace(token, 'Ġ', ''))), '') IS NOT NULL),
mm AS (SELECT *, coalesce((importance - min(importance) OVER (PARTITION BY model)) / nullif(max(importance) OVER (PARTITION BY model) - min(importance) OVER (PARTITION BY model), 0), 0) scaled FROM imp)
"""


def _attributions(spark, d):
    t = corpus(spark, d).where("lower(genre) = 'tweet'").select("id", F.posexplode(words("text")).alias("p", "token")).withColumn("pos", F.col("p") + 1)
    t = t.crossJoin(F.broadcast(spark.createDataFrame([("a",), ("b",), ("c",)], "model string")))  # three rows
    token = F.when(F.col("pos") % 5 == 0, F.concat(F.lit("##"), F.col("token"))).when(F.col("pos") % 3 == 0, F.concat(F.lit("Ġ"), F.col("token"))).otherwise(F.col("token"))
    return t.select("model", F.col("id").alias("sample"), "pos", token.alias("token"), F.round(2 * hash_uniform(7, "model", "id", "pos") - 1, 3).alias("s1"))


@query(_SHAP + "SELECT model, token, round(importance, 4) AS importance FROM imp")
def shap_token_importance(spark, d):
    return P.token_importance(_attributions(spark, d)).select("model", "token", F.round("importance", 4).alias("importance"))


@query(_SHAP + "SELECT model, token, round(scaled, 5) AS scaled FROM mm")
def shap_minmax(spark, d):
    return P.min_max(P.token_importance(_attributions(spark, d))).select("model", "token", F.round("scaled", 5).alias("scaled"))


@query(_SHAP + "SELECT token, round(avg(scaled), 5) AS mean_scaled FROM mm GROUP BY token HAVING count(*) = 3 ORDER BY round(avg(scaled), 9) DESC, token LIMIT 15")
def shap_common_topk(spark, d):
    return P.common_top(P.token_importance(_attributions(spark, d)), 15, 3).select("token", F.round("mean_scaled", 5).alias("mean_scaled"))


@query(_SHAP + "SELECT model, sample, nullif(trim(lower(replace(token, 'Ġ', ''))), '') AS token, round(sum(s1), 4) AS score FROM s GROUP BY 1, 2, 3 HAVING nullif(trim(lower(replace(token, 'Ġ', ''))), '') IS NOT NULL")
def shap_sample_scores(spark, d):
    return P.sample_scores(_attributions(spark, d)).select("model", "sample", "token", F.round("score", 4).alias("score"))


@query(_SHAP + """, n AS (SELECT *, sum(CASE WHEN token NOT LIKE '##%' OR pos = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY model, sample ORDER BY pos) word_no FROM s)
SELECT model, sample, CAST(word_no AS BIGINT) AS word_no, lower(string_agg(regexp_replace(token, '^##', ''), '' ORDER BY pos)) AS word, round(sum(s1), 4) AS score FROM n GROUP BY model, sample, word_no""")
def shap_word_merge(spark, d):
    return P.merge_words(_attributions(spark, d)).select("model", "sample", "word_no", "word", F.round("score", 4).alias("score"))

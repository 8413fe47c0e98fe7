import random

import pytest

from stylomill.operators import evaluate as V, explain as P, stats as S


def scored(spark, rows):
    return spark.createDataFrame([(i, y, float(s)) for i, (y, s) in enumerate(rows)], "pair_id BIGINT, label INT, score DOUBLE")


def test_extremes(spark):
    assert V.roc_auc(scored(spark, [(1, 0.5), (0, 0.5), (1, 0.5)])).first()["roc_auc"] == 0.5
    assert V.roc_auc(scored(spark, [(1, 0.9), (0, 0.1)])).first()["roc_auc"] == 1.0
    assert V.roc_auc(scored(spark, [(1, 0.1), (0, 0.9)])).first()["roc_auc"] == 0.0
    assert V.roc_auc(scored(spark, [(1, 0.1), (1, 0.9)])).first()["roc_auc"] is None
    m = V.metrics_at(scored(spark, [(1, 0.1), (0, 0.2)]), 0.9).first()
    assert (m["precision"], m["recall"], m["f1"], m["accuracy"]) == (0.0, 0.0, 0.0, 0.5)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    g = random.Random(seed)
    rows = [(int(g.random() < 0.5), round(g.random(), 1)) for _ in range(60)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert V.roc_auc(scored(spark, rows)).first()["roc_auc"] == pytest.approx(auc)
    ap, seen = 0.0, 0
    for t in sorted({s for _, s in rows}, reverse=True):
        tp, all_ = sum(p >= t for p in pos), sum(s >= t for _, s in rows)
        ap += (tp - seen) / len(pos) * tp / all_
        seen = tp
    assert V.average_precision(scored(spark, rows)).first()["average_precision"] == pytest.approx(ap)
    e = V.eer(scored(spark, rows)).first()
    fpr, fnr = sum(n >= e["tau"] for n in neg) / len(neg), sum(p < e["tau"] for p in pos) / len(pos)
    assert e["eer"] == pytest.approx((fpr + fnr) / 2)
    r = V.evaluation(scored(spark, rows)).first()
    assert r["roc_auc"] == pytest.approx(auc)


def test_keys(spark):
    d = spark.createDataFrame([("x", 1, 0.9), ("x", 0, 0.2), ("y", 1, 0.1), ("y", 0, 0.2), ("y", None, 0.2), ("y", 1, None)], "k STRING, label INT, score DOUBLE")
    assert {r["k"]: r["roc_auc"] for r in V.evaluation(d, keys=["k"]).collect()} == {"x": 1.0, "y": 0.0}


def test_words(spark):
    t = "model STRING, sample INT, pos INT, token STRING, s0 DOUBLE, s1 DOUBLE"
    w = spark.createDataFrame([("m", 0, i, x, 0.0, s) for i, (x, s) in enumerate([("[CLS]", 9.0), ("play", 1.0), ("##ing", 2.0), ("[SEP]", 9.0)])], t)
    assert [(r["word"], r["score"]) for r in P.merge_words(w).collect()] == [("playing", 3.0)]
    b = spark.createDataFrame([("m", 0, 0, "Ġplay", 0.0, 1.0), ("m", 0, 1, "ing", 0.0, 2.0)], t)
    assert [(r["word"], r["score"]) for r in P.merge_words(b, "byte_bpe").collect()] == [("playing", 3.0)]
    i = P.min_max(spark.createDataFrame([("m", "a", 2.0), ("m", "b", 2.0)], "model STRING, token STRING, importance DOUBLE"))
    assert {r["scaled"] for r in i.collect()} == {0.0}


def test_stats_edges(spark, frame):
    assert S.word_stats(frame([])).count() == 0
    r = {x["scope"]: x for x in S.word_stats(frame([(1, "a", None, "x y"), (2, "a", "Tweet", None), (3, None, "Tweet", " ")])).collect()}
    assert (r["ALL"]["n_docs"], r["ALL"]["n_authors"], r["ALL"]["n_empty"]) == (3, 1, 2) and r["UNKNOWN"]["n_docs"] == 1
    assert [(x["bin"], x["n"]) for x in S.histogram(frame([(1, "a", "T", "x y"), (2, "a", "T", "z w")])).collect()] == [(26, 2)]
    assert S.histogram(frame([])).count() == 0 and S.boxplot(frame([])).count() == 0 and S.ecdf(frame([])).count() == 0

import itertools
import random

from stylomill.operators import pairing as P, quality as Q, stats as S
from stylomill.operators.graph import connected_components
from stylomill.operators.ranks import numbered
from stylomill.schemas import PAIRS, assert_unique, coerce_ids, ensure_columns, latest, require_columns

import pytest


def corpus(frame, counts, genre="Article", start=0):
    rows, i = [], start
    for a, n in counts.items():
        for _ in range(n):
            rows.append((i, a, genre, f"text {i}"))
            i += 1
    return frame(rows)


def test_positives(spark, frame):
    p = P.positives(corpus(frame, {"a": 1, "b": 2, "c": 3, "d": 5}), "AA").collect()
    n = {a: sum(r["author"] == a for r in p) for a in "abcd"}
    assert n == {"a": 0, "b": 1, "c": 1, "d": 2}
    ids = [x for r in p for x in (r["id0"], r["id1"])]
    assert len(ids) == len(set(ids))
    assert P.capped(P.positives(corpus(frame, {"x": 240}), "AA"), 100).count() == 50


def test_negatives_and_balance(spark, frame):
    c = corpus(frame, {"a": 9, "b": 7, "c": 4, "d": 6})
    b = P.balanced(c, "AA", 1000).collect()
    pos, neg = [r for r in b if r["label"] == 1], [r for r in b if r["label"] == 0]
    assert len(pos) == len(neg) > 0
    assert all(r["author0"] == r["author1"] for r in pos) and all(r["author0"] != r["author1"] for r in neg)
    for part in (pos, neg):
        ids = [x for r in part for x in (r["id0"], r["id1"])]
        assert len(ids) == len(set(ids))
    assert Q.repeated_documents(P.balanced(c, "AA", 1000)).count() == 0
    hot = P.one_use_negatives(corpus(frame, {"a": 40, "b": 5}).select("id", "author")).collect()
    assert len({x for r in hot for x in r}) == 2 * len(hot)
    at = corpus(frame, {"a": 4, "b": 5, "c": 3}).unionByName(corpus(frame, {"a": 3, "b": 2, "c": 6, "d": 1}, "Tweet", 100))
    b = P.balanced(at, "AT", 100).collect()
    assert b and all(r["id0"] < 100 <= r["id1"] for r in b) and all((r["author0"] == r["author1"]) == (r["label"] == 1) for r in b)
    assert P.balanced(frame([]), "AA", 10).count() == 0


def test_balanced_without_target(spark, frame):
    names = {x: 60 for x in "abcdef"}
    at = corpus(frame, names).unionByName(corpus(frame, names, "Tweet", 1000))
    b = [r["label"] for r in P.balanced(at, "AT", None).collect()]
    assert b.count(1) == b.count(0) == 300  # 50 an author


def test_split(spark, frame):
    for n, want in ((5, 1), (12, 2)):
        s = P.author_split(corpus(frame, {f"a{i}": 2 for i in range(n)})).collect()
        assert sum(r["split"] == "val" for r in s) == want and len(s) == n
    s = P.author_split(corpus(frame, {f"a{i}": 2 for i in range(12)}), rounding="floor").collect()
    assert sum(r["split"] == "val" for r in s) == 3


def test_matching_bound(spark, frame):
    rows = [(1, "x", "Article", ""), (2, "x", "Article", ""), (3, "y", "Article", ""), (4, "x", "Tweet", ""), (5, "x", "Tweet", ""), (6, "x", "Tweet", "")]
    r = S.matching_bounds(frame(rows)).first()
    assert (r["pos_upper"], r["neg_upper"], r["authors_both"]) == (2, 1, 1)
    g = random.Random(5)
    for _ in range(3):
        a, t = [g.choice("xyz") for _ in range(g.randint(1, 6))], [g.choice("xyz") for _ in range(g.randint(1, 6))]
        m = min(len(a), len(t))
        best = max(sum(p != q for p, q in zip(a[:m], s)) for s in itertools.permutations(t[:m]))
        rows = [(i, x, "Article", "") for i, x in enumerate(a)] + [(50 + i, x, "Tweet", "") for i, x in enumerate(t)]
        assert S.matching_bounds(frame(rows)).first()["neg_upper"] == best
    assert S.matching_bounds(frame([])).first()["neg_upper"] == 0


def test_quality(spark):
    rows = [(1, "t", "t u", "a", "a", 1, 2, "train"), (1, "t", "v", "a", "b", 1, 1, "val"), (0, "T  x", None, "a", "a", 3, 2, "val"), (None, None, None, None, "b", None, 4, "test")]
    p = spark.createDataFrame(rows, "label INT, text0 STRING, text1 STRING, author0 STRING, author1 STRING, id0 BIGINT, id1 BIGINT, split STRING")
    assert Q.self_pairs(p).first()["n_self"] == 1
    r = Q.label_conflicts(p).first()
    assert (r["n_conflicts"], r["n_unknown"]) == (2, 1)
    assert sorted((x["split"], x["id"]) for x in Q.id_leakage(p).collect()) == [("val", 1), ("val", 2)]
    assert {x["split"]: x["n_leaked"] for x in Q.text_leakage(p).collect()} == {"val": 1}
    assert {x["id"]: x["diff"] for x in Q.doc_balance(p).collect()} == {1: 3, 2: 0, 3: -1}


def test_schemas(spark, frame):
    d = frame([(1, "a", "T", "x")])
    with pytest.raises(ValueError, match="nope"):
        require_columns(d, "id", "nope")
    assert ensure_columns(d, PAIRS).columns == ["label", "text0", "text1", "author0", "author1", "id0", "id1"]
    s = spark.createDataFrame([("1",), ("1.5",), (None,), ("x",)], "id STRING")
    assert [r["id"] for r in coerce_ids(s, "id").collect()] == [1]
    with pytest.raises(ValueError):
        assert_unique(frame([(1, "a", "T", "x"), (1, "b", "T", "y")]), "id")
    e = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (None, "x", 3)], "id BIGINT, text STRING, ingested_at INT")
    assert [(r["id"], r["text"]) for r in latest(e, "text").collect()] == [(1, "new")]


def test_numbered(spark):
    d = spark.range(1000).selectExpr("(id * 37) % 1000 AS k")
    assert all(r["rn"] == r["k"] + 1 for r in numbered(d, "k").collect())
    assert numbered(spark.range(0), "id").count() == 0


def test_components(spark):
    g = random.Random(3)
    e = [(g.randint(0, 80), g.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 160)] + [(7, 7), (None, 3), (500, 500)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in e:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(e, "a BIGINT, b BIGINT")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a BIGINT, b BIGINT")).count() == 0

import random

import pytest

from stylomill.operators import segments as G
from stylomill.operators.ranks import numbered_within


def model(genre, counts):
    """(words, documents) of each segment, told document by document."""
    out, buf = [], []
    size = lambda: sum(n for _, n in buf)
    for i, w in counts:
        if genre == "tweet":
            if w > 420:
                buf = []
                out.append((420, [i]))
                continue
            if not w:
                continue
            if size() + w > 420:
                buf = []
            buf.append((i, w))
            if size() >= 300:
                out.append((size(), [k for k, _ in buf]))
                buf = []
        else:
            while w:
                n = min(420 - size(), w)
                buf.append((i, n))
                w -= n
                if size() >= 300:
                    out.append((size(), list(dict.fromkeys(k for k, _ in buf))))
                    buf = []
    return out


def run(spark, genre, counts, size):
    rows = [(i, "a", genre.title(), " ".join(f"w{i}x{j}" for j in range(w))) for i, w in counts]
    corpus = spark.createDataFrame(rows, "id BIGINT, author STRING, genre STRING, text STRING")
    parts = G.segment_parts(corpus, genre, run=size)
    got = G.segment_table(parts).orderBy("seg_no").collect()
    return [(r["word_count"], [int(x) for x in r["source_ids"]]) for r in got], parts, corpus


@pytest.mark.parametrize("genre, counts", [("tweet", [100, 150, 80]), ("tweet", [290, 200]), ("tweet", [200, 500, 150]), ("tweet", [150, 150]), ("article", [1000]), ("article", [160, 200]), ("article", [250])])
def test_known(spark, genre, counts):
    c = list(enumerate(counts, 1))
    assert run(spark, genre, c, 2)[0] == model(genre, c)


@pytest.mark.parametrize("genre", ["tweet", "article"])
@pytest.mark.parametrize("seed", [1, 2])
def test_random(spark, genre, seed):
    g = random.Random(seed)
    c = [(i, g.choice([0, 5, 40, 120, 290, 310, 430, 900])) for i in range(60)]
    got, parts, corpus = run(spark, genre, c, 7)
    assert got == model(genre, c)
    assert all(300 <= n <= 420 for n, _ in got)
    for r in G.with_texts(parts, corpus, genre).collect():
        assert 300 <= len([x for x in r["text"].replace("<SEP>", " ").split()]) <= 420


def test_ids_and_nulls(spark, frame):
    rows = [(1, "b", "Tweet", "w " * 300), (2, "a", "Tweet", "w " * 310), (3, None, "Tweet", "w " * 400), (4, "a", "tweet", "w " * 320), (5, "a", "Tweet", None), (None, "a", "Tweet", "w " * 400)]
    t = G.segment_table(G.segment_parts(frame(rows), "tweet"))
    assert [(r["id"], r["author"], r["word_count"]) for r in G.numbered_segments(t).orderBy("id").collect()] == [(0, "a", 310), (1, "a", 320), (2, "b", 300)]
    assert G.segment_table(G.segment_parts(frame([]), "article")).count() == 0


def test_numbers_in_a_hot_group(spark):
    """Nine rows in ten are of one author: numbers as by a window, without a window over the author alone."""
    rows = [(i, "hot" if i % 10 else f"a{i}", (i * 7919) % 1000) for i in range(2000)]
    d = spark.createDataFrame(rows, "id BIGINT, author STRING, o INT").repartition(7)
    got = {r["id"]: r["r"] for r in numbered_within(d, "author", "o", "id").collect()}
    seen, want = {}, {}
    for i, a, _ in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        want[i] = seen[a] = seen.get(a, 0) + 1
    assert got == want
    plan = numbered_within(d, "author", "o", "id")._jdf.queryExecution().optimizedPlan().toString()
    assert all("[author" not in line or "_p" in line or "windowspecdefinition(author" in line and "_n" in line for line in plan.splitlines() if "row_number" in line)
    assert numbered_within(d.limit(0), "author", "o", "id").count() == 0

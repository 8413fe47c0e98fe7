import random
import re
from functools import lru_cache
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stylomill.llm import canonical, crf, group_split, leakage, mixture, near_duplicates as N, packing, personal_data as P, responses as R, shingles as S, split_overlap as O

WORD = re.compile(r"[^\W_]+")


def triples(t, n=3):
    w = WORD.findall((t or "").lower())
    return set(zip(*[w[i:] for i in range(n)]))


def likeness(a, b):
    a, b = triples(a), triples(b)
    return len(a & b) / max(1, len(a | b))


def versions(g, n, words=400):
    """Texts, some of them edited versions of others."""
    out = []
    for _ in range(n):
        if out and g.random() < 0.5:
            w = g.choice(out).split()
            for _ in range(g.randint(0, 6)):
                k = g.randrange(len(w))
                g.choice([lambda: w.pop(k), lambda: w.insert(k, f"new{g.randint(0, 99)}"), lambda: w.__setitem__(k, f"x{g.randint(0, 99)}")])() if len(w) > 9 else None
            out.append(" ".join(w))
        else:
            out.append(" ".join(f"w{g.randint(0, words)}" for _ in range(g.randint(8, 90))))
    return out


def test_shingles():
    texts = ["The cat, the CAT sat!", "", None, "a b", "x_y z\x00w q", "é " * 5]
    h, at = S.tokens(texts, S.WordHashes())
    assert np.bincount(at, minlength=len(texts)).tolist() == [len(WORD.findall((t or "").lower())) for t in texts]
    w, i, _ = S.windows(h, at, 3)
    d, k, tf = S.distinct(w, i)
    assert [int((k == n).sum()) for n in range(len(texts))] == [len(triples(t)) for t in texts]
    assert S.windows(*S.tokens([], S.WordHashes()), 3)[0].size == 0


def test_near_duplicates(spark):
    g = random.Random(1)
    texts = versions(g, 150)
    rows = [(i, "a", t, 0) for i, t in enumerate(texts)] + [(3, "a", texts[3], 1), (900, None, None, 0), (901, "b", " ", 0), (902, "b", "one two three", 0), (903, "b", "one two three", 0), (904, None, texts[5], 0), (None, "b", texts[5], 0)]
    docs = spark.createDataFrame(rows, "id BIGINT, key STRING, text STRING, doc INT")  # extra columns with names that are used inside
    long = {i: t for i, _, t, _ in rows if i is not None and t and len(WORD.findall(t)) >= 8}
    want = {(a, b) for a, b in combinations(sorted(long), 2) if likeness(long[a], long[b]) >= 0.6}
    got = {(r["id_a"], r["id_b"]) for r in N.near_duplicate_pairs(docs, 0.6, 3, 8).collect()}
    assert got <= want and len(got) >= 0.98 * len(want)
    classes = {r["id"]: r for r in N.near_duplicate_classes(docs).collect()}
    assert set(classes) == {r[0] for r in rows if r[0] is not None}
    assert classes[904]["class_id"] == classes[5]["class_id"] and classes[902]["class_id"] == classes[903]["class_id"] == 902
    assert classes[900]["class_id"] == 900 and classes[900]["n_links"] == 0
    empty = spark.createDataFrame([], "id BIGINT, text STRING")
    assert N.near_duplicate_pairs(empty, 0.6, 3, 8).count() == 0 and N.near_duplicate_classes(empty).count() == 0


def test_hot_group_of_near_duplicates(spark):
    g = random.Random(2)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(60):
        w = list(base)
        w[g.randrange(80)] = f"edit{i}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(100 + i, "copy " * 9 + "of a text that all have in common here") for i in range(40)], "id BIGINT, text STRING")
    got = {(r["id_a"], r["id_b"]) for r in N.near_duplicate_pairs(docs, 0.6, 3, 8).collect()}
    want = {(a, b) for a, b in combinations(range(60), 2) if likeness(texts[a], texts[b]) >= 0.6} | set(combinations(range(100, 140), 2))
    assert got <= want and len(got) >= 0.99 * len(want)
    assert {(r["id_a"], r["id_b"]) for r in N.near_duplicate_pairs(docs, 0.6, 3, 8, block=5).collect()} == got


def hot_group(g, versions, others):
    """Versions of one text with edits all over, alike by about 0.5 to 0.8, among twice as many texts of their own."""
    base = [f"b{i}" for i in range(90)]
    out = []
    for i in range(versions):
        w = list(base)
        for k in g.sample(range(90), g.randint(3, 8)):
            w[k] = f"edit{i}x{k}"
        out.append(" ".join(w))
    return out + [" ".join(f"own{i}x{k}" for k in range(40)) for i in range(others)]


def test_hot_group_with_many_edits(spark):
    """Plain likeness near the threshold in a group that holds a third of the rows."""
    texts = hot_group(random.Random(3), 150, 300)
    sets = [triples(t) for t in texts]
    want = {(a, b) for a, b in combinations(range(150), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    got = {(r["id_a"], r["id_b"]) for r in N.near_duplicate_pairs(spark.createDataFrame(list(enumerate(texts)), "id BIGINT, text STRING"), 0.6, 3, 8).collect()}
    assert len(want) > 2000 and got <= want and len(got) >= 0.999 * len(want)


def test_sampler_estimates_weighted_jaccard():
    s = N.Sampler(4000, np.linspace(0.5, 1.5, 8), seed=1)
    weights = np.linspace(0.5, 1.5, 8)
    h = S.mix(np.arange(1, 31, dtype=np.uint64)) >> np.uint64(10)
    g = np.random.default_rng(4)
    la, lb = g.integers(0, 8, 20), g.integers(0, 8, 20)
    wa, wb = weights[la], weights[lb]
    got = s(np.concatenate((h[:20], h[10:])), np.concatenate((la, lb)), np.array([0, 20, 40]))
    low, high = np.minimum(wa[10:], wb[:10]).sum(), np.maximum(wa[10:], wb[:10]).sum()
    want = low / (high + wa[:10].sum() + wb[10:].sum())
    assert abs((got[0] == got[1]).mean() - want) < 0.03


@pytest.mark.parametrize("shared", [0, 1, 2, 4])
def test_recall_at_the_threshold(shared):
    """Pairs of plain likeness 0.6 to 0.65 whose common shingles are of a low weight level (many texts have them), the others of level 4 (no other text has them)."""
    s, g, found, n = N.Sampler(N.PLAIN_BANDS * 3), np.random.default_rng(8), 0, 1500
    for _ in range(n):
        common, own = 60, 18  # 60 / 96 = 0.625
        h = S.mix(g.integers(1, 1 << 62, common + 2 * own).astype(np.uint64)) >> np.uint64(10)
        level = np.array([shared] * common + [4] * own)
        got = s(np.concatenate((h[: common + own], h[:common], h[common + own :])), np.concatenate((level, level)), np.array([0, common + own, 2 * (common + own)]))
        found += (got[0] == got[1]).reshape(N.PLAIN_BANDS, 3).all(1).sum() >= 2
    assert found / n >= 0.995, found / n


def test_hot_keys_are_dealt_to_blocks(spark):
    rows = [(k, d) for d in range(60) for k in (1, 2)] + [(3, d) for d in range(0, 60, 2)] + [(4, 1), (4, 1), (5, 7), (5, 8)] + [(1, 5)] * 3
    flat = spark.createDataFrame(rows, "key BIGINT, doc BIGINT").repartition(5)
    pack = lambda parts: lambda batches: S.packed_keys(((p["key"].to_numpy().astype(np.uint64), p["doc"].to_numpy()) for p in batches), parts)
    both = {frozenset(p) for p in combinations(range(60), 2)}
    for block, most, parts in ((3, 20, 2), (7, 1, 3), (3, 1000, 1), (2048, 1000, 4)):
        keys = flat.mapInPandas(pack(parts), "part int, n int, data binary")
        got = [(r["a"], r["b"]) for r in S.pairs_by_key(keys, parts, 2, block, most).collect()]
        assert len(got) == len(set(got)) and all(a < b for a, b in got) and {frozenset(p) for p in got} == both
        three = {(r["a"], r["b"]) for r in S.pairs_by_key(keys, parts, 3, block, most).collect()}
        assert three == {p for p in combinations(range(0, 60, 2), 2)} | {(7, 8)}


def pairs_frame(spark, rows):
    return spark.createDataFrame(rows, "label INT, text0 STRING, text1 STRING, author0 STRING, author1 STRING, id0 BIGINT, id1 BIGINT, dataset STRING, mode STRING, split STRING, doc STRING")


def test_split_overlap(spark):
    g = random.Random(5)
    texts = versions(g, 120) + ["one two three", "one two three", "one two three four", "Zero ONE  two three", "", None, "boiler plate text here " * 3, "boiler plate text here " * 3 + "end"]
    rows = []
    for _ in range(150):
        i, j = g.randrange(len(texts)), g.randrange(len(texts))
        rows.append((1, texts[i], texts[j], "a", "b", i, j, g.choice(["gold", "silver", None]), "AA", g.choice(["train", "val", "test"]), "clash"))
    rows += [rows[0], (0, None, None, None, None, None, None, "gold", "AA", "test", None), (0, "x y z", "x y z", None, None, 900, 901, "gold", "AA", None, None)]
    sides = {(r[7], r[9], i, t) for r in rows for i, t in ((r[5], r[1]), (r[6], r[2])) if i is not None and r[9]}
    train = {(i, t) for d, s, i, t in sides if s == "train"}
    want = set()
    for d, s, i, t in sides:
        if s != "train":
            for j, u in train:
                if i == j or t and u and likeness(t, u) >= 0.6:
                    want.add((d, s, i, j))
    got = {(r["dataset"], r["split"], r["id_eval"], r["id_train"]) for r in O.split_overlaps(pairs_frame(spark, rows)).collect()}
    assert got == want
    report = O.overlap_report(pairs_frame(spark, rows)).collect()
    assert sum(r["n_overlapping"] for r in report) == len({w[:3] for w in want})
    assert O.split_overlaps(pairs_frame(spark, [])).count() == 0


def test_split_overlap_of_hot_versions(spark):
    """More versions of one text than FEW, which part late or everywhere, and texts that only begin alike."""
    g = random.Random(12)
    tweet = [f"t{i}" for i in range(14)]
    texts = [" ".join([*tweet[:10], f"late{i}", *tweet[11:]]) for i in range(40)]
    base = [f"b{i}" for i in range(70)]
    for i in range(40):
        w = list(base)
        for k in g.sample(range(70), g.randint(1, 4)):
            w[k] = f"edit{i}x{k}"
        texts.append(" ".join(w))
    texts += [" ".join([*base[:6], *(f"own{i}x{k}" for k in range(20))]) for i in range(40)]
    rows = [(1, t, t, "a", "b", i, i, "gold", "AA", "train" if i % 2 else "test", None) for i, t in enumerate(texts)]
    want = {(i, j) for i in range(0, len(texts), 2) for j in range(1, len(texts), 2) if likeness(texts[i], texts[j]) >= 0.6}
    for blocks in ({}, {"pair_block": 4, "span_block": 8}):  # hot prefixes in one block, and dealt to many
        got = {(r["id_eval"], r["id_train"]) for r in O.split_overlaps(pairs_frame(spark, rows), **blocks).collect()}
        assert len(want) >= 600 and got == want
    reports = [O.overlap_report(pairs_frame(spark, rows), **blocks).collect() for blocks in ({}, {"pair_block": 4, "span_block": 8})]
    assert reports[0] == reports[1]


def test_shared_spans_of_long_texts(spark):
    """100 words that two texts of 4,100 share are found wherever they lie, and merged into one span."""
    g = random.Random(21)
    rows, long = [], lambda k, side: [f"{side}{k}x{i}" for i in range(4000)]
    for k in range(50):
        a, b, shared = long(k, "a"), long(k, "b"), [f"s{k}x{i}" for i in range(100)]
        i, j = g.randrange(4000), g.randrange(4000)
        rows.append((1, " ".join(a[:i] + shared + a[i:]), " ".join(a[:i]), "a", "b", k, 1000 + k, "gold", "AA", "test", None))
        rows.append((1, " ".join(b[:j] + shared + b[j:]), None, "a", "b", 2000 + k, 3000 + k, "gold", "AA", "train", None))
    texts = O._texts(O._sides(pairs_frame(spark, rows)))
    spans = O.span_coverage(O.suffix_array(texts, 0.6)[1]).collect()
    assert len(spans) == 50 and all((r["n_covered"], r["n_spans"]) == (100, 1) for r in spans)
    report = O.overlap_report(pairs_frame(spark, rows)).collect()
    assert [(r["n_records"], r["n_with_spans"], r["n_half_covered"], r["n_overlapping"]) for r in report] == [(100, 50, 0, 0)] and abs(report[0]["mean_coverage"] - 50 / 4100) < 1e-6


def test_leakage(spark):
    g = random.Random(6)
    word = lambda: f"w{g.randint(0, 25)}"
    items = [(i, " ".join(word() for _ in range(g.randint(1, 25)))) for i in range(40)] + [(90, None), (91, "a b"), (92, "")]
    docs = [(i, " ".join(word() for _ in range(g.randint(0, 120)))) for i in range(60)]
    docs += [(100 + i, " ".join(word() for _ in range(20)) + " " + t.upper().replace(" ", ", ") + " tail") for i, t in items[:10]] + [(300, None), (None, "w1 w2 w3")]
    want = {(i, d) for i, t in items for d, x in docs if d is not None and triples(t) and len(triples(t) & triples(x)) >= 0.4 * len(triples(t)) - 1e-9}
    di, dd = spark.createDataFrame(items, "item_id BIGINT, text STRING"), spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    for block in (32_000_000, 300):
        got = {(r["item_id"], r["doc_id"]) for r in leakage.leaked_passages(di, dd, block_chars=block).collect()}
        assert got == want
    p, stretch = leakage.Patterns(items), leakage.STRETCH
    every = [np.stack(p.search([t for _, t in docs])).tolist()]
    looked = [0]
    block = p.block
    for leakage.STRETCH in (1, 2, 7):  # cursors at every place find the same
        every.append(np.stack(p.search([t for _, t in docs])).tolist())
    leakage.STRETCH = stretch
    assert all(x == every[0] for x in every)
    p.block = lambda u, v: (looked.append(len(u)), block(u, v))[1]
    for word, most in ((10**6, 1520), (-1, 1020)):  # a shift of two words where no block is known, of three where no word is
        looked.clear()
        p._stops(np.full(3000, word))
        assert sum(looked) <= most
    assert leakage.leaked_passages(di.limit(0), dd).count() == 0 and leakage.leaked_passages(di, dd.limit(0)).count() == 0


def test_canonical(spark):
    t = canonical.transducer()
    same = ["The café of Ilmen", "Ｔｈｅ café of Ilmen", "The café of Il​men", "Тhе саfé оf Ilⅿеn", "The café of Ilmen ﻿", "T­he ca⁠fé of Ilmen"]
    assert len({t(x) for x in same}) == 1 and t(same[0]) == same[0]
    apart = ["The cafe of Ilmen", "the café of Ilmen", "The café of  Ilmen", "The café\nof Ilmen", "The café of Ilmen.", "The cafè of Ilmen"]
    assert len({t(x) for x in [same[0], *apart]}) == 1 + len(apart)
    assert t("👩‍💻") == "👩‍💻" != t("👩💻") and t("🌧️") == t("🌧")
    russian = "Вся школа давно купила новый мост"
    assert t(russian) == russian and t("Bся шкoла") == "Вся школа" and t("Α") == t("А") == "A"
    greek = "νέος δρόμος της πόλης"
    assert t(greek) == greek == t("νέoς δρόμoς της πόλης") == t("νέоς δρόμος της πόλης") and t("Ο " + greek) == t("O " + greek) == t("О " + greek)
    assert t("ёлка") == "ёлка" == t("ëлка") and t("non\u2011stop") == t("non\u2010stop") == "non-stop" and t("օn the shօre") == "on the shore" and t("Հայոց") == "Հայոց"
    assert t("") == "" and t(" ​ ") == "" and t("x" * 100_000 + "é") == "x" * 100_000 + "é"
    for x in same + apart + [russian]:
        assert t(t(x)) == t(x)
    rows = [(i, x, None) for i, x in enumerate([*same, *apart, same[0], None, "", "​", " "])]
    d = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, look BINARY")
    got = {(r["doc_a"], r["doc_b"]) for r in canonical.look_alike_pairs(d).collect()}
    n = len(same)
    assert got == {(a, b) for a, b in combinations([*range(n), n + len(apart)], 2) if rows[a][1] != rows[b][1]}
    assert canonical.canonical_texts(d).count() == len(rows)
    assert canonical.look_alike_pairs(d.limit(0)).count() == 0


def test_author_splits(spark):
    g = random.Random(7)
    names = [f"Author {i}" for i in range(120)]
    rows = []
    for _ in range(300):
        a = g.choice(names[:60])
        b = a if g.random() < 0.8 else g.choice(names[:60])
        rows.append((int(a == b), "x", "y", a.upper() if g.random() < 0.2 else f" {a} ", g.choice([b, b, b, None]), 1, 2, "gold", "AA", "train", None))
    rows += [(0, "x", "y", None, None, 1, 2, "gold", "AA", "train", None), (None, None, None, "  ", "Author 1", 1, 1, None, None, None, None)]
    pairs = pairs_frame(spark, rows)
    docs = spark.createDataFrame([(g.choice([*names, names[0], names[0], None]),) for _ in range(600)], "author STRING")
    key = lambda x: " ".join(x.lower().split()) or None if x else None
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for r in rows:
        a, b = key(r[3]), key(r[4])
        for x in (a, b):
            if x:
                find(x)
        if a and b:
            parent[find(a)] = find(b)
    want = {(a, b) for a, b in combinations(sorted(parent), 2) if find(a) == find(b)}
    assert {(r["author_a"], r["author_b"]) for r in group_split.linked_pairs(pairs).collect()} == want
    s = {r["author"]: r for r in group_split.split_by_author(pairs, docs, heavy=20, shard_size=15).collect()}
    assert set(s) == set(parent) | {key(r["author"]) for r in docs.collect() if r["author"]}
    assert all(s[a]["split"] == s[b]["split"] for a, b in want)
    n = {x: sum(r["n_rows"] for r in s.values() if r["split"] == x) for x in group_split.SPLITS}
    total = sum(n.values())
    assert abs(n["val"] / total - 0.1) < 0.05 and abs(n["test"] / total - 0.2) < 0.05
    assert group_split.linked_pairs(pairs.limit(0)).count() == 0 and group_split.split_by_author(pairs.limit(0), docs.limit(0)).count() == 0


def test_rows_without_author_have_a_split(spark):
    g = random.Random(4)
    docs = spark.createDataFrame([(i, f"a{i % 40}" if i % 3 else g.choice([None, " "]), f"t{i}") for i in range(1500)], "id BIGINT, author STRING, text STRING")
    pairs = pairs_frame(spark, [(1, "x", "y", *(("A1", None) if i % 2 else (None, " ")), 2000 + i, 3000 + i, "gold", "AA", "train", None) for i in range(40)])
    rows = group_split.split_rows(pairs, docs).collect()
    assert len(rows) == 1540 and {r["split"] for r in rows} == set(group_split.SPLITS)
    assert len({r["split"] for r in rows if r["author"] == "a1"}) == 1
    assert all(abs(sum(r["split"] == x for r in rows) / 1540 - w) < 0.05 for x, w in zip(group_split.SPLITS, (0.7, 0.1, 0.2)))


def test_packing(spark):
    g = random.Random(8)
    size = np.array([g.randint(0, 420) for _ in range(500)])
    where = packing.pack(size, 420)
    used = np.bincount(where, size)
    assert used.max() <= 420 and (used > 0).sum() <= 1.12 * -(-size.sum() // 420)
    rows = [(i, "w " * n, n, [str(i)]) for i, n in enumerate([0, 5, 419, 420, 421, 1290, 840, 100, 30])] + [(1, "w " * 5, None, ["1"]), (50, None, 7, None), (51, " \n", 3, []), (None, "w " * 500, 1, ["x", "x"])]
    d = spark.createDataFrame(rows, "id BIGINT, text STRING, word_count INT, source_ids ARRAY<STRING>")
    got = packing.pack_segments(d, shard_size=4).collect()
    assert {r["id"] for r in got if r["n_pieces"] > 1} == {4, 5, 6, None}
    words = {}
    for r in got:
        words[r["container"]] = words.get(r["container"], 0) + r["n_words"]
    assert max(words.values()) <= 420
    for i, n in ((5, 1290), (6, 840), (3, 420), (1, 5)):
        mine = sorted((r["first_word"], r["n_words"]) for r in got if r["id"] == i)
        assert sum(n for _, n in mine) == n and all(a + k == b for (a, k), (b, _) in zip(mine, mine[1:]))
    assert packing.fill_report(packing.pack_segments(d)).first()["fullest"] == 420
    assert packing.pack_segments(d.limit(0)).count() == 0


def test_mixture(spark):
    g = random.Random(9)
    rows = [(i, " ".join(["word"] * g.randint(1, 200)) if g.random() < 0.97 else None, g.choice(["A", "a ", "b", "C", None])) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.45, 1), ("c", 0.04, 3), ("missing", 0.01, 2)], "source STRING, target_share DOUBLE, max_repeats INT")
    chosen, report = mixture.mixture(docs, targets, bucket=100)
    r = {x["source"]: x for x in report.collect()}
    assert abs(r["a"]["share_of_goal"] - 0.5) < 0.01 and abs(r["c"]["share_of_goal"] - 0.04) < 0.01
    assert r["b"]["share_of_goal"] < 0.45 and r["b"]["most_copies"] == 1  # all there is
    assert r["missing"]["tokens"] == 0
    assert chosen.where("copies > 2 AND source = 'a'").count() == 0 and chosen.groupBy("doc_id").count().where("count > 1").count() == 0
    assert mixture.mixture(docs.limit(0), targets)[0].count() == 0
    some = targets.where("source <> 'missing'")
    largest = {x["source"]: x for x in mixture.mixture(docs, some, bucket=100, size="feasible")[1].collect()}
    assert all(abs(x["share_of_mixture"] - x["target_share"] / 0.99) < 0.01 and x["most_copies"] <= x["max_repeats"] for x in largest.values())
    total = docs.count() and sum(x["tokens"] for x in mixture.token_counts(docs).collect())
    half = mixture.mixture(docs, some, bucket=100, size=total / 4)[1].collect()
    assert abs(sum(x["tokens"] for x in half) - total / 4 * 0.99) < 0.01 * total


EN = "The council of the old town bought the bridge in March. Several people saw the gallery after the harbour closed. Nobody in the village knew the plan before the meeting."
PARA = "The board of the ancient city purchased the crossing in March. Several folk noticed the museum after the port shut. Nobody in the hamlet heard the scheme before the session."


@pytest.mark.parametrize(
    "prompt, response, want",
    [
        (EN, None, "empty"), (EN, " ​", "empty"), (EN, '""', "empty"), (EN, "...", "empty"), (EN, "Rewritten text:", "empty"),
        (EN, "I’m sorry, but I can’t help with that.", "refusal"), (EN, "Rewritten: the board... Unfortunately, I'm unable to assist. Please provide another text.", "refusal"),
        (EN, "“I’m sorry, but I can’t help with that,” the clerk said. " + PARA, None),
        (EN, EN, "copy"), (EN, "Here is the rewritten text: " + EN.lower(), "copy"), (EN, PARA, None),
        (EN, "La gente de esta ciudad quiere saber qué pasará con el puente cuando el consejo se reúna otra vez por la mañana.", "wrong_language"),
        (EN, "Here you go: люди этого города хотят знать что будет с мостом когда совет снова соберётся утром", "wrong_language"),
        (EN, PARA[: PARA.index(" the scheme") + 4], "truncated"), (EN, PARA[:-14], "truncated"), (EN, PARA.split(" Nobody")[0], None), (EN[:-1], PARA[:-1], None),
        (None, "Any text at all", None), ("", "I cannot help with this request.", "refusal"),
    ],
)
def test_responses(prompt, response, want):
    assert judge()(prompt, response, R.Languages()) == want


@lru_cache(1)
def judge():
    prompts = [EN, EN.replace("old", "new"), PARA, PARA.replace("ancient", "young")]
    return R.Judge([(EN, PARA), (prompts[1], prompts[3])], prompts)


@pytest.mark.parametrize("text", ["That is a request I have to turn down.", "I must pass on this one.", "This isn't something I'm comfortable writing.", "Request denied.", "As a language model, I do not write such texts.", "Sorry, I’m unable to rewrite this passage. Please send another one."])
def test_refusals(text):
    assert judge().refusals(text) and judge()(EN, text, R.Languages()) == "refusal"


@pytest.mark.parametrize("text", ["I cannot believe that the old bridge is gone.", "We will not forget the harbour, she said.", "The council declined the request of the village.", "The clerk said: “I cannot help with that.” The meeting went on.", "Thank you all for coming to the gallery."])
def test_no_refusals(text):
    assert not judge().refusals(text)


def test_languages_that_cannot_be_told():
    langs = R.Languages()
    assert langs.disagreement(EN, "Oh no") == langs.disagreement("ok", "La gente de esta ciudad quiere saber qué pasará con el puente") == 0.0
    assert langs.disagreement(EN, "La gente de esta ciudad quiere saber qué pasará con el puente") > 0.9 and langs.disagreement(EN, PARA) < 0.2
    assert abs(langs.posterior(EN).sum() - 1) < 1e-9 and langs.posterior("").max() < 0.2


def test_truncation_on_cut_responses(spark):
    """Responses that the models haven't seen, whole and cut by us; how many ends are told by signs alone and how many by the model."""
    rewritten, docs = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("rewritten", "docs"))
    said = rewritten.where("error IS NULL").selectExpr("id", "'x' AS field", "coalesce(impersonated_text, obfuscated_text) AS response")
    pairs, prompts = R.sample_pairs(said, docs, 2000)
    assert R.sample_pairs(said.repartition(7), docs, 2000) == (pairs, prompts)
    seen, held = set(prompts[: len(prompts) // 2]), [x for x in pairs if x[0] in set(prompts[len(prompts) // 2 :])]
    ends = R.Judge([x for x in pairs if x[0] in seen], [x for x in prompts if x in seen]).ends
    g, right, told = random.Random(3), {True: [], False: []}, []
    for p, r in held:
        if not re.search(r"[.!?]$", r.rstrip()) or len(r.split()) < 12 or R.copied_share(R._WORD.findall(p.lower()), R._WORD.findall(r.lower())) > 0.8:
            continue
        last = re.split(r"[.!?…][\"”'’)\]]*\s+|\n+", r.rstrip().rstrip(".!?"))[-1].split()
        if len(last) < 5:
            continue
        whole = r.rstrip().rstrip(".!?")
        cut = whole[: len(whole) - len(" ".join(last[g.randint(2, len(last) - 1) :]))].rstrip()
        for text, want in ((whole, False), (cut, True)):
            told.append(R.last_words(p, text)[0] is not None)
            right[want].append(ends.broken_off(p, text) == want)
    print(f"{len(told)} ends, {np.mean(told):.2f} of them told by signs, the others by the likelihood; right: whole {np.mean(right[False]):.3f}, cut {np.mean(right[True]):.3f}; weights {dict(zip(R.FEATURES, ends.w.round(1)))}")
    assert len(told) > 100 and np.mean(told) < 0.2 and np.mean(right[False]) > 0.9 and np.mean(right[True]) > 0.9


def test_responses_table(spark):
    schema = "id BIGINT, impersonator STRING, impersonated_text STRING, obfuscated_text STRING, error STRING"
    rows = [(1, "x", EN, None, None), (1, None, None, PARA, None), (1, None, None, "", None), (1, None, None, "", None), (2, "x", None, None, "failed"), (3, "x", None, PARA, None), (None, None, None, None, None), (9, None, None, "whatever it says", None)]
    docs = spark.createDataFrame([(1, EN, 2), (1, "old text", 1), (3, EN, 1), (4, None, 1)], "id BIGINT, text STRING, ingested_at INT")
    got = R.defective_responses(spark.createDataFrame(rows, schema), docs).collect()
    assert sorted(((r["id"] or 0), r["field"], r["defect"]) for r in got) == [(0, "obfuscated_text", "empty"), (1, "impersonated_text", "copy"), (1, "obfuscated_text", "empty"), (3, "impersonated_text", "empty")]
    assert R.defective_responses(spark.createDataFrame([], schema), docs.limit(0)).count() == 0


def test_responses_models_see_all_rows(spark):
    """A word that only prompts beyond the first 2,000 ids by hash say, and always at the end of a sentence, isn't cut."""
    late = {r["id"] for r in spark.range(1, 2301).selectExpr("id").orderBy(F.xxhash64("id", F.lit(3)), "id").collect()[2000:]}
    g = random.Random(5)
    a, b = "council mayor teacher baker farmer doctor painter".split(), "bridge harbour gallery market garden river school".split()

    def sentences(end):
        return [f"The {g.choice(a)} of the {g.choice(b)} saw the {g.choice(b)} with the {g.choice(a)} {x}." for x in ("in March", "after noon", end)]

    docs = [(i, " ".join(sentences("near the quorvel" if i in late else "near the church")), 1) for i in range(1, 2301)]
    rows = [(i, "x", t.replace("saw", "noticed").replace("with", "beside").replace("The ", "Each "), None, None) for i, t, _ in docs]
    docs.append((5000, "We heard at once of all these plans when our visitors left. They spoke of money.", 1))
    rows.append((5000, "x", "It was said in March that nobody had any doubt. They say the old people still go for walks by the quorvel", None, None))
    rows.append((5000, None, None, "It was said in March that nobody had any doubt. They say the old people still go for walks with the", None))
    docs = spark.createDataFrame(docs, "id BIGINT, text STRING, ingested_at INT")
    rows = spark.createDataFrame(rows, "id BIGINT, impersonator STRING, impersonated_text STRING, obfuscated_text STRING, error STRING")
    assert [(r["field"], r["defect"]) for r in R.defective_responses(rows, docs).where("id = 5000").collect()] == [("obfuscated_text", "truncated")]


def test_responses_table_as_texts_at_hand(spark):
    """Counts, gradients and Newton steps in passes over the table give what models fitted on all texts at hand say."""
    rewritten, docs = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("rewritten", "docs"))
    got = {tuple(r) for r in R.defective_responses(rewritten.repartition(7, "id"), docs.repartition(5)).collect()}
    rows = rewritten.where("error IS NULL").selectExpr("id", "if(impersonator IS NULL, 'obfuscated_text', 'impersonated_text') field", "if(impersonator IS NULL, obfuscated_text, impersonated_text) response").distinct()
    prompts = docs.where("text IS NOT NULL").join(rows, "id", "left_semi").groupBy("id").agg(F.max_by("text", F.struct("ingested_at", "text")).alias("prompt"))
    rows = [tuple(r) for r in rows.join(prompts, "id", "left").select("id", "field", "prompt", "response").collect()]
    every = R.Judge([(p, r) for _, _, p, r in rows if p is not None and r], sorted({p for _, _, p, _ in rows if p is not None}))
    langs = R.Languages()
    assert got == {(i, f, d) for i, f, p, r in rows if (d := every(p, r, langs))} and len(got) > 50


def test_language_accuracy():
    """Held-out sentences, not in the seeds."""
    held = {
        "en": "It was raining when the two friends walked home from the theatre", "es": "Llovía cuando los dos amigos volvieron a casa desde el teatro", "fr": "Il pleuvait quand les deux amis sont rentrés du théâtre à pied",
        "de": "Es regnete, als die beiden Freunde vom Theater nach Hause gingen", "ru": "Шёл дождь, когда двое друзей возвращались домой из театра", "it": "Pioveva quando i due amici tornarono a casa dal teatro", "nl": "Het regende toen de twee vrienden van het theater naar huis liepen",
    }
    langs = R.Languages()
    assert [list(R.SEEDS)[langs.posterior(t).argmax()] for t in held.values()] == list(held)


def test_personal_data_held_out_carriers():
    """Every fifth carrier of each kind is kept from the training: recall by kind, and precision, on those alone."""
    finder = P.Finder(P.trained(held_out=2), frozenset(P.C.GIVEN))
    rows = P.labelled_table(seed=99, copies=5, keep=lambda k: k % 5 == 2)
    want = {(k, i, t[a:b]) for i, (t, s) in enumerate(rows) for a, b, k in s}
    got = {(k, i, rows[i][0][a:b]) for i, f in enumerate(finder([t for t, _ in rows])) for a, b, k in f}
    recall = {k: np.mean([x in got for x in want if x[0] == k]) for k in crf.KINDS}
    print(recall, len(want & got) / len(got))
    assert all(recall[k] >= least for k, least in (("email", 0.97), ("phone", 0.95), ("id_number", 0.92), ("address", 0.9), ("name", 0.82))), recall
    assert len(want & got) / len(got) > 0.93


def test_personal_data(spark):
    text = "Call (202) 555-0147 or write to ana.b@mail.example, see Flight TS1873 and @handle."
    finder = P.Finder(P.trained(), frozenset())
    f = finder([text, "", "no details at all", " \n ", "\x00"])
    assert P.mask(text, f[0]) == "Call <PHONE> or write to <EMAIL>, see Flight TS1873 and @handle." and f[1:] == [[]] * 4
    assert finder(["a\x00b " + text])[0] == [(a + 4, b + 4, k) for a, b, k in f[0]]
    docs = spark.createDataFrame([(1, "Grace Hill", text), (2, "Grace Ott", None), (3, None, ""), (4, "x", "word " * 30000 + text), (1, "Grace Hill", text), (None, None, text)], "id BIGINT, author STRING, text STRING")
    items = sorted(((r["id"] or 0), r["kind"], r["found_text"]) for r in P.personal_items(docs).collect())
    assert items == [(i, k, v) for i in (0, 1, 4) for k, v in (("email", "ana.b@mail.example"), ("phone", "(202) 555-0147"))]
    assert P.masked_texts(docs).count() == 6 and P.personal_items(docs.limit(0)).count() == 0


def test_long_lines_are_cut_after_sentences():
    text = "We met Karin Whitlow at the pier. Call (202) 555-0147 now. " * 900
    finder = P.Finder(P.trained(), frozenset(["karin"]))
    cut, size = finder.crf.tokens([text, "short"]).sequences()
    assert size.max() <= crf.LONG and size.sum() == cut[-1] + size[-1] and len(cut) > 4
    found = finder([text])[0]
    assert len(found) == 1800 and {text[a:b] for a, b, _ in found} == {"Karin Whitlow", "(202) 555-0147"}
    assert finder(["word " * 20000])[0] == []


def test_names_that_no_author_bears(spark):
    texts = ["Police later spoke to Zbigniew Harrowell and two others.", "a message from J. R. Whitmore arrived late.", "The complaint names Oyelaran Fennick as the tenant.", "The nurse, Captain Quillon Marsh, agreed.", "I met Priya Raghunathan, and Wei Zhang told Oluwaseun Adeyemi.", "Critics in Upper Tarnmere met the Hollow Vale Council."]
    docs = spark.createDataFrame([(i, "Grace Hill", t) for i, t in enumerate(texts)], "id BIGINT, author STRING, text STRING")
    items = {(r["id"], r["found_text"].removeprefix("Captain ")) for r in P.personal_items(docs).where("kind = 'name'").collect()}
    assert items == {(0, "Zbigniew Harrowell"), (1, "J. R. Whitmore"), (2, "Oyelaran Fennick"), (3, "Quillon Marsh"), (4, "Priya Raghunathan"), (4, "Wei Zhang"), (4, "Oluwaseun Adeyemi")}


def test_table_of_given_names(spark):
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}é" for i in range(6000)]
    table = P.given_names(spark.createDataFrame([(f" {w.title()} x",) for w in words] + [(None,), ("single",), ("",)], "author STRING"))
    assert all(w in table for w in words) and "single" not in table and sum(f"{w}q" in table for w in words) < 60


def test_tokens_cover_every_character():
    texts = ["", " a  b\u2003c ", "1st\n\n (x_y) É\u0301!", "end "]
    m = P.trained()
    m.forget()
    t = m.tokens(texts)
    for k, x in enumerate(texts):
        own = t.real[t.text[t.real] == k]
        assert [x[a:b] for a, b in zip(t.begin[own], t.end[own])] == re.findall(r"[^\W\d_]+|\d+|\n|[^\w\s]|_", x)


def test_viterbi_is_the_best_path():
    m = crf.Crf(crf.Base([], []))
    g = np.random.default_rng(1)
    m.trans, m.start = g.normal(size=(m.n, m.n)).astype(np.float32), g.normal(size=m.n).astype(np.float32)
    e = g.normal(size=(7, m.n)).astype(np.float32)
    order, begin, size, steps = crf._by_step(np.array([0, 3]), np.array([3, 4]))
    got = np.empty(7, int)
    got[order] = m.viterbi(e[order], steps)
    for lo, hi in ((0, 3), (3, 7)):
        best = max(np.ndindex(*[m.n] * (hi - lo)), key=lambda p: m.start[p[0]] + sum(e[lo + i, k] for i, k in enumerate(p)) + sum(m.trans[a, b] for a, b in zip(p, p[1:])))
        assert got[lo:hi].tolist() == list(best)

"""Queries on pair tables and their making."""

from __future__ import annotations

from pyspark.sql import functions as F

from stylomill.operators import pairing, quality, stats
from stylomill.plans.common import corpus, table
from stylomill.plans.registry import query
from stylomill.plans.sql import CORPUS, hash_order, n_words, squash

_SIDES = "SELECT dataset, mode, split, label, id0 id, author0 author, text0 text FROM pairs UNION ALL SELECT dataset, mode, split, label, id1, author1, text1 FROM pairs"
_PAIR_STATS = f"""p AS (SELECT dataset, mode, split, count(*) pairs_total, count(*) FILTER (label = 1) pairs_pos, count(*) FILTER (label = 0) pairs_neg FROM pairs GROUP BY ALL),
s AS (SELECT dataset, mode, split, count(DISTINCT id) unique_docs, count(DISTINCT author) unique_authors FROM ({_SIDES}) GROUP BY dataset, mode, split)"""


@query(f"WITH {_PAIR_STATS} SELECT p.*, round(pairs_pos / pairs_total, 3) AS pos_ratio, unique_docs, unique_authors FROM p JOIN s USING (dataset, mode, split)")
def pair_stats(spark, d):
    return stats.pair_stats(table(spark, d, "pairs"))


_M = ["pairs_total", "pairs_pos", "pairs_neg", "unique_docs", "unique_authors"]


@query(f"WITH {_PAIR_STATS}, j AS (SELECT p.*, unique_docs, unique_authors FROM p JOIN s USING (dataset, mode, split)) SELECT dataset, mode, "
       + ", ".join(f"max({m}) FILTER (split = '{s}') AS {s}_{m}" for s in ("train", "val", "test") for m in _M) + " FROM j GROUP BY dataset, mode")
def pair_stats_pivot(spark, d):
    return stats.pair_stats_pivot(table(spark, d, "pairs"))


@query(f"""SELECT split, count(*) AS n_pairs, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, round(avg(CASE WHEN label = 1 THEN 1.0 WHEN label IS NULL THEN NULL ELSE 0 END), 6) AS pos_share,
 min({n_words('text0')}) AS min_w0, max({n_words('text0')}) AS max_w0, min({n_words('text1')}) AS min_w1, max({n_words('text1')}) AS max_w1, round(avg({n_words('text0')}), 6) AS avg_w0, round(avg({n_words('text1')}), 6) AS avg_w1 FROM pairs GROUP BY split""")
def qa_basic_stats(spark, d):
    return stats.basic_stats(table(spark, d, "pairs"))


@query(f"""WITH {CORPUS}, ids AS (SELECT id0 id FROM pairs UNION SELECT id1 FROM pairs) SELECT author, count(DISTINCT id) AS n_docs FROM corpus WHERE lower(genre) = 'article' AND id IN (SELECT id FROM ids WHERE id IS NOT NULL) GROUP BY author""")
def authors_in_pairs(spark, d):
    return stats.authors_in_pairs(corpus(spark, d), table(spark, d, "pairs"))


@query("SELECT dataset, split, count(*) FILTER (id0 = id1) AS n_self, count(*) AS n_pairs FROM pairs GROUP BY dataset, split")
def qa_self_pair(spark, d):
    return quality.self_pairs(table(spark, d, "pairs"), "dataset", "split")


@query("SELECT dataset, split, count(*) FILTER ((author0 = author1) <> (label = 1)) AS n_conflicts, count(*) FILTER (((author0 = author1) <> (label = 1)) IS NULL) AS n_unknown FROM pairs GROUP BY dataset, split")
def qa_label_consistency(spark, d):
    return quality.label_conflicts(table(spark, d, "pairs"), "dataset", "split")


@query(f"WITH s AS ({_SIDES}) SELECT DISTINCT split, id FROM s WHERE split <> 'train' AND id IN (SELECT id FROM s WHERE split = 'train' AND id IS NOT NULL)")
def qa_id_leakage(spark, d):
    return quality.id_leakage(table(spark, d, "pairs"))


@query(f"""WITH s AS ({_SIDES}), h AS (SELECT DISTINCT split, sha1({squash('text')}) h FROM s WHERE text IS NOT NULL)
SELECT split, count(*) AS n_texts, count(*) FILTER (h IN (SELECT h FROM h WHERE split = 'train')) AS n_leaked FROM h WHERE split <> 'train' GROUP BY split""")
def qa_text_leakage(spark, d):
    return quality.text_leakage(table(spark, d, "pairs"))


_BAL = f"s AS ({_SIDES}), b AS (SELECT id, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE -1 END) AS BIGINT) diff FROM s WHERE id IS NOT NULL AND label IS NOT NULL GROUP BY id)"


@query(f"WITH {_BAL} SELECT id, diff FROM b")
def qa_doc_balance(spark, d):
    return quality.doc_balance(table(spark, d, "pairs"))


@query(f"WITH {_BAL} SELECT count(*) AS n_docs, round(avg(abs(diff)), 6) AS mean_abs_diff, max(abs(diff)) AS max_abs_diff, avg(abs(diff)) > 1.5 AS unbalanced FROM b")
def qa_balance_summary(spark, d):
    return quality.balance_summary(table(spark, d, "pairs"))


@query(f"WITH s AS ({_SIDES}) SELECT label, id, count(*) AS n FROM s GROUP BY label, id HAVING count(*) > 1")
def qa_repeated_documents(spark, d):
    return quality.repeated_documents(table(spark, d, "pairs"))


def _cut(c: str) -> str:
    return f"CASE WHEN length({c}) > 80 THEN {c}[1:80] || '…' ELSE {c} END"


@query(f"SELECT label, id0, id1, text0, text1 FROM (SELECT label, id0, id1, {_cut('text0')} AS text0, {_cut('text1')} AS text1, {hash_order(7, 'id0', 'id1', 'label', 'split', 'dataset')} k FROM pairs) ORDER BY k, text0, text1 LIMIT 5")
def qa_preview(spark, d):
    return quality.preview(table(spark, d, "pairs"), 5)


_AUTHORS = f"a AS (SELECT author, row_number() OVER (ORDER BY {hash_order(7, 'author')}, author) rn, count(*) OVER () n FROM (SELECT DISTINCT author FROM corpus WHERE author IS NOT NULL))"


@query(f"WITH {CORPUS}, {_AUTHORS} SELECT author, CASE WHEN rn <= round_even(n * 0.2, 0) THEN 'val' ELSE 'train' END AS split FROM a")
def author_split(spark, d):
    return pairing.author_split(corpus(spark, d))


@query(f"WITH {CORPUS}, {_AUTHORS} SELECT author, CASE WHEN rn <= n - floor(n * 0.8 + 1e-9) THEN 'val' ELSE 'train' END AS split FROM a")
def author_split_floor(spark, d):
    return pairing.author_split(corpus(spark, d), rounding="floor")


def _pos_sql(mode: str) -> str:
    side = lambda n, g: f"{n} AS (SELECT id, author, row_number() OVER (PARTITION BY author ORDER BY {hash_order(7, 'id')}, id) r FROM corpus WHERE lower(genre) = '{g}' AND author IS NOT NULL)"
    if mode == "AT":
        s = f"{side('a', 'article')}, {side('t', 'tweet')}, p0 AS (SELECT a.author, a.id id0, t.id id1 FROM a JOIN t USING (author, r))"
    else:
        s = f"{side('a', {'AA': 'article', 'TT': 'tweet'}[mode])}, p0 AS (SELECT x.author, x.id id0, y.id id1 FROM a x JOIN a y ON x.author = y.author AND x.r % 2 = 1 AND y.r = x.r + 1)"
    return s + f", pos AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY {hash_order(7, 'id0', 'id1')}, id0, id1) k FROM p0) WHERE k <= 50)"


def _neg_sql(mode: str) -> str:
    lay = lambda i: f"row_number() OVER (ORDER BY {hash_order(7, 'author')}, author, {hash_order(7, i)}, {i})"
    if mode == "AT":
        return f"""la AS (SELECT id0, author x, {lay('id0')} ra FROM pos), lt AS (SELECT id1, author y, {lay('id1')} rt FROM pos),
sz AS (SELECT max(n) h, sum(n) m FROM (SELECT count(*) n FROM pos GROUP BY author)), neg AS (SELECT id0, id1 FROM la, sz JOIN lt ON rt = (ra - 1 + h) % m + 1 WHERE x <> y)"""
    return f"""dd AS (SELECT author, id0 id FROM pos UNION ALL SELECT author, id1 FROM pos), l AS (SELECT id, author, {lay('id')} rn, count(*) OVER () // 2 h FROM dd),
neg AS (SELECT x.id id0, y.id id1 FROM l x JOIN l y ON x.rn <= x.h AND y.rn = x.rn + x.h WHERE x.author <> y.author)"""


def _balanced_sql(mode: str, target: int) -> str:
    return f"""WITH {CORPUS}, {_pos_sql(mode)}, {_neg_sql(mode)}, b AS (SELECT 1 label, id0, id1 FROM pos UNION ALL SELECT 0, id0, id1 FROM neg),
r AS (SELECT label, id0, id1, row_number() OVER (PARTITION BY label ORDER BY {hash_order(7, 'label', 'id0', 'id1')}, id0, id1) rn FROM b),
k AS (SELECT least((SELECT count(*) FROM pos), (SELECT count(*) FROM neg), {target // 2}) k)
SELECT CAST(label AS INT) AS label, id0, id1, x.author AS author0, y.author AS author1, md5(x.text) AS text0_md5, md5(y.text) AS text1_md5 FROM r, k JOIN corpus x ON x.id = id0 JOIN corpus y ON y.id = id1 WHERE rn <= k"""


def _balanced(spark, d, mode: str, target: int | None):
    p = pairing.balanced(corpus(spark, d), mode, target)
    return p.select("label", "id0", "id1", "author0", "author1", F.md5("text0").alias("text0_md5"), F.md5("text1").alias("text1_md5"))


@query(f"WITH {CORPUS}, {_pos_sql('AA')} SELECT author, id0, id1 FROM pos")
def positives_aa(spark, d):
    return pairing.capped(pairing.positives(corpus(spark, d), "AA"), 100).select("author", "id0", "id1")


@query(_balanced_sql("AA", 100_000))
def pairs_aa(spark, d):
    return _balanced(spark, d, "AA", 100_000)


@query(_balanced_sql("TT", 100_000))
def pairs_tt(spark, d):
    return _balanced(spark, d, "TT", 100_000)


@query(_balanced_sql("AT", 200))
def pairs_at(spark, d):
    return _balanced(spark, d, "AT", 200)


_NO_TARGET = 1 << 62  # more than there are pairs


@query(_balanced_sql("AA", _NO_TARGET))
def pairs_aa_all(spark, d):
    return _balanced(spark, d, "AA", None)


@query(_balanced_sql("TT", _NO_TARGET))
def pairs_tt_all(spark, d):
    return _balanced(spark, d, "TT", None)


@query(_balanced_sql("AT", _NO_TARGET))
def pairs_at_all(spark, d):
    return _balanced(spark, d, "AT", None)


@query("""SELECT label, id0, id1, split FROM pairs WHERE id0 IS NOT NULL AND id1 IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY least(id0, id1), greatest(id0, id1) ORDER BY split, dataset, mode, label, id0, text0, text1) = 1""")
def pairs_dedup_unordered(spark, d):
    p = table(spark, d, "pairs").where("id0 IS NOT NULL AND id1 IS NOT NULL")
    return pairing.dedup_unordered(p, *[F.asc_nulls_last(c) for c in ("split", "dataset", "mode", "label", "id0", "text0", "text1")]).select("label", "id0", "id1", "split")


_BOUNDS = f"""WITH {CORPUS}, dc AS (SELECT id, author, lower(genre) = 'article' a, lower(genre) = 'tweet' t FROM corpus WHERE author IS NOT NULL),
c AS (SELECT author, count(*) FILTER (a) na, count(*) FILTER (t) nt FROM dc GROUP BY author), s AS (SELECT sum(na) articles, sum(nt) tweets, count(*) FILTER (na > 0 AND nt > 0) authors_both, sum(least(na, nt)) pos_upper FROM c),
r AS (SELECT author, row_number() OVER (ORDER BY id) rn FROM dc WHERE a UNION ALL SELECT author, row_number() OVER (ORDER BY id) FROM dc WHERE t),
u AS (SELECT coalesce(max(n), 0) most FROM (SELECT author, count(*) n FROM r, s WHERE rn <= least(articles, tweets) GROUP BY author)),
f AS (SELECT articles, tweets, authors_both, pos_upper, least(articles, tweets) - greatest(0, most - least(articles, tweets)) neg_upper FROM s, u)"""


@query(_BOUNDS + " SELECT CAST(articles AS BIGINT) AS articles, CAST(tweets AS BIGINT) AS tweets, authors_both, CAST(pos_upper AS BIGINT) AS pos_upper, CAST(neg_upper AS BIGINT) AS neg_upper FROM f")
def at_upper_bounds(spark, d):
    return stats.matching_bounds(corpus(spark, d))


@query(_BOUNDS + """ SELECT CAST(2 * least(pos_upper, neg_upper) AS BIGINT) AS max_balanced, CAST(1000 AS INT) AS target, CAST(greatest(0, 1000 - 2 * least(pos_upper, neg_upper)) AS BIGINT) AS shortfall,
CASE WHEN 2 * least(pos_upper, neg_upper) >= 1000 THEN 'OK' ELSE 'SHORT' END AS verdict FROM f""")
def at_feasibility(spark, d):
    return stats.feasibility(stats.matching_bounds(corpus(spark, d)), 1000).select("max_balanced", "target", "shortfall", "verdict")

"""SQL for those pN queries whose results SQL can say."""

_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
_NAME = "nullif(lower(trim(regexp_replace({0}, '\\s+', ' ', 'g'), ' ')), '')"
_BLANKS = r"[^\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _triples(keys: str, words: str) -> str:
    return f"SELECT DISTINCT {keys}, unnest([{words}[i] || ' ' || {words}[i + 1] || ' ' || {words}[i + 2] for i in range(1, len({words}) - 1)]) t"


_LINKS = f"""WITH RECURSIVE p AS (SELECT DISTINCT {_NAME.format('author0')} a, {_NAME.format('author1')} b FROM pairs), e AS (SELECT a u, b v FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b UNION SELECT b, a FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v)"""
_LEAKS = f"""i AS (SELECT item_id, {_WORDS.format('text')} w FROM eval_items WHERE text IS NOT NULL), d AS (SELECT doc_id, {_WORDS.format('text')} w FROM documents WHERE text IS NOT NULL),
a AS ({_triples('item_id', 'w')} FROM i), b AS ({_triples('doc_id', 'w')} FROM d), n AS (SELECT item_id, count(*) n FROM a GROUP BY item_id),
c AS (SELECT item_id, doc_id, count(*) k FROM a JOIN b USING (t) GROUP BY ALL), l AS (SELECT item_id, doc_id, k, n FROM c JOIN n USING (item_id) WHERE k >= 0.4 * n - 1e-9)"""
_OVERLAPS = f"""s AS (SELECT dataset, split, id0 id, text0 x FROM pairs UNION SELECT dataset, split, id1, text1 FROM pairs), d AS (SELECT DISTINCT x, md5(x) h, {_WORDS.format('x')} w FROM s WHERE x IS NOT NULL AND id IS NOT NULL),
t3 AS ({_triples('h', 'w')} FROM d), n AS (SELECT h, count(*) n FROM t3 GROUP BY h), e AS (SELECT DISTINCT md5(x) h FROM s WHERE split IN ('val', 'test') AND id IS NOT NULL), r AS (SELECT DISTINCT md5(x) h FROM s WHERE split = 'train' AND id IS NOT NULL),
c AS (SELECT a.h ha, b.h hb, count(*) k FROM t3 a JOIN t3 b USING (t) WHERE a.h IN (SELECT h FROM e) AND b.h IN (SELECT h FROM r) GROUP BY ALL),
l AS (SELECT ha, hb FROM c JOIN n x ON x.h = ha JOIN n y ON y.h = hb WHERE k / (x.n + y.n - k) >= 0.6),
o AS (SELECT DISTINCT a.dataset, a.split, a.id ia, b.id ib FROM l JOIN s a ON md5(a.x) = ha JOIN s b ON md5(b.x) = hb WHERE a.split IN ('val', 'test') AND b.split = 'train' AND a.id <> b.id
UNION SELECT DISTINCT dataset, split, id, id FROM s WHERE split IN ('val', 'test') AND id IN (SELECT id FROM s WHERE split = 'train' AND id IS NOT NULL))"""

SQL = {
    "p1_found": f"""WITH d AS (SELECT DISTINCT id, {_WORDS.format('text')} w FROM docs WHERE id IS NOT NULL AND text IS NOT NULL), t AS ({_triples('id', 'w')} FROM d WHERE len(w) >= 8),
n AS (SELECT id, count(*) n FROM t GROUP BY id), c AS (SELECT a.id ia, b.id ib, count(*) k FROM t a JOIN t b ON a.t = b.t AND a.id < b.id GROUP BY ALL)
SELECT ia AS id_a, ib AS id_b FROM c JOIN n x ON x.id = ia JOIN n y ON y.id = ib WHERE k / (x.n + y.n - k) >= 0.6""",
    "p4_found": f"""WITH {_OVERLAPS} SELECT DISTINCT dataset, split, least(ia, ib) AS id_a, greatest(ia, ib) AS id_b FROM o""",
    "p4_overlap_report": f"""WITH {_OVERLAPS}, h AS (SELECT dataset, split, ia, max(CAST(ia = ib AS INT)) same, max(CAST(ia <> ib AS INT)) near FROM o GROUP BY ALL),
f AS (SELECT dataset, split, count(*) n_overlapping, sum(same) n_same_id, sum(near) n_near_text FROM h GROUP BY ALL),
g AS (SELECT DISTINCT unnest([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) g FROM d WHERE h IN (SELECT h FROM r)),
e5 AS (SELECT h, unnest([{{'i': i, 'g': array_to_string(w[i:i + 4], ' ')}} for i in range(1, len(w) - 3)]) u FROM d WHERE h IN (SELECT h FROM e)),
v AS (SELECT h, count(DISTINCT p) n FROM (SELECT h, unnest(range(u.i, u.i + 5)) p FROM e5 WHERE u.g IN (SELECT g FROM g)) GROUP BY h),
q AS (SELECT s.dataset, s.split, s.id, max(coalesce(v.n / nullif(len(d.w), 0), 0.0)) share FROM s LEFT JOIN d ON d.x = s.x LEFT JOIN v ON v.h = d.h WHERE s.split IN ('val', 'test') AND s.id IS NOT NULL GROUP BY ALL),
t AS (SELECT dataset, split, count(*) n_records, sum(CAST(share > 0 AS INT)) n_with_spans, sum(CAST(share >= 0.5 AS INT)) n_half_covered, round(avg(share), 6) mean_coverage FROM q GROUP BY ALL)
SELECT t.dataset, t.split, CAST(n_records AS BIGINT) AS n_records, CAST(coalesce(n_overlapping, 0) AS BIGINT) AS n_overlapping, CAST(coalesce(n_same_id, 0) AS BIGINT) AS n_same_id, CAST(coalesce(n_near_text, 0) AS BIGINT) AS n_near_text,
CAST(n_with_spans AS BIGINT) AS n_with_spans, CAST(n_half_covered AS BIGINT) AS n_half_covered, mean_coverage FROM t LEFT JOIN f ON t.dataset IS NOT DISTINCT FROM f.dataset AND t.split = f.split""",
    "p5_found": f"""{_LINKS} SELECT DISTINCT u AS author_a, v AS author_b FROM r WHERE u < v""",
    "p5_component_splits": f"""{_LINKS}, x AS (SELECT a n FROM p UNION SELECT b FROM p UNION SELECT {_NAME.format('author')} FROM docs), c AS (SELECT n, least(n, min(v)) c FROM x LEFT JOIN r ON r.u = x.n WHERE n IS NOT NULL GROUP BY n)
SELECT c AS component, count(*) AS n_authors, CAST(1 AS BIGINT) AS n_splits FROM c GROUP BY c""",
    "p6_found": f"SELECT DISTINCT id FROM segments WHERE id IS NOT NULL AND len(regexp_extract_all(coalesce(text, ''), '{_BLANKS}')) > 420",
    "p6_pieces": f"""WITH s AS (SELECT DISTINCT id, text, len(regexp_extract_all(coalesce(text, ''), '{_BLANKS}')) n FROM segments WHERE id IS NOT NULL)
SELECT id, CAST(sum(n) AS BIGINT) AS n_words, CAST(sum(greatest(1, ceil(n / 420))) AS BIGINT) AS n_pieces, CAST(max(least(n, 420)) AS BIGINT) AS largest FROM s GROUP BY id""",
    "p7_found": f"""WITH {_LEAKS} SELECT item_id, doc_id FROM l""",
    "p7_leaked_items": f"""WITH {_LEAKS} SELECT item_id, count(*) AS n_documents, max(round(k / n, 6)) AS largest_share FROM l GROUP BY item_id""",
}

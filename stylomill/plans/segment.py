"""Queries on segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from stylomill.operators import segments as G
from stylomill.plans.common import corpus, counted
from stylomill.plans.registry import query
from stylomill.plans.sql import CORPUS, n_words, words

# a recursive fold over each author's documents: r, words waiting, their documents, the segment that a document completed
_TWEETS = f"""WITH RECURSIVE {CORPUS}, o AS (SELECT author, id, {n_words('text')} w, row_number() OVER (PARTITION BY author ORDER BY id) r FROM corpus WHERE lower(genre) = 'tweet' AND author IS NOT NULL AND {n_words('text')} > 0),
f AS (SELECT author, CAST(0 AS BIGINT) r, CAST(0 AS BIGINT) s, CAST('' AS VARCHAR) ids, CAST(0 AS BIGINT) seg, CAST(NULL AS BIGINT) n, CAST('' AS VARCHAR) done FROM (SELECT DISTINCT author FROM o)
UNION ALL SELECT o.author, o.r,
 CASE WHEN w > 420 THEN 0 WHEN s + w <= 420 THEN CASE WHEN s + w >= 300 THEN 0 ELSE s + w END WHEN w >= 300 THEN 0 ELSE w END,
 CASE WHEN w > 420 THEN '' WHEN s + w <= 420 THEN CASE WHEN s + w >= 300 THEN '' ELSE ids || ',' || o.id END WHEN w >= 300 THEN '' ELSE ',' || o.id END,
 CASE WHEN w > 420 OR (s + w <= 420 AND s + w >= 300) OR (s + w > 420 AND w >= 300) THEN seg + 1 ELSE seg END,
 CASE WHEN w > 420 THEN 420 WHEN s + w <= 420 AND s + w >= 300 THEN s + w WHEN s + w > 420 AND w >= 300 THEN w END,
 CASE WHEN w > 420 OR s + w > 420 THEN ',' || o.id ELSE ids || ',' || o.id END
 FROM f JOIN o ON o.author = f.author AND o.r = f.r + 1)
"""


@query(_TWEETS + "SELECT author, seg - 1 AS seg_no, CAST(n AS INT) AS word_count, done[2:] AS source_ids FROM f WHERE n IS NOT NULL")
def segments_tweet(spark, d):
    t = G.segment_table(G.segment_parts(counted(spark, d), "tweet"))
    return t.select("author", "seg_no", "word_count", F.array_join("source_ids", ",").alias("source_ids"))


# one row per word would be long: documents of an author lie end to end, and a fold over segments takes where the next one begins
_ARTICLES = f"""WITH RECURSIVE {CORPUS}, o AS (SELECT author, id, {n_words('text')} w, row_number() OVER (PARTITION BY author ORDER BY id) r FROM corpus WHERE lower(genre) = 'article' AND author IS NOT NULL AND {n_words('text')} > 0),
c AS (SELECT *, sum(w) OVER (PARTITION BY author ORDER BY r) hi, sum(w) OVER (PARTITION BY author ORDER BY r) - w lo FROM o),
f AS (SELECT author, CAST(-1 AS BIGINT) seg, CAST(0 AS BIGINT) b, CAST(0 AS BIGINT) e FROM (SELECT DISTINCT author FROM c)
UNION ALL SELECT f.author, f.seg + 1, CAST(f.e AS BIGINT), CAST(least(f.e + 420, min(c.hi)) AS BIGINT) FROM f JOIN c ON c.author = f.author AND c.hi >= f.e + 300 GROUP BY f.author, f.seg, f.e)
"""


@query(_ARTICLES + """SELECT f.author, f.seg AS seg_no, CAST(any_value(f.e - f.b) AS INT) AS word_count, string_agg(c.id, ',' ORDER BY c.r) AS source_ids
FROM f JOIN c ON c.author = f.author AND c.lo < f.e AND c.hi > f.b WHERE f.seg >= 0 GROUP BY f.author, f.seg""")
def segments_article(spark, d):
    t = G.segment_table(G.segment_parts(counted(spark, d), "article"))
    return t.select("author", "seg_no", "word_count", F.array_join("source_ids", ",").alias("source_ids"))


@query(_TWEETS + "SELECT row_number() OVER (ORDER BY author, seg) - 1 AS id, author, CAST(n AS INT) AS word_count FROM f WHERE n IS NOT NULL")
def segment_ids(spark, d):
    return G.numbered_segments(G.segment_table(G.segment_parts(counted(spark, d), "tweet"))).select("id", "author", "word_count")


def segment_texts(spark, d):
    c = corpus(spark, d)
    out = None
    for genre in ("tweet", "article"):
        t = G.with_texts(G.segment_parts(counted(spark, d), genre), c, genre).withColumn("genre", F.lit(genre.title()))
        out = t if out is None else out.unionByName(t)
    return out


query()(segment_texts)


def _digests(spark, d, genre: str):
    t = G.with_texts(G.segment_parts(counted(spark, d), genre), corpus(spark, d), genre)
    return t.select("author", "seg_no", F.md5("text").alias("text_md5"))


@query(_TWEETS + f""", u AS (SELECT author, seg - 1 seg_no, unnest(string_split(done[2:], ',')) id, unnest(range(len(string_split(done[2:], ',')))) i FROM f WHERE n IS NOT NULL)
SELECT u.author, seg_no, md5(string_agg(array_to_string({words('c.text')}[1:420], ' '), chr(10) || '<SEP>' || chr(10) ORDER BY i)) AS text_md5 FROM u JOIN corpus c ON CAST(c.id AS VARCHAR) = u.id GROUP BY u.author, seg_no""")
def segment_texts_tweet(spark, d):
    return _digests(spark, d, "tweet")


@query(_ARTICLES + f"""SELECT f.author, f.seg AS seg_no, md5(string_agg(array_to_string({words('x.text')}[greatest(f.b - c.lo, 0) + 1:least(f.e, c.hi) - c.lo], ' '), ' ' ORDER BY c.r)) AS text_md5
FROM f JOIN c ON c.author = f.author AND c.lo < f.e AND c.hi > f.b JOIN corpus x ON x.id = c.id WHERE f.seg >= 0 GROUP BY f.author, f.seg""")
def segment_texts_article(spark, d):
    return _digests(spark, d, "article")

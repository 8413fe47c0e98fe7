"""Queries on the corpus: statistics, cleaning, features, masking."""

from __future__ import annotations

from pyspark.sql import functions as F

from stylomill.functions import text as X
from stylomill.operators import clean, stats
from stylomill.plans.common import corpus, counted, featured, table
from stylomill.plans.registry import query
from stylomill.plans.sql import CORPUS, n_words, squash, words

_X = f"x AS (SELECT CAST({n_words('text')} AS DOUBLE) x FROM corpus WHERE {n_words('text')} > 0)"


def _histogram_sql(source: str) -> str:
    return f"""
b AS (SELECT count(x) n, min(x) lo0, max(x) hi0, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) iqr FROM {source}),
e AS (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END lo, CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END hi,
  CAST(CASE WHEN n < 2 THEN 10 WHEN iqr <= 0 THEN 50 ELSE greatest(10, ceil((hi0 - lo0) / (2 * iqr / pow(n, 1/3.0)))) END AS INT) k FROM b)
SELECT CAST(least(floor((x - lo) / (hi - lo) * k) + 1, k) AS INT) AS bin,
  round(any_value(lo) + (least(floor((x - lo) / (hi - lo) * k) + 1, k) - 1) * (any_value(hi) - any_value(lo)) / any_value(k), 6) AS lo_edge, count(*) AS n
FROM {source}, e GROUP BY least(floor((x - lo) / (hi - lo) * k) + 1, k)"""


def _digests(spark, d):
    return featured(spark, d, "author", n_chars=F.length("text"), text_md5=F.md5("text"))


@query(f"""WITH {CORPUS}, w AS (SELECT coalesce(genre, 'UNKNOWN') g, author, {n_words('text')} n FROM corpus)
SELECT CASE WHEN grouping(g) = 1 THEN 'ALL' ELSE g END AS scope, count(*) AS n_docs, count(DISTINCT author) AS n_authors, count(*) FILTER (n = 0) AS n_empty,
 CAST(min(n) AS INT) AS min_words, CAST(max(n) AS INT) AS max_words, round(avg(n), 6) AS mean_words, round(quantile_cont(n, 0.25), 6) AS p25, round(quantile_cont(n, 0.5), 6) AS p50,
 round(quantile_cont(n, 0.75), 6) AS p75, round(quantile_cont(n, 0.9), 6) AS p90 FROM w GROUP BY GROUPING SETS ((), (g))""")
def eda_word_stats(spark, d):
    return stats.word_stats(counted(spark, d))


@query(f"WITH {CORPUS}, {_X}, {_histogram_sql('x').strip()}")
def eda_histogram(spark, d):
    return stats.histogram(counted(spark, d))


@query(f"WITH {CORPUS}, {_X}, c AS (SELECT quantile_cont(x, 0.01) a, quantile_cont(x, 0.99) b FROM x), y AS (SELECT x FROM x, c WHERE x >= a AND x <= b), {_histogram_sql('y').strip()}")
def eda_histogram_clipped(spark, d):
    return stats.histogram(counted(spark, d), clip=(0.01, 0.99))


@query(f"""WITH {CORPUS}, w AS (SELECT CAST({n_words('text')} AS INT) n_words, count(*) n FROM corpus WHERE {n_words('text')} > 0 GROUP BY 1)
SELECT n_words, n, round(sum(n) OVER (ORDER BY n_words) / sum(n) OVER (), 9) AS share FROM w""")
def eda_ecdf(spark, d):
    return stats.ecdf(counted(spark, d))


@query(f"""WITH {CORPUS}, w AS (SELECT coalesce(genre, 'UNKNOWN') genre, {n_words('text')} x FROM corpus WHERE {n_words('text')} > 0),
q AS (SELECT genre, quantile_cont(x, 0.25) q1, quantile_cont(x, 0.5) q2, quantile_cont(x, 0.75) q3 FROM w GROUP BY 1)
SELECT genre, count(*) AS n, CAST(min(x) FILTER (x >= q1 - 1.5 * (q3 - q1)) AS INT) AS whisker_lo, round(any_value(q1), 6) AS q1, round(any_value(q2), 6) AS median, round(any_value(q3), 6) AS q3,
 CAST(max(x) FILTER (x <= q3 + 1.5 * (q3 - q1)) AS INT) AS whisker_hi FROM w JOIN q USING (genre) GROUP BY genre""")
def eda_boxplot(spark, d):
    return stats.boxplot(counted(spark, d))


@query(f"WITH {CORPUS} SELECT min(id) AS id, count(*) AS copies FROM corpus GROUP BY author, text")
def dedup_author_text(spark, d):
    return clean.dedup_author_text(_digests(spark, d))


@query(f"WITH {CORPUS} SELECT md5(text) AS text_md5, count(*) AS n_rows, count(DISTINCT author) AS n_authors, min(id) AS first_id FROM corpus GROUP BY text HAVING count(*) > 1")
def duplicate_texts(spark, d):
    return clean.duplicate_texts(_digests(spark, d))


@query(f"WITH {CORPUS} SELECT id, genre, CAST({n_words('text')} AS INT) AS n_words FROM corpus WHERE NOT (coalesce(genre, '') = 'Article' AND {n_words('text')} < 20)")
def drop_short_articles(spark, d):
    return clean.drop_short(corpus(spark, d)).select("id", "genre", X.n_words("text").alias("n_words"))


@query(f"WITH {CORPUS} SELECT id, author FROM corpus WHERE {n_words('text')} = 0")
def empty_texts(spark, d):
    return clean.texts_of_length(corpus(spark, d), 0).select("id", "author")


@query(f"WITH {CORPUS} SELECT id, author FROM corpus WHERE lower(coalesce(genre, '')) = 'article' AND {n_words('text')} = 20")
def articles_of_length(spark, d):
    return clean.texts_of_length(corpus(spark, d), 20, genre="article").select("id", "author")


@query(f"WITH {CORPUS} SELECT id, author FROM corpus WHERE lower(coalesce(genre, '')) = 'article' AND {n_words('text')} = 146")
def articles_of_146_words(spark, d):
    """As articles_of_length, of a length that many articles have."""
    return clean.texts_of_length(featured(spark, d, "author", "genre", n_words=X.n_words("text")), 146, genre="article").select("id", "author")


@query(f"WITH {CORPUS} SELECT id, author, genre FROM corpus WHERE author IS DISTINCT FROM 'Milo A Thornwick'")
def exclude_author(spark, d):
    return clean.exclude_author(corpus(spark, d), "Milo A Thornwick").select("id", "author", "genre")


_MARKS = r"regexp_extract_all(coalesce(text, ''), '[.,!?:;\-–—…“”‘’()\[\]]|\p{So}')"


@query(f"WITH {CORPUS} SELECT id, array_to_string({_MARKS}, ' ') AS pe_seq, CAST(len({_MARKS}) AS INT) AS pe_len FROM corpus")
def pe_features(spark, d):
    marks = X.marks("text")
    return featured(spark, d, pe_len=F.size(marks), pe_seq=F.array_join(marks, " ")).select("id", "pe_seq", "pe_len")


@query(f"""WITH {CORPUS}, m AS (SELECT {_MARKS} a FROM corpus), g AS (SELECT unnest(a) ngram FROM m UNION ALL
SELECT unnest([a[i] || '|' || a[i + 1] for i in range(1, len(a))]) FROM m) SELECT ngram, count(*) AS n FROM g GROUP BY 1""")
def pe_ngram_counts(spark, d):
    return clean.mark_ngrams(featured(spark, d, marks=X.marks("text")), 2)


@query(f"""WITH {CORPUS}, m AS (SELECT id, {_MARKS} a FROM corpus), g AS (SELECT id, unnest(a) ngram FROM m UNION ALL
SELECT id, unnest([a[i] || '|' || a[i + 1] for i in range(1, len(a))]) FROM m) SELECT id, count(*) AS n_ngrams, count(DISTINCT ngram) AS n_kinds FROM g GROUP BY id""")
def pe_ngram_maps(spark, d):
    """Per document, from its map of n-gram counts."""
    m = clean.with_mark_counts(featured(spark, d, marks=X.marks("text")), 2)
    total = F.aggregate(F.map_values("pe_counts"), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return m.select("id", total.alias("n_ngrams"), F.size("pe_counts").cast("bigint").alias("n_kinds")).where("n_ngrams > 0")


@query(rf"WITH {CORPUS} SELECT id, regexp_replace(text, '[\p{{Cc}}\p{{Cf}}\p{{Co}}\p{{So}}]', '', 'g') AS text FROM corpus")
def strip_control(spark, d):
    return corpus(spark, d).select("id", X.strip_symbols("text").alias("text"))


_SHARE = r"length(regexp_replace(text, '[^A-Za-z\x{130}\x{212A}]', '', 'g')) / nullif(length(regexp_replace(text, '[^\p{L}]', '', 'g')), 0)"


@query(f"WITH {CORPUS} SELECT id, round({_SHARE}, 6) AS share FROM corpus WHERE {_SHARE} >= 0.8")
def english_filter(spark, d):
    return featured(spark, d, share=X.english_share("text")).where("share >= 0.8").select("id", F.round("share", 6).alias("share"))


_MASK = r"""masked AS (SELECT id, genre, text, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '<EMAIL>', 'g'), '(?i)(?:https?://|www\.)\S+', '<URL>', 'g') t FROM corpus),
parts AS (SELECT id, genre, text, string_split(regexp_replace(t, '@([A-Za-z0-9_])', chr(1) || '@\1', 'g'), chr(1)) p FROM masked),
users AS (SELECT id, genre, text, p, [u for u in [lower(regexp_extract(x, '^@([A-Za-z0-9_]{1,15})', 1)) for x in p] if u <> ''] u FROM parts),
firsts AS (SELECT id, genre, text, p, [u[i] for i in range(1, len(u) + 1) if list_position(u, u[i]) = i] f FROM users)
"""


@query(rf"""WITH {CORPUS}, {_MASK} SELECT id, CASE WHEN lower(coalesce(genre, '')) = 'tweet' AND regexp_matches(text, '(?i)@|https?://|www\.') THEN
 array_to_string([CASE WHEN regexp_matches(x, '^@[A-Za-z0-9_]') THEN 'USER_' || list_position(f, lower(regexp_extract(x, '^@([A-Za-z0-9_]{{1,15}})', 1))) || regexp_replace(x, '^@[A-Za-z0-9_]{{1,15}}', '') ELSE x END for x in p], '')
 ELSE text END AS text FROM firsts""")
def mask_pii(spark, d):
    return corpus(spark, d).select("id", X.mask_tweet("text", "genre").alias("text"))


@query(f"WITH {CORPUS} SELECT id, sha1({squash('text')}) AS text_sha1, CAST(length({squash('text')}) AS INT) AS n_chars FROM corpus")
def text_hashes(spark, d):
    return featured(spark, d, n_chars=F.length(X.squash("text")), text_sha1=X.text_hash("text")).select("id", "text_sha1", "n_chars")


@query(f"WITH {CORPUS} SELECT id, array_to_string({words('text')}[1:50], ' ') AS text FROM corpus WHERE text IS NOT NULL")
def trimmed_texts(spark, d):
    return corpus(spark, d).where("text IS NOT NULL").select("id", X.trim_words("text", 50).alias("text"))


_COUNTS = "SELECT author, count(*) AS total, count(*) FILTER (lower(genre) = 'article') AS article, count(*) FILTER (lower(genre) = 'tweet') AS tweet FROM corpus GROUP BY author"


@query(f"WITH {CORPUS} {_COUNTS}")
def author_genre_counts(spark, d):
    return stats.author_genre_counts(corpus(spark, d))


@query(f"WITH {CORPUS} {_COUNTS} HAVING count(*) >= 20 ORDER BY total DESC, author")
def top_authors(spark, d):
    return stats.top_authors(corpus(spark, d), 20)


@query("""SELECT CAST(id AS VARCHAR) || chr(9) || author || chr(9) || genre AS line FROM (SELECT DISTINCT id, lower(trim(author)) author, trim(genre) genre FROM docs) WHERE author IS NOT NULL AND genre IS NOT NULL AND id IS NOT NULL""")
def corpus_lines(spark, d):
    """Tab-separated lines of id, author and genre as a text sink writes them."""
    rows = table(spark, d, "docs").select("id", F.lower(F.trim("author")).alias("author"), F.trim("genre").alias("genre")).distinct().na.drop()
    return rows.select(F.concat_ws("\t", F.col("id").cast("string"), "author", "genre").alias("line"))

"""Queries on rewritten records and the pairs made with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from stylomill.functions import text as X
from stylomill.operators import adversarial as A
from stylomill.plans.common import corpus, table
from stylomill.plans.registry import query
from stylomill.plans.sql import CORPUS, hash_order, hash_uniform, length_bin, words

_MODS = """mods AS (SELECT id, impersonator, coalesce(impersonated_text, obfuscated_text, paraphrased_text) mod_text FROM rewritten WHERE error IS NULL AND id IS NOT NULL AND coalesce(impersonated_text, obfuscated_text, paraphrased_text) IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY id, impersonator IS NULL ORDER BY md5(mod_text), coalesce(impersonator, '')) = 1)"""


def _idx(key: str, n: str) -> str:
    return f"CASE WHEN {n} <= 0 THEN 0 ELSE ('0x' || substr(sha1({key}), 1, 8))::BIGINT % ({n}) END"


@query(f"WITH {_MODS} SELECT id, impersonator, md5(mod_text) AS text_md5 FROM mods")
def modified_records(spark, d):
    return A.modified_records(table(spark, d, "rewritten")).select("id", "impersonator", F.md5("mod_text").alias("text_md5"))


@query("SELECT DISTINCT id, genre FROM docs WHERE id IS NOT NULL AND lower(genre) = 'article' AND id NOT IN (SELECT id FROM rewritten WHERE id IS NOT NULL AND error IS NULL)")
def resume_antijoin(spark, d):
    """Articles still to be rewritten; failed ones are to be tried again."""
    docs = table(spark, d, "docs").where("id IS NOT NULL AND lower(genre) = 'article'").select("id", "genre").distinct()
    return A.pending(docs, table(spark, d, "rewritten"))


@query(f"WITH {CORPUS}, ids AS (SELECT id FROM rewritten WHERE id IS NOT NULL UNION SELECT id0 FROM pairs WHERE id0 IS NOT NULL UNION SELECT id1 FROM pairs WHERE id1 IS NOT NULL) SELECT id FROM ids")
def collected_ids(spark, d):
    p = table(spark, d, "pairs")
    return A.done_ids(table(spark, d, "rewritten"), p.select(F.col("id0").alias("id")), p.select(F.col("id1").alias("id")))


@query(f"WITH {CORPUS}, {_MODS} SELECT count(*) AS n_records, count(*) FILTER (c.id IS NULL) AS n_missing FROM mods m LEFT JOIN corpus c ON c.id = m.id")
def missing_sources(spark, d):
    return A.with_missing(A.modified_records(table(spark, d, "rewritten")), corpus(spark, d))


_IMP = "imps AS (SELECT author, count(*) n FROM corpus WHERE lower(genre) = 'article' AND author IS NOT NULL GROUP BY author HAVING count(*) >= 10)"
_TARGETS = "targets AS (SELECT id, author FROM corpus WHERE lower(genre) = 'article' AND author IS NOT NULL AND id IN (SELECT id FROM rewritten))"
_ASSIGN = f"""i AS (SELECT author impersonator, row_number() OVER (ORDER BY author) - 1 i, count(*) OVER () m FROM imps),
tt AS (SELECT id, author, row_number() OVER (ORDER BY {hash_order(7, 'id')}, id) - 1 r FROM targets),
asg AS (SELECT tt.id, tt.author, CASE WHEN a.impersonator = tt.author THEN b.impersonator ELSE a.impersonator END impersonator FROM tt JOIN i a ON a.i = tt.r % a.m JOIN i b ON b.i = (tt.r + 1) % a.m)"""


def _targets(spark, d):
    c = corpus(spark, d)
    ids = table(spark, d, "rewritten").select("id").distinct()
    return c, c.where(X.genre_is("genre", "article") & F.col("author").isNotNull()).join(ids, "id", "left_semi").select("id", "author", "text")


@query(f"WITH {CORPUS}, {_IMP} SELECT author, n FROM imps")
def allowed_impersonators(spark, d):
    return A.allowed_impersonators(corpus(spark, d), 10)


@query(f"WITH {CORPUS}, {_IMP}, {_TARGETS}, {_ASSIGN} SELECT id, author, impersonator FROM asg WHERE impersonator <> author")
def impersonator_assignment(spark, d):
    c, t = _targets(spark, d)
    return A.assign_impersonators(t, A.allowed_impersonators(c, 10))


@query(f"WITH {CORPUS}, {_IMP}, {_TARGETS}, {_ASSIGN} SELECT impersonator, count(*) AS n FROM asg WHERE impersonator <> author GROUP BY impersonator ORDER BY n DESC, impersonator")
def impersonator_usage(spark, d):
    c, t = _targets(spark, d)
    return A.assign_impersonators(t, A.allowed_impersonators(c, 10)).groupBy("impersonator").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "impersonator")


_BUNDLES = f"""pool AS (SELECT id, author, row_number() OVER (PARTITION BY author ORDER BY {hash_order(7, 'id')}, id) r, count(*) OVER (PARTITION BY author) n FROM corpus
 WHERE lower(genre) = 'article' AND author IN (SELECT author FROM imps) AND id NOT IN (SELECT id FROM targets)),
bun AS (SELECT a.author impersonator, CAST(s // 3 AS INT) bundle, CAST(s % 3 AS INT) place, p.id FROM (SELECT DISTINCT author, n FROM pool) a, range(0, 15) g(s) JOIN pool p ON p.author = a.author AND p.r = s % a.n + 1)"""


@query(f"WITH {CORPUS}, {_IMP}, {_TARGETS}, {_BUNDLES} SELECT impersonator, bundle, place, id FROM bun")
def support_bundles(spark, d):
    c, t = _targets(spark, d)
    return A.support_bundles(c, A.allowed_impersonators(c, 10), t)


@query(f"WITH {CORPUS}, {_IMP}, {_TARGETS}, {_ASSIGN} SELECT id, impersonator, CAST({_idx(chr(39) + chr(39) + ' || id || ' + chr(39) + '|' + chr(39) + ' || impersonator', '5')} AS INT) AS bundle FROM asg WHERE impersonator <> author")
def bundle_choice(spark, d):
    c, t = _targets(spark, d)
    return A.choose_bundle(A.assign_impersonators(t, A.allowed_impersonators(c, 10))).select("id", "impersonator", "bundle")


_HEAD, _BODY, _TAIL = (x.replace("'", "''") for x in (A.IMPERSONATE_HEAD, A.IMPERSONATE_BODY, A.IMPERSONATE_TAIL))


@query(f"""WITH {CORPUS}, {_IMP}, {_TARGETS}, {_ASSIGN}, {_BUNDLES},
ch AS (SELECT id, impersonator, {_idx("'' || id || '|' || impersonator", '5')} bundle FROM asg WHERE impersonator <> author),
sup AS (SELECT ch.id, any_value(ch.impersonator) impersonator, string_agg((place + 1) || ') ' || array_to_string({words('c.text')}[1:80], ' '), chr(10) ORDER BY place) ex, string_agg(b.id, ',' ORDER BY place) ids
 FROM ch JOIN bun b ON b.impersonator = ch.impersonator AND b.bundle = ch.bundle JOIN corpus c ON c.id = b.id GROUP BY ch.id)
SELECT s.id, ids AS support_ids, md5('{_HEAD}' || impersonator || ':' || chr(10) || ex || chr(10) || chr(10) || '{_BODY}' || impersonator || '{_TAIL}' || text || chr(10) || chr(10)) AS prompt_md5 FROM sup s JOIN corpus c ON c.id = s.id""")
def rewrite_prompts(spark, d):
    c, t = _targets(spark, d)
    ch = A.choose_bundle(A.assign_impersonators(t, A.allowed_impersonators(c, 10)))
    s = A.support_texts(ch, A.support_bundles(c, A.allowed_impersonators(c, 10), t), c, 80)
    j = ch.join(s, "id").join(t.select("id", "text"), "id")
    return j.select("id", F.array_join(F.transform("support_ids", lambda x: x.cast("string")), ",").alias("support_ids"), F.md5(A.impersonation_prompt(F.col("text"), F.col("support_texts"), F.col("impersonator"))).alias("prompt_md5"))


@query(f"WITH {CORPUS}, {_TARGETS} SELECT c.id, '{A.PARAPHRASE}' || c.text AS prompt FROM targets t JOIN corpus c ON c.id = t.id WHERE c.text IS NOT NULL")
def paraphrase_prompts(spark, d):
    _, t = _targets(spark, d)
    return t.where("text IS NOT NULL").select("id", A.paraphrase_prompt(F.col("text")).alias("prompt"))


_VH, _VT = A.VERIFY_HEAD, A.VERIFY_TAIL


@query(f"SELECT id0, id1, md5('{_VH}' || trim(text0, ' ') || chr(10) || chr(10) || 'Text 2:' || chr(10) || trim(text1, ' ') || '{_VT}') AS prompt_md5 FROM pairs WHERE text0 IS NOT NULL AND text1 IS NOT NULL")
def av_prompts(spark, d):
    p = table(spark, d, "pairs").where("text0 IS NOT NULL AND text1 IS NOT NULL")
    return p.select("id0", "id1", F.md5(A.verification_prompt(F.col("text0"), F.col("text1"))).alias("prompt_md5"))


@query(f"WITH {CORPUS} SELECT id, {length_bin('coalesce(length(text), 0)')} AS article_bin, {length_bin('coalesce(length(text), 0)', (80, 160, 320))} AS tweet_bin FROM corpus")
def length_bins(spark, d):
    n = F.length("text")
    return corpus(spark, d).select("id", X.length_bin(n, A.ARTICLE_BINS).alias("article_bin"), X.length_bin(n, A.TWEET_BINS).alias("tweet_bin"))


@query("WITH i AS (SELECT id, row_number() OVER (ORDER BY id) rn, count(*) OVER () n FROM (SELECT DISTINCT id FROM docs WHERE id IS NOT NULL)) SELECT id, CAST((rn - 1) // CAST(ceil(n / 7.0) AS BIGINT) AS INT) AS shard FROM i")
def shard_ranges(spark, d):
    return A.shard_ranges(table(spark, d, "docs"), 7)


def _adv_sql(mode: str, imp: bool, pair_type: str) -> str:
    genre, edges = ("article", A.ARTICLE_BINS) if mode == "AA" else ("tweet", A.TWEET_BINS)
    in_bin = "CASE WHEN own_bin = s.bin THEN 1 ELSE 0 END" if mode == "AA" else "0"
    nb = f"(coalesce(bl.n, 0) - {in_bin})" if mode == "AA" else "0"
    na = "(coalesce(au.an, 0) - CASE WHEN own_a IS NULL THEN 0 ELSE 1 END)"
    pb = f"(bl.b + {_idx(f'{chr(39)}{chr(39)} || s.id || {chr(39)}|{pair_type}{chr(39)}', nb)})"
    pa = f"(au.ab + {_idx(f'{chr(39)}{chr(39)} || s.id || {chr(39)}|{pair_type}{chr(39)}', na)})"
    k2 = f"'' || id || '|{pair_type}|1|0'"
    nnb, nna = "(gn - coalesce(bn, 0))", "(n_all - coalesce(an, 0))"
    return f"""WITH {CORPUS}, {_MODS}, dd AS (SELECT id, author, {length_bin('coalesce(length(text), 0)', edges)} bin FROM corpus WHERE lower(genre) = '{genre}' AND author IS NOT NULL),
laid AS (SELECT *, row_number() OVER (ORDER BY bin, {hash_order(7, 'author')}, author, {hash_order(7, 'id')}, id) rn, row_number() OVER (ORDER BY {hash_order(7, 'author')}, author, {hash_order(7, 'id')}, id) ra FROM dd),
bl AS (SELECT bin, author, min(rn) b, count(*) n FROM laid GROUP BY ALL), au AS (SELECT author, min(ra) ab, count(*) an FROM laid GROUP BY ALL), bi AS (SELECT bin, min(rn) gb, count(*) gn FROM laid GROUP BY ALL),
s AS (SELECT m.id, m.mod_text, c.author, {length_bin('length(mod_text)')} bin FROM mods m JOIN corpus c ON c.id = m.id WHERE lower(c.genre) = 'article' AND c.author IS NOT NULL AND (impersonator IS NOT NULL) = {imp}),
q AS (SELECT s.*, o.bin own_bin, o.rn own, o.ra own_a FROM s LEFT JOIN laid o ON o.id = s.id),
w AS (SELECT s.*, {nb} nb, {na} na, {pb} pb, {pa} pa FROM q s LEFT JOIN bl ON bl.bin = s.bin AND bl.author = s.author LEFT JOIN au ON au.author = s.author),
pos AS (SELECT w.id, w.author, w.bin, l.id cid, l.author ca, l.bin cbin FROM w JOIN laid l ON CASE WHEN nb > 0 THEN l.rn = pb + CASE WHEN {'own_bin = w.bin AND pb >= own' if mode == 'AA' else 'false'} THEN 1 ELSE 0 END WHEN na > 0 THEN l.ra = pa + CASE WHEN own_a IS NOT NULL AND pa >= own_a THEN 1 ELSE 0 END ELSE false END),
n0 AS (SELECT p.id, p.author, gb, gn, bl.b bb, bl.n bn, ab, an, (SELECT count(*) FROM laid) n_all FROM pos p JOIN bi ON bi.bin = {'p.bin' if mode == 'AA' else 'p.cbin'} LEFT JOIN bl ON bl.bin = {'p.bin' if mode == 'AA' else 'p.cbin'} AND bl.author = p.author LEFT JOIN au ON au.author = p.author),
n1 AS (SELECT *, gb + {_idx(k2, nnb)} pb, 1 + {_idx(k2, nna)} pa FROM n0),
neg AS (SELECT n1.id, n1.author, l.id cid, l.author ca FROM n1 JOIN laid l ON CASE WHEN {nnb} > 0 THEN l.rn = pb + CASE WHEN pb >= bb THEN bn ELSE 0 END ELSE l.ra = pa + CASE WHEN pa >= ab THEN an ELSE 0 END END WHERE l.id <> n1.id)
SELECT CAST(1 AS INT) AS label, id AS id0, cid AS id1, author AS author0, ca AS author1, {hash_uniform(7, 'id', '1', '0')} < 0.5 AS swap FROM pos UNION ALL SELECT 0, id, cid, author, ca, {hash_uniform(7, 'id', '0', '1')} < 0.5 FROM neg"""


def _adv(spark, d, mode: str, imp: bool, pair_type: str):
    m = A.modified_records(table(spark, d, "rewritten"))
    m = m.where(F.col("impersonator").isNotNull() if imp else F.col("impersonator").isNull())
    return A.adversarial_pairs(m, corpus(spark, d), mode, pair_type).select("label", "id0", "id1", "author0", "author1", "swap")


_ADV_AA = f"WITH {_MODS}, adv AS ({_adv_sql('AA', True, 'impersonation')})"


@query(_ADV_AA + " SELECT a.label, a.id0, a.id1, 'impersonation' AS pair_type, 'modified_article' AS genre0, 'article' AS genre1, m.impersonator FROM adv a JOIN mods m ON m.id = a.id0 AND m.impersonator IS NOT NULL")
def adv_pairs_metadata(spark, d):
    """What goes along with a record into its pairs."""
    m = A.modified_records(table(spark, d, "rewritten")).where("impersonator IS NOT NULL")
    return A.adversarial_pairs(m, corpus(spark, d)).select("label", "id0", "id1", "pair_type", "genre0", "genre1", "impersonator")


@query(_ADV_AA + " SELECT count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, count(DISTINCT id0) AS n_sources, any_value(r.n) AS n_records, any_value(r.n) - count(DISTINCT id0) AS n_unpaired, count(*) FILTER (label = 1) - count(*) FILTER (label = 0) AS n_unmet FROM adv, (SELECT count(DISTINCT id) n FROM mods WHERE impersonator IS NOT NULL) r")
def adv_pair_counters(spark, d):
    m = A.modified_records(table(spark, d, "rewritten")).where("impersonator IS NOT NULL")
    return A.pair_counters(A.adversarial_pairs(m, corpus(spark, d)), m)


@query(_adv_sql("AA", True, "impersonation"))
def adv_pairs_aa(spark, d):
    return _adv(spark, d, "AA", True, "impersonation")


@query(_adv_sql("AT", False, "obfuscation"))
def adv_pairs_at(spark, d):
    return _adv(spark, d, "AT", False, "obfuscation")


_EX = f"{CORPUS}, {_MODS}, ex AS (SELECT c.id, author, genre, text original, mod_text rewritten FROM corpus c JOIN (SELECT id, min_by(mod_text, md5(mod_text)) mod_text FROM mods GROUP BY id) m ON m.id = c.id WHERE author IS NOT NULL AND text IS NOT NULL)"


@query(f"""WITH {_EX}, a AS (SELECT author, max_by(original, id) o, max_by(rewritten, id) r FROM ex WHERE lower(genre) = 'article' GROUP BY 1), t AS (SELECT author, max_by(original, id) o, max_by(rewritten, id) r FROM ex WHERE lower(genre) = 'tweet' GROUP BY 1),
f(x, y) AS (VALUES ('original', 'original'), ('rewritten', 'original'), ('original', 'rewritten'), ('rewritten', 'rewritten'))
SELECT author, md5(CASE WHEN x = 'original' THEN a.o ELSE a.r END) AS text1_md5, md5(CASE WHEN y = 'original' THEN t.o ELSE t.r END) AS text2_md5, true AS same_author, 'article_' || x || '-tweet_' || y AS type FROM a JOIN t USING (author), f""")
def cross_type_samples(spark, d):
    s = A.cross_type_samples(A.examples(table(spark, d, "rewritten"), corpus(spark, d)))
    return s.select("author", F.md5("text1").alias("text1_md5"), F.md5("text2").alias("text2_md5"), "same_author", "type")


def _eval_sql(g: str, n: int) -> str:
    e = f"(SELECT original, rewritten, {hash_order(7, 'id')} k, {hash_order(8, 'id')} j, id FROM ex WHERE lower(genre) = '{g}')"
    return f"""SELECT text1, text2, same_author, '{g}' AS genre FROM (SELECT original text1, rewritten text2, true same_author FROM {e} ORDER BY k, id LIMIT {n})
UNION ALL SELECT (SELECT original FROM {e} ORDER BY j, id LIMIT 1), (SELECT rewritten FROM {e} ORDER BY j, id LIMIT 1 OFFSET 1), false, '{g}'"""


@query(f"WITH {_EX} SELECT md5(text1) AS text1_md5, md5(text2) AS text2_md5, same_author, genre FROM ({_eval_sql('article', 3)} UNION ALL {_eval_sql('tweet', 2)})")
def av_eval_samples(spark, d):
    s = A.eval_samples(A.examples(table(spark, d, "rewritten"), corpus(spark, d)))
    return s.select(F.md5("text1").alias("text1_md5"), F.md5("text2").alias("text2_md5"), "same_author", "genre")

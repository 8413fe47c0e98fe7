"""Pairs with rewritten texts: choosing impersonators and support texts, prompts, and positives and negatives for what was rewritten.

Choices fall on places: candidates are laid out in a hashed order, a source's hash names a place, and an equi-join on the place
fetches the candidate. No source is ever joined with all its candidates, so a hot author or length class costs no more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from stylomill.functions import text as X
from stylomill.operators.ranks import numbered
from stylomill.session import materialize

# Field names in the order in which a record's text is looked for, and prompts.
TEXT_FIELDS = ("impersonated_text", "obfuscated_text", "paraphrased_text")
IMPERSONATE_HEAD = "Here are example writings of Author "
IMPERSONATE_BODY = "Rewrite the following text so that it preserves its original meaning and\ninformation, but imitates the phrasing, tone, and stylistic features of\nAuthor "
IMPERSONATE_TAIL = ":\nDo NOT add prefaces or explanations.\nReturn only the rewritten text."
PARAPHRASE = "Paraphrase the following ARTICLE while preserving its meaning and factual content. Avoid adding new information.\n\n"
VERIFY_HEAD = "You are given two texts. Your task is to determine whether these two texts were likely written by the same author.\n\nPlease respond with only one word: \"Yes\" or \"No\".\n\nText 1:\n"
VERIFY_TAIL = "\n\nWere these two texts likely written by the same author?"
ARTICLE_BINS, TWEET_BINS = (200, 400, 800), (80, 160, 320)


def modified_records(rewritten: DataFrame, keep_errors: bool = False) -> DataFrame:
    """(id, mod_text, impersonator, support_ids, obfuscated_from): a record's first text; records without id, text or with an error go.

    Repeated records are one; of several texts of one id and kind the one with the smallest digest is kept.
    """
    r = rewritten if keep_errors else rewritten.where("error IS NULL")
    t = r.select("id", F.coalesce(*TEXT_FIELDS).alias("mod_text"), "impersonator", "support_ids", "obfuscated_from").where("id IS NOT NULL AND mod_text IS NOT NULL")
    k = F.struct(F.md5("mod_text"), F.coalesce("impersonator", F.lit("")))
    one = t.groupBy("id", F.col("impersonator").isNotNull().alias("imp")).agg(F.min_by(F.struct("mod_text", "impersonator", "support_ids", "obfuscated_from"), k).alias("m"))
    return one.select("id", "m.*")


def done_ids(*tables: DataFrame) -> DataFrame:
    """Distinct ids of all tables."""
    out = tables[0].select("id")
    for t in tables[1:]:
        out = out.unionByName(t.select("id"))
    return out.where("id IS NOT NULL").distinct()


def pending(records: DataFrame, done: DataFrame, retry_errors: bool = True) -> DataFrame:
    """Records whose id isn't done; results with an error count as done only if they are not to be tried again."""
    if retry_errors and "error" in done.columns:
        done = done.where("error IS NULL")
    return records.join(done.select("id").where("id IS NOT NULL").distinct(), "id", "left_anti")


def with_missing(records: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row: records, and those whose id the corpus lacks."""
    known = corpus.select("id").where("id IS NOT NULL").distinct().withColumn("k", F.lit(1))
    return records.select("id").join(known, "id", "left").agg(F.count("*").alias("n_records"), F.count_if(F.col("k").isNull()).alias("n_missing"))


def allowed_impersonators(corpus: DataFrame, least: int = 100) -> DataFrame:
    """(author, n): authors with at least so many articles."""
    return corpus.where(X.genre_is("genre", "article") & F.col("author").isNotNull()).groupBy("author").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def assign_impersonators(targets: DataFrame, impersonators: DataFrame, seed: int = 7) -> DataFrame:
    """(id, author, impersonator): targets in hashed order take impersonators in turn; whoever would get themself gets the next.

    Uses differ by no more than an author's own turns; one impersonator only leaves that author's targets without.
    """
    imp = numbered(impersonators.select("author"), "author").select(F.col("author").alias("impersonator"), (F.col("rn") - 1).alias("i"))
    imp = materialize(imp, "impersonators")
    n = F.broadcast(imp.agg(F.count("*").alias("m")))  # one row
    t = numbered(targets.select("id", "author"), X.hash_order(seed, "id"), "id").crossJoin(n).where("m > 0").withColumn("i", F.pmod(F.col("rn") - 1, F.col("m")))
    first = t.join(imp, "i")
    clash = F.col("impersonator").eqNullSafe(F.col("author"))
    other = first.where(clash).drop("impersonator").withColumn("i", F.pmod(F.col("i") + 1, F.col("m"))).join(imp, "i").where(~clash)
    cols = ["id", "author", "impersonator"]
    return first.where(~clash).select(cols).unionByName(other.select(cols))


def support_bundles(corpus: DataFrame, impersonators: DataFrame, targets: DataFrame, size: int = 3, bundles: int = 5, seed: int = 7) -> DataFrame:
    """(impersonator, bundle, place, id): articles of each impersonator outside the targets, dealt out cyclically from a hashed order.

    Impersonators without such an article have no bundle. Only the articles that are dealt out are ranked beyond their number.
    """
    pool = corpus.where(X.genre_is("genre", "article")).select("id", "author").join(impersonators.select("author"), "author", "left_semi").join(targets.select("id"), "id", "left_anti")
    need = size * bundles
    n = pool.groupBy("author").agg(F.count("*").alias("n"))
    r = pool.withColumn("r", F.row_number().over(Window.partitionBy("author").orderBy(X.hash_order(seed, "id"), "id"))).where(F.col("r") <= need)
    slots = n.select("author", "n", F.explode(F.sequence(F.lit(0), F.lit(need - 1))).alias("slot")).withColumn("r", F.pmod("slot", "n") + 1)
    return slots.join(r, ["author", "r"]).select(F.col("author").alias("impersonator"), F.floor(F.col("slot") / size).cast("int").alias("bundle"), F.pmod("slot", F.lit(size)).cast("int").alias("place"), "id")


def choose_bundle(assigned: DataFrame, bundles: int = 5) -> DataFrame:
    """With bundle: the SHA-1 of 'id|impersonator' picks it."""
    return assigned.withColumn("bundle", X.hash_index(F.concat_ws("|", F.col("id").cast("string"), "impersonator"), bundles).cast("int"))


def support_texts(chosen: DataFrame, bundles: DataFrame, corpus: DataFrame, words: int | None = None) -> DataFrame:
    """(id, support_ids, support_texts): the texts of each target's bundle, in its order, cut to so many words if given."""
    parts = chosen.join(bundles.withColumnRenamed("id", "sid"), ["impersonator", "bundle"]).join(corpus.select(F.col("id").alias("sid"), X.trim_words("text", words).alias("t")), "sid")
    s = parts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "sid", "t"))).alias("s"))  # a bundle's size
    return s.select("id", F.transform("s", lambda x: x["sid"]).alias("support_ids"), F.transform("s", lambda x: x["t"]).alias("support_texts"))


def impersonation_prompt(target: Column, examples: Column, impersonator: Column) -> Column:
    listed = F.array_join(F.transform(examples, lambda t, i: F.concat((i + 1).cast("string"), F.lit(") "), t)), "\n")
    return F.concat(F.lit(IMPERSONATE_HEAD), impersonator, F.lit(":\n"), listed, F.lit("\n\n" + IMPERSONATE_BODY), impersonator, F.lit(IMPERSONATE_TAIL), target, F.lit("\n\n"))


def paraphrase_prompt(target: Column) -> Column:
    return F.concat(F.lit(PARAPHRASE), target)


def verification_prompt(text1: Column, text2: Column) -> Column:
    return F.concat(F.lit(VERIFY_HEAD), F.trim(text1), F.lit("\n\nText 2:\n"), F.trim(text2), F.lit(VERIFY_TAIL))


def rewrite(prompts: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]], batch: int = 16) -> DataFrame:
    """(id, rewritten, error): runs a generator over (id, prompt). `make` is called once in each task and returns a function of a
    list of prompts; where a batch fails its prompts are tried one by one, and what fails then is a row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = make()

        def one(p: str) -> tuple[str | None, str | None]:
            try:
                return generate([p])[0], None
            except Exception as e:  # noqa: BLE001 – the error is the result
                return None, f"{type(e).__name__}: {e}"

        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                try:
                    out = [(x, None) for x in generate(part["prompt"].tolist())]
                except Exception:  # noqa: BLE001
                    out = [one(p) for p in part["prompt"]]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "rewritten": [x for x, _ in out], "error": [e for _, e in out]})

    return prompts.select("id", "prompt").mapInPandas(run, "id bigint, rewritten string, error string")


def shard_ranges(docs: DataFrame, shards: int) -> DataFrame:
    """(id, shard): ids in order cut into contiguous shards of ceil(n / shards) rows."""
    r = numbered(docs.select("id").where("id IS NOT NULL").distinct(), "id")
    n = F.broadcast(r.agg(F.ceil(F.count("*") / shards).alias("each")))  # one row
    return r.crossJoin(n).select("id", F.floor((F.col("rn") - 1) / F.col("each")).cast("int").alias("shard"))


def _layout(docs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents in order of bin, author, id (hashed); extents of bins, of authors in bins, of authors, and the total."""
    laid = materialize(numbered(docs.withColumns({"ka": X.hash_order(seed, "author"), "kd": X.hash_order(seed, "id")}), "bin", "ka", "author", "kd", "id").drop("kd"), "layout")
    by = lambda *k: laid.groupBy(*k).agg(F.min("rn").alias("b"), F.count("*").alias("n"))
    return laid, by("bin"), by("bin", "author"), by("author"), laid.agg(F.count("*").alias("n"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def adversarial_pairs(
    records: DataFrame, corpus: DataFrame, mode: str = "AA", pair_type: str = "impersonation", negatives: int = 1, most_uses: int = 50, swap: float = 0.5, seed: int = 7, rounds: int = 12
) -> DataFrame:
    """For each modified article a pair with another text of its author (label 1) and `negatives` with texts of others (label 0).

    records: (id, mod_text, ...), one row per id. Mode AA pairs with articles and prefers the modified text's length class; AT
    pairs with tweets, and its negatives take the class of the positive's tweet. Where a class has no candidate any other text
    will do. A text is a negative at most `most_uses` times: sources beyond that choose again, up to `rounds` times, after a third
    of them among all classes; what is then still unmet is missing, as are sources that the corpus lacks or whose author has no other text.
    """
    genre, edges = ("article", ARTICLE_BINS) if mode == "AA" else ("tweet", TWEET_BINS)
    docs = corpus.where(X.genre_is("genre", genre)).where("author IS NOT NULL AND id IS NOT NULL").select("id", "author", X.length_bin(F.length("text"), edges).alias("bin"))
    laid, bins, blocks, _, total = _layout(docs, seed)
    laid2 = materialize(numbered(laid.select("id", "author", "bin"), X.hash_order(seed, "author"), "author", X.hash_order(seed, "id"), "id").withColumnRenamed("rn", "ra"), "by-author")
    authors = laid2.groupBy("author").agg(F.min("ra").alias("ab"), F.count("*").alias("an"))
    n_all = F.broadcast(total.select(F.col("n").alias("n_all")))  # one row
    articles = corpus.where(X.genre_is("genre", "article")).where("author IS NOT NULL").select("id", "author")
    src = records.join(articles, "id").withColumn("bin", X.length_bin(F.length("mod_text"), ARTICLE_BINS))
    # positives: a place in the author's block of the class, or in the author's block of all classes, the source's own left out
    own = laid.select("id", F.col("bin").alias("own_bin"), F.col("rn").alias("own")).join(laid2.select("id", F.col("ra").alias("own_a")), "id")
    s = src.join(own, "id", "left").join(blocks.select("bin", "author", F.col("b").alias("bb"), F.col("n").alias("bn")), ["bin", "author"], "left").join(authors, "author", "left")
    key = F.concat_ws("|", F.col("id").cast("string"), F.lit(pair_type))
    in_bin = F.coalesce((F.col("own_bin") == F.col("bin")).cast("int"), F.lit(0)) if mode == "AA" else F.lit(0)
    nb = F.coalesce(F.col("bn"), F.lit(0)) - in_bin if mode == "AA" else F.lit(0)
    na = F.coalesce(F.col("an"), F.lit(0)) - F.col("own_a").isNotNull().cast("int")
    pick_b, pick_a = F.col("bb") + X.hash_index(key, nb), F.col("ab") + X.hash_index(key, na)
    s = s.withColumn("use_bin", nb > 0).withColumn("pb", F.when(F.col("use_bin"), pick_b + ((in_bin > 0) & (pick_b >= F.col("own"))).cast("int")))
    s = s.withColumn("pa", F.when(~F.col("use_bin") & (na > 0), pick_a + (F.col("own_a").isNotNull() & (pick_a >= F.col("own_a"))).cast("int")))
    cols = ["id", "author", "mod_text", "bin", *[c for c in ("impersonator", "support_ids", "obfuscated_from") if c in records.columns]]
    cand = F.struct(F.col("c.id").alias("id"), F.col("c.author").alias("author"), F.col("c.bin").alias("bin"))
    p1 = s.where("pb IS NOT NULL").alias("s").join(laid.alias("c"), F.col("s.pb") == F.col("c.rn")).select(*[F.col(f"s.{c}") for c in cols], cand.alias("c"))
    p2 = s.where("pa IS NOT NULL").alias("s").join(laid2.alias("c"), F.col("s.pa") == F.col("c.ra")).select(*[F.col(f"s.{c}") for c in cols], cand.alias("c"))
    pos = materialize(p1.unionByName(p2).withColumn("label", F.lit(1)), "positives")
    # negatives: a place in the class without the author's block, or among all texts without the author's
    want = pos.select(*cols, F.col("c.bin").alias("pos_bin"), F.explode(F.sequence(F.lit(1), F.lit(negatives))).alias("no"))
    want = want.withColumn("nbin", F.col("bin") if mode == "AA" else F.col("pos_bin")).drop("pos_bin")
    want = want.join(F.broadcast(bins.select(F.col("bin").alias("nbin"), F.col("b").alias("gb"), F.col("n").alias("gn"))), "nbin", "left")  # a row for each class
    want = want.join(blocks.select(F.col("bin").alias("nbin"), "author", F.col("b").alias("bb"), F.col("n").alias("bn")), ["nbin", "author"], "left").join(authors, "author", "left").crossJoin(n_all)
    want = materialize(want, "wanted")
    parts: list[DataFrame] = []  # what each turn accepted, written once
    for turn in range(rounds):
        k = F.concat_ws("|", F.col("id").cast("string"), F.lit(pair_type), F.col("no").cast("string"), F.lit(str(turn)))
        nb, na = F.coalesce("gn", F.lit(0)) - F.coalesce("bn", F.lit(0)) if turn < rounds // 3 else F.lit(0), F.col("n_all") - F.coalesce("an", F.lit(0))
        pb, pa = F.col("gb") + X.hash_index(k, nb), 1 + X.hash_index(k, na)
        w = want.withColumn("pb", F.when(nb > 0, pb + F.when(pb >= F.col("bb"), F.col("bn")).otherwise(0))).withColumn("pa", F.when((nb <= 0) & (na > 0), pa + F.when(pa >= F.col("ab"), F.col("an")).otherwise(0)))
        n1 = w.where("pb IS NOT NULL").alias("s").join(laid.alias("c"), F.col("s.pb") == F.col("c.rn")).select(*[F.col(f"s.{c}") for c in (*cols, "no")], cand.alias("c"))
        n2 = w.where("pa IS NOT NULL").alias("s").join(laid2.alias("c"), F.col("s.pa") == F.col("c.ra")).select(*[F.col(f"s.{c}") for c in (*cols, "no")], cand.alias("c"))
        new = n1.unionByName(n2).where("c.id <> id").withColumn("d", F.row_number().over(Window.partitionBy("id", "c.id").orderBy("no"))).where("d = 1").drop("d")
        if parts:
            before = _union(parts).select("id", F.col("c.id").alias("cid"))
            new = new.withColumn("cid", F.col("c.id")).join(before, ["id", "cid"], "left_anti")
            new = new.join(before.groupBy("cid").agg(F.count("*").alias("used")), "cid", "left").drop("cid")
        used = F.coalesce("used", F.lit(0)) if parts else F.lit(0)
        turn_of = F.row_number().over(Window.partitionBy("c.id").orderBy(X.hash_order(seed, "id", "no"), "id", "no"))
        parts.append(materialize(new.withColumn("u", turn_of + used).where(F.col("u") <= most_uses).select(*cols, "no", "c"), "negatives"))
        want = materialize(want.join(parts[-1].select("id", "no"), ["id", "no"], "left_anti"), "wanted")
        if want.isEmpty():
            break
    got = _union(parts)
    pairs = pos.withColumn("no", F.lit(0)).unionByName(got.withColumn("label", F.lit(0)))
    out = pairs.join(corpus.select(F.col("id").alias("cid"), F.col("text").alias("ctext")), F.col("c.id") == F.col("cid"))
    flip = X.hash_uniform(seed, "id", "label", "no") < swap
    return out.select(
        "label", F.col("mod_text").alias("text0"), F.col("ctext").alias("text1"), F.col("author").alias("author0"), F.col("c.author").alias("author1"), F.col("id").alias("id0"), F.col("c.id").alias("id1"),
        F.lit("modified_article").alias("genre0"), F.lit(genre).alias("genre1"), F.lit(pair_type).alias("pair_type"), flip.alias("swap"),
        F.when(flip, F.col("ctext")).otherwise(F.col("mod_text")).alias("left_text"), F.when(flip, F.col("mod_text")).otherwise(F.col("ctext")).alias("right_text"),
        *[c for c in cols[4:]],
    )


def pair_counters(pairs: DataFrame, records: DataFrame, negatives: int = 1) -> DataFrame:
    """One row: records, sources paired, positives, negatives, sources without a positive, negatives that are missing."""
    n = pairs.agg(F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg"), F.countDistinct("id0").alias("n_sources"))
    every = n.crossJoin(records.agg(F.countDistinct("id").alias("n_records")))  # one row each
    return every.withColumns({"n_unpaired": F.col("n_records") - F.col("n_sources"), "n_unmet": F.col("n_pos") * negatives - F.col("n_neg")})


def examples(rewritten: DataFrame, corpus: DataFrame) -> DataFrame:
    """(id, author, genre, original, rewritten): rewritten texts beside their originals; one per id."""
    m = modified_records(rewritten).groupBy("id").agg(F.min_by("mod_text", F.md5("mod_text")).alias("rewritten"))
    return corpus.where("author IS NOT NULL AND text IS NOT NULL").select("id", "author", "genre", F.col("text").alias("original")).join(m, "id")


def cross_type_samples(ex: DataFrame) -> DataFrame:
    """(author, text1, text2, same_author, type): the last article and the last tweet (by id) of each author who has both, in the
    four combinations of original and rewritten."""
    last = lambda g, p: ex.where(X.genre_is("genre", g)).groupBy("author").agg(F.max_by(F.struct("original", "rewritten"), "id").alias(p))
    both = last("article", "a").join(last("tweet", "t"), "author")
    four = [(x, y) for y in ("original", "rewritten") for x in ("original", "rewritten")]
    s = F.explode(F.array(*[F.struct(F.col(f"a.{x}").alias("text1"), F.col(f"t.{y}").alias("text2"), F.lit(f"article_{x}-tweet_{y}").alias("type")) for x, y in four]))
    return both.select("author", s.alias("s")).select("author", "s.text1", "s.text2", F.lit(True).alias("same_author"), "s.type")


def eval_samples(ex: DataFrame, articles: int = 3, tweets: int = 2, seed: int = 7) -> DataFrame:
    """(text1, text2, same_author, genre): a few originals with their rewritten texts, and per genre one with another's."""
    out = None
    for genre, n in (("article", articles), ("tweet", tweets)):
        e = ex.where(X.genre_is("genre", genre)).withColumn("k", X.hash_order(seed, "id"))
        top = e.orderBy("k", "id").limit(n).select(F.col("original").alias("text1"), F.col("rewritten").alias("text2"), F.lit(True).alias("same_author"))
        two = e.withColumn("k", X.hash_order(seed + 1, "id")).orderBy("k", "id").limit(2)
        r = two.agg(F.array_sort(F.collect_list(F.struct("k", "id", "original", "rewritten"))).alias("r")).where("size(r) = 2")  # two rows
        crossed = r.select(F.col("r")[0]["original"].alias("text1"), F.col("r")[1]["rewritten"].alias("text2"), F.lit(False).alias("same_author"))
        part = top.unionByName(crossed).withColumn("genre", F.lit(genre))
        out = part if out is None else out.unionByName(part)
    return out

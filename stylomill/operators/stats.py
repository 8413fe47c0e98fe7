"""Corpus statistics: word counts, histograms, counts by author, pair files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stylomill.functions.text import genre_is, n_words


def words_of(corpus: DataFrame) -> Column:
    """Word counts: the column n_words if the corpus has it, else counted in its texts."""
    return F.col("n_words") if "n_words" in corpus.columns else n_words("text")


def word_stats(corpus: DataFrame) -> DataFrame:
    """Rows, authors, empty texts and the spread of word counts, in total (scope ALL) and by genre (UNKNOWN for NULL); one pass.

    A NULL text is empty and has 0 words. An empty table gives no row.
    """
    rows = corpus.select(F.coalesce("genre", F.lit("UNKNOWN")).alias("g"), "author", words_of(corpus).alias("n"))
    q = F.percentile("n", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.9)]))
    both = rows.groupingSets([[], ["g"]], "g").agg(
        F.grouping("g").alias("total"), F.count("*").alias("n_docs"), F.countDistinct("author").alias("n_authors"), F.count_if(F.col("n") == 0).alias("n_empty"),
        F.min("n").alias("min_words"), F.max("n").alias("max_words"), F.round(F.avg("n"), 6).alias("mean_words"), q.alias("q"),
    )
    return both.where("n_docs > 0").select(
        F.when(F.col("total") == 1, "ALL").otherwise(F.col("g")).alias("scope"), "n_docs", "n_authors", "n_empty", "min_words", "max_words", "mean_words",
        *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p25", "p50", "p75", "p90"))],
    )


def _bins(x: DataFrame) -> DataFrame:
    """One row: lo, hi and the Freedman-Diaconis number of bins (50 without spread of quartiles, 10 for fewer than two values, at least 10)."""
    s = x.agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.percentile("x", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    iqr = F.col("q")[1] - F.col("q")[0]
    width = 2 * iqr / F.pow(F.col("n").cast("double"), F.lit(1 / 3))
    k = F.when(F.col("n") < 2, 10).when(iqr <= 0, 50).otherwise(F.greatest(F.lit(10), F.ceil((F.col("hi") - F.col("lo")) / width)))
    flat = F.col("lo") == F.col("hi")
    return s.select(F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo").cast("double")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi").cast("double")).alias("hi"), k.cast("int").alias("k"))


def histogram(corpus: DataFrame, clip: tuple[float, float] | None = None) -> DataFrame:
    """(bin, lo_edge, n) of positive word counts in equal-width bins; with clip, of those within the two percentiles.

    The last bin holds its right edge. Empty bins have no row.
    """
    x = corpus.select(words_of(corpus).cast("double").alias("x")).where("x > 0")
    if clip:
        cut = x.agg(F.percentile("x", F.array(F.lit(clip[0]), F.lit(clip[1]))).alias("c"))
        x = x.crossJoin(F.broadcast(cut)).where("x >= c[0] AND x <= c[1]").select("x")  # one row
    at = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("k")) + 1, F.col("k"))
    counted = x.crossJoin(F.broadcast(_bins(x))).groupBy(at.cast("int").alias("bin"), "lo", "hi", "k").agg(F.count("*").alias("n"))  # one row
    return counted.select("bin", F.round(F.col("lo") + (F.col("bin") - 1) * (F.col("hi") - F.col("lo")) / F.col("k"), 6).alias("lo_edge"), "n")


def ecdf(corpus: DataFrame) -> DataFrame:
    """(n_words, n, share of texts with at most so many words), one row per distinct positive word count."""
    c = corpus.select(words_of(corpus).alias("n_words")).where("n_words > 0").groupBy("n_words").agg(F.count("*").alias("n"))
    run = F.sum("n").over(Window.orderBy("n_words"))
    return c.select("n_words", "n", F.round(run / F.sum("n").over(Window.partitionBy()), 9).alias("share"))


def boxplot(corpus: DataFrame) -> DataFrame:
    """Five-number summary of positive word counts by genre; whiskers end at the last value within 1.5 interquartile ranges."""
    x = corpus.select(F.coalesce("genre", F.lit("UNKNOWN")).alias("genre"), words_of(corpus).alias("x")).where("x > 0")
    counted = x.groupBy("genre", "x").agg(F.count("*").alias("f"))
    q = counted.groupBy("genre").agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("f")).alias("q"))
    lo, hi = F.col("q")[0] - 1.5 * (F.col("q")[2] - F.col("q")[0]), F.col("q")[2] + 1.5 * (F.col("q")[2] - F.col("q")[0])
    inside = (F.col("x") >= lo) & (F.col("x") <= hi)
    return counted.join(F.broadcast(q), "genre").groupBy("genre", "q").agg(F.min(F.when(inside, F.col("x"))).alias("whisker_lo"), F.max(F.when(inside, F.col("x"))).alias("whisker_hi"), F.sum("f").alias("n")).select(
        "genre", "n", "whisker_lo", F.round(F.col("q")[0], 6).alias("q1"), F.round(F.col("q")[1], 6).alias("median"), F.round(F.col("q")[2], 6).alias("q3"), "whisker_hi"
    )


def author_genre_counts(corpus: DataFrame) -> DataFrame:
    """(author, total, article, tweet), letter case of the genre aside; other genres count in the total only."""
    return corpus.groupBy("author").agg(F.count("*").alias("total"), F.count_if(genre_is("genre", "article")).alias("article"), F.count_if(genre_is("genre", "tweet")).alias("tweet"))


def top_authors(corpus: DataFrame, least: int) -> DataFrame:
    return author_genre_counts(corpus).where(F.col("total") >= least).orderBy(F.desc("total"), "author")


def pair_stats(pairs: DataFrame) -> DataFrame:
    """Per pair file: pairs, positive, negative, their ratio, distinct documents and authors over both sides."""
    keys = ["dataset", "mode", "split"]
    total = pairs.groupBy(*keys).agg(F.count("*").alias("pairs_total"), F.count_if(F.col("label") == 1).alias("pairs_pos"), F.count_if(F.col("label") == 0).alias("pairs_neg"))
    sides = pairs.select(*keys, F.explode(F.array(F.struct(F.col("id0").alias("id"), F.col("author0").alias("a")), F.struct(F.col("id1").alias("id"), F.col("author1").alias("a")))).alias("s"))
    # two levels: distinct values are folded before they meet
    docs = sides.select(*keys, "s.id").distinct().groupBy(*keys).agg(F.count("id").alias("unique_docs"))
    authors = sides.select(*keys, "s.a").distinct().groupBy(*keys).agg(F.count("a").alias("unique_authors"))
    same = lambda x, y: [x[k].eqNullSafe(y[k]) for k in keys]
    t, d, a = total.alias("t"), docs.alias("d"), authors.alias("a")
    j = t.join(d, [F.col(f"t.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys]).join(a, [F.col(f"t.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys])
    return j.select(*[F.col(f"t.{k}") for k in keys], "pairs_total", "pairs_pos", "pairs_neg", F.round(F.col("pairs_pos") / F.col("pairs_total"), 3).alias("pos_ratio"), "unique_docs", "unique_authors")


def pair_stats_pivot(pairs: DataFrame) -> DataFrame:
    """One row per dataset and mode, the measures of the three splits side by side."""
    m = ["pairs_total", "pairs_pos", "pairs_neg", "unique_docs", "unique_authors"]
    p = pair_stats(pairs).groupBy("dataset", "mode").pivot("split", ["train", "val", "test"]).agg(*[F.first(c).alias(c) for c in m])
    return p.select("dataset", "mode", *[F.col(f"{s}_{c}") for s in ("train", "val", "test") for c in m])


def basic_stats(pairs: DataFrame) -> DataFrame:
    """Per split: labels, positive share and words of both texts."""
    w0, w1 = n_words("text0"), n_words("text1")
    return pairs.select("split", "label", w0.alias("w0"), w1.alias("w1")).groupBy("split").agg(
        F.count("*").alias("n_pairs"), F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg"), F.round(F.avg((F.col("label") == 1).cast("int")), 6).alias("pos_share"),
        *[f(w).cast(t).alias(f"{n}_{w}") for w in ("w0", "w1") for n, f, t in (("min", F.min, "bigint"), ("max", F.max, "bigint"))], *[F.round(F.avg(w), 6).alias(f"avg_{w}") for w in ("w0", "w1")],
    )


def authors_in_pairs(corpus: DataFrame, pairs: DataFrame, genre: str | None = "article") -> DataFrame:
    """(author, n_docs): documents of that genre that occur in pairs, most first."""
    ids = pairs.select(F.explode(F.array("id0", "id1")).alias("id")).distinct()
    docs = corpus.where(genre_is("genre", genre)) if genre else corpus
    return docs.join(ids, "id", "left_semi").groupBy("author").agg(F.countDistinct("id").alias("n_docs")).orderBy(F.desc("n_docs"), "author")


def matching_bounds(corpus: DataFrame) -> DataFrame:
    """One row: how many article-tweet pairs a corpus allows. Positive: the smaller count of each author, added up. Negative: the
    largest matching without two texts of one author among the first m articles and tweets by id, m the smaller number; by Hall's
    theorem it is m less what the author with most of both has beyond m."""
    from stylomill.operators.ranks import numbered

    docs = corpus.where("author IS NOT NULL AND id IS NOT NULL").select("id", "author", genre_is("genre", "article").alias("a"), genre_is("genre", "tweet").alias("t"))
    by = docs.groupBy("author").agg(F.count_if("a").alias("n_a"), F.count_if("t").alias("n_t"))
    sums = by.agg(F.coalesce(F.sum("n_a"), F.lit(0)).alias("articles"), F.coalesce(F.sum("n_t"), F.lit(0)).alias("tweets"), F.coalesce(F.sum(F.least("n_a", "n_t")), F.lit(0)).alias("pos_upper"), F.count_if(F.expr("n_a > 0 AND n_t > 0")).alias("authors_both"))
    m = F.least("articles", "tweets")
    ra, rt = (numbered(docs.where(c), "id") for c in ("a", "t"))
    cut = sums.select(m.alias("m"))
    used = ra.unionByName(rt).crossJoin(F.broadcast(cut)).where("rn <= m").groupBy("author").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"))  # one row
    return sums.crossJoin(used).select("articles", "tweets", "authors_both", "pos_upper", (m - F.greatest(F.lit(0), F.col("most") - m)).alias("neg_upper"))


def feasibility(bounds: DataFrame, target: int) -> DataFrame:
    """Whether a balanced set of `target` pairs is possible, and by how much it falls short."""
    most = 2 * F.least("pos_upper", "neg_upper")
    return bounds.select("*", most.alias("max_balanced"), F.lit(target).alias("target"), F.greatest(F.lit(0), F.lit(target) - most).alias("shortfall"), F.when(most >= target, "OK").otherwise("SHORT").alias("verdict"))

"""Cleaning of the corpus: duplicates, short and foreign texts, marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stylomill.functions import text as X


def dedup_author_text(corpus: DataFrame) -> DataFrame:
    """(id, copies): of the rows with one author and one text the smallest id, and how many rows it stands for.

    NULLs equal one another. Texts are grouped by digest and length (text_md5 and n_chars, if the corpus has these instead), so no
    text is shuffled, and folded before the shuffle.
    """
    digest = (F.col("text_md5"), F.col("n_chars")) if "text_md5" in corpus.columns else (F.md5("text"), F.length("text"))
    keyed = corpus.select("id", "author", digest[0].alias("h"), digest[1].alias("n"))
    return keyed.groupBy("author", "h", "n").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "copies")


def duplicate_texts(corpus: DataFrame) -> DataFrame:
    """Texts that several rows have (NULL is one text): digest, rows, distinct authors, first id."""
    keyed = corpus.select("id", "author", F.col("text_md5") if "text_md5" in corpus.columns else F.md5("text").alias("text_md5"))
    by = keyed.groupBy("text_md5", "author").agg(F.count("*").alias("n"), F.min("id").alias("i"))
    return by.groupBy("text_md5").agg(F.sum("n").alias("n_rows"), F.count("author").alias("n_authors"), F.min("i").alias("first_id")).where("n_rows > 1")


def drop_short(corpus: DataFrame, genre: str = "Article", least: int = 20) -> DataFrame:
    """Without texts of that genre (as spelled) of fewer words; NULL text has 0 words, NULL genre stays."""
    return corpus.where(~(F.coalesce(F.col("genre") == genre, F.lit(False)) & (X.n_words("text") < least)))


def texts_of_length(corpus: DataFrame, n: int, genre: str | None = None) -> DataFrame:
    """Rows of exactly n words; 0 finds NULL, empty and blank texts."""
    found = corpus.where((F.col("n_words") if "n_words" in corpus.columns else X.n_words("text")) == n)
    return found.where(X.genre_is("genre", genre)) if genre else found


def exclude_author(corpus: DataFrame, author: str) -> DataFrame:
    """Rows of other authors, NULL authors among them."""
    return corpus.where(~F.col("author").eqNullSafe(author))


def english_only(corpus: DataFrame, least: float = 0.8) -> DataFrame:
    """Rows whose letters are ASCII by that share; NULL texts and texts without letters go."""
    return corpus.where(X.english_share("text") >= least)


def with_marks(corpus: DataFrame) -> DataFrame:
    """With pe_seq (marks joined by blanks) and pe_len."""
    return corpus.withColumn("pe", X.marks("text")).select(*corpus.columns, F.array_join("pe", " ").alias("pe_seq"), F.size("pe").alias("pe_len"))


def _marks(corpus: DataFrame):
    """The marks of a text, or the column of them that the corpus has already."""
    return F.col("marks") if "marks" in corpus.columns else X.marks("text")


def with_mark_counts(corpus: DataFrame, most: int) -> DataFrame:
    """With pe_counts, a map from n-gram of marks to its count (NULL without marks). Ids must be unique."""
    each = corpus.select("id", F.explode(X.ngrams(_marks(corpus), most)).alias("g")).groupBy("id", "g").agg(F.count("*").cast("int").alias("n"))
    maps = each.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("g", "n"))).alias("pe_counts"))
    return corpus.join(maps, "id", "left")


def mark_ngrams(corpus: DataFrame, most: int) -> DataFrame:
    """(ngram, n): n-grams of marks over the whole corpus."""
    return corpus.select(F.explode(X.ngrams(_marks(corpus), most)).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("n"))


def clean_corpus(corpus: DataFrame, least: float = 0.8) -> DataFrame:
    """The cleaning stage as a whole: marks of the raw text, symbols stripped, English only, tweets masked."""
    marked = with_marks(corpus).withColumn("text", X.strip_symbols("text"))
    return english_only(marked, least).withColumn("text", X.mask_tweet("text", "genre"))

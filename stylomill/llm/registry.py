"""The pN_ queries: each applies an operator of this package to its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stylomill.llm.near_duplicates import near_duplicate_pairs

    return near_duplicate_pairs(_table(spark, sf_dir, "docs"), threshold=0.6, n=3, least_words=8)


def p1_near_duplicate_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stylomill.llm.near_duplicates import near_duplicate_classes

    return near_duplicate_classes(_table(spark, sf_dir, "docs"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stylomill.llm.responses import defective_responses

    return defective_responses(_table(spark, sf_dir, "rewritten"), _table(spark, sf_dir, "docs"))


def p2_defect_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_found(spark, sf_dir).groupBy("field", "defect").agg(F.count("*").alias("n_responses"), F.countDistinct("id").alias("n_ids"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stylomill.llm.personal_data import personal_items

    return personal_items(_table(spark, sf_dir, "docs"))


def p3_masked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stylomill.llm.personal_data import masked_texts

    return masked_texts(_table(spark, sf_dir, "docs"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stylomill.llm.split_overlap import split_overlaps

    pairs = split_overlaps(_table(spark, sf_dir, "pairs"), threshold=0.6)
    return pairs.select("dataset", "split", F.least("id_eval", "id_train").alias("id_a"), F.greatest("id_eval", "id_train").alias("id_b")).distinct()


def p4_overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stylomill.llm.split_overlap import overlap_report

    return overlap_report(_table(spark, sf_dir, "pairs"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stylomill.llm.group_split import linked_pairs

    return linked_pairs(_table(spark, sf_dir, "pairs"))


def p5_author_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stylomill.llm.group_split import split_by_author

    return split_by_author(_table(spark, sf_dir, "pairs"), _table(spark, sf_dir, "docs"))


def p5_row_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stylomill.llm.group_split import split_rows

    return split_rows(_table(spark, sf_dir, "pairs"), _table(spark, sf_dir, "docs"))


def p5_component_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per component of linked authors: its authors, and the splits they are in (one)."""
    return p5_author_splits(spark, sf_dir).groupBy("component").agg(F.count("*").alias("n_authors"), F.countDistinct("split").alias("n_splits"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stylomill.llm.packing import pack_segments

    return pack_segments(_table(spark, sf_dir, "segments")).where("n_pieces > 1 AND id IS NOT NULL").select("id").distinct()


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stylomill.llm.packing import pack_segments

    return pack_segments(_table(spark, sf_dir, "segments"))


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per segment id: its texts' words as placed, the pieces they are in, and the words of the largest piece."""
    placed = p6_containers(spark, sf_dir).where("id IS NOT NULL")
    return placed.groupBy("id").agg(F.sum("n_words").alias("n_words"), F.count("*").alias("n_pieces"), F.max("n_words").alias("largest"))


def p6_fill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stylomill.llm.packing import fill_report, pack_segments

    return fill_report(pack_segments(_table(spark, sf_dir, "segments")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stylomill.llm.leakage import leaked_passages

    return leaked_passages(_table(spark, sf_dir, "eval_items"), _table(spark, sf_dir, "documents"), least=0.4).select("item_id", "doc_id")


def p7_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation item that leaked: the documents that hold it and the largest share of it in one of them."""
    from stylomill.llm.leakage import leaked_passages

    found = leaked_passages(_table(spark, sf_dir, "eval_items"), _table(spark, sf_dir, "documents"), least=0.4)
    return found.groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max(F.round(F.col("n_shared") / F.col("n_item"), 6)).alias("largest_share"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stylomill.llm.mixture import mixture

    return mixture(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stylomill.llm.mixture import mixture

    return mixture(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))[1]


def p8_feasible_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of the largest mixture in which every source reaches its own."""
    from stylomill.llm.mixture import mixture

    return mixture(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"), size="feasible")[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stylomill.llm.canonical import look_alike_pairs

    return look_alike_pairs(_table(spark, sf_dir, "documents"))


def p9_canonical_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stylomill.llm.canonical import canonical_texts

    return canonical_texts(_table(spark, sf_dir, "documents"))


QUERIES = [p1_found, p1_near_duplicate_classes, p2_found, p2_defect_counts, p3_found, p3_masked_texts, p4_found, p4_overlap_report, p5_found, p5_author_splits, p5_row_splits, p5_component_splits, p6_found, p6_containers, p6_pieces, p6_fill_report, p7_found, p7_leaked_items, p8_mixture, p8_shares, p8_feasible_shares, p9_found, p9_canonical_texts]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict:
    from stylomill.llm.sql import SQL

    return dict(SQL)

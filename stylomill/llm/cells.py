"""All pairs inside groups, where the pairs are what is asked for: large groups are dealt to cells of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Rows of a group that meet in one cell.
BLOCK = 2048


def pairs_within(rows: DataFrame, key: str | Column, item: str | Column, block: int = BLOCK) -> DataFrame:
    """(x, y), x < y: the pairs of different items of each group; item is a column of any ordered type.

    Each block of a group's rows meets each other block, and itself, in a cell of its own: no task sees a whole large group.
    """
    r = rows.select((F.col(key) if isinstance(key, str) else key).alias("key"), (F.col(item) if isinstance(item, str) else item).alias("item")).where("key IS NOT NULL").distinct()
    blocks = r.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / block).cast("int").alias("m"))
    own = r.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("item"), F.col("m")).cast("int"))
    low = own.select("key", F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.col("m") - 1)).alias("j"), F.col("item").alias("p"))
    high = own.select("key", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"), F.col("item").alias("q"))
    return low.join(high, ["key", "i", "j"]).where("i < j OR p < q").select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"))

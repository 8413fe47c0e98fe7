"""Row numbers over a whole table without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stylomill.session import materialize


def _ranged(df: DataFrame, keys: list[Column]) -> DataFrame:
    """df in range partitions of the keys (columns _k0, _k1, ...), with the partition's number _p; written once."""
    return materialize(df.withColumns({f"_k{i}": k for i, k in enumerate(keys)}).repartitionByRange(*[f"_k{i}" for i in range(len(keys))]).withColumn("_p", F.spark_partition_id()), "ranged")


def numbered_within(df: DataFrame, group: str, *order: Column | str, name: str = "r") -> DataFrame:
    """df with the row number (from 1) inside each group, in the given order, which must be total; groups aren't NULL.

    A group with a third of all rows lies in many range partitions: rows are numbered inside these, and what the group has in
    earlier partitions is added (a row for each partition and group).
    """
    keys = [F.col(group), *(F.col(c) if isinstance(c, str) else c for c in order)]
    ranged = _ranged(df, keys)
    sizes = ranged.groupBy("_p", group).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_p", group, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_p", group).orderBy(*[f"_k{i}" for i in range(1, len(keys))]))
    out = ranged.withColumn("_r", inside).join(before, ["_p", group])
    return out.withColumn(name, F.col("_r") + F.col("_before")).drop("_p", "_r", "_before", *[f"_k{i}" for i in range(len(keys))])


def numbered(df: DataFrame, *order: Column | str, name: str = "rn") -> DataFrame:
    """df with its row number (from 1) in the given order, which must be total.

    Rows are range-partitioned by the order and numbered within partitions; the sizes of the partitions (one row each) are
    what is added up. The partitioned rows are written once, so that every use sees the same ranges.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = _ranged(df, keys)
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*[f"_k{i}" for i in range(len(keys))]))
    out = ranged.withColumn("_r", inside).join(F.broadcast(before), "_p")  # a row for each partition
    return out.withColumn(name, F.col("_r") + F.col("_before")).drop("_p", "_r", "_before", *[f"_k{i}" for i in range(len(keys))])

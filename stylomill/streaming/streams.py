"""Structured Streaming forms of the batch work: append-and-resume, and counts over windows with late data."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from stylomill.session import remove_at_end, shared_dir


def process_new(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], fmt: str = "parquet") -> StreamingQuery:
    """Runs `work` over files that came since the last run and appends its rows: the checkpoint remembers what was done, so a run
    that broke off goes on where it stood. Ends when there is nothing new."""
    rows = spark.readStream.schema(schema).format(fmt).load(source)

    def write(batch: DataFrame, _: int) -> None:
        work(batch).write.mode("append").parquet(out)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", value: str = "value", width: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """(window_start, key, n, total): tumbling windows; rows later than the watermark are left out of a stream.

    late None keeps the watermark that the stream has already.
    """
    e = events.withWatermark(time, late) if events.isStreaming and late else events
    return e.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def deduplicated(events: DataFrame, key: str = "event_id", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once, repeats within the watermark dropped."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def run_complete(stream: DataFrame, name: str) -> DataFrame:
    """Runs an aggregating stream over what there is; its whole result lies in the shared folder and is read from there."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows")

    q = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    remove_at_end(spark, path)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is and returns its rows, from a table in memory: for small results and tests."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)

"""Structured Streaming forms of ingestion: idempotent polling and live feed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def deduplicated(signals: DataFrame, key: tuple[str, ...] = ("source", "external_id"), time: str = "ingested_at", within: str = "7 days") -> DataFrame:
    """A stream of signals without replays of one key. State is kept for `within`, so a replay that comes later than that
    after the first is left to the batch writer's anti-join."""
    return signals.withWatermark(time, within).dropDuplicatesWithinWatermark(list(key))


def counts_by_window(signals: DataFrame, time: str = "ingested_at", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """How many signals of each source arrived in each window; windows close `late` after their end."""
    return signals.withWatermark(time, late).groupBy(F.window(time, size), "source").agg(F.count("*").alias("n"))


def append_new(target: str, key: list[str], order: list[str], upsert: Callable[[DataFrame, DataFrame, list[str], list[str]], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer: each micro-batch's unknown keys go to a Parquet table; a batch that is tried again adds
    nothing, for its rows are known by then."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.parquet(target)
        except Exception as e:  # the table does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            known = batch.limit(0)
        # materialised by the write itself: known is only read by the anti-join of the same job
        upsert(batch, known, key, order).write.mode("append").parquet(target)

    return write


def run_once(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """All that is there, in micro-batches, then stop: the cursor is the checkpoint."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def claims_of_new_signals(cursors: str, mint: Callable[[DataFrame], DataFrame], target: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer of incremental claims: founders keep a cursor on the ingestion time of what their claims were
    built from, signals at or before it are skipped, `mint` turns the others into claims, and cursors move on.

    Cursors are a Parquet table of (founder_id, last_claimed_at, batch_id); the latest row of a founder counts. A batch that
    is tried again sees the cursors of the batches before it, writes its own partition of the target anew and so adds
    nothing twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = "founder_id long, last_claimed_at timestamp, batch_id long"
        try:
            known = spark.read.schema(schema).parquet(cursors)
        except Exception as e:  # the table does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = spark.createDataFrame([], schema)
        at = known.filter(F.col("batch_id") < batch_id).groupBy("founder_id").agg(F.max("last_claimed_at").alias("last_claimed_at"))
        fresh = batch.join(at, "founder_id", "left").filter(F.col("last_claimed_at").isNull() | (F.col("ingested_at") > F.col("last_claimed_at")))
        path = fresh.withColumn("path", F.when(F.col("last_claimed_at").isNull(), "cold").otherwise("warm")).drop("last_claimed_at")
        mint(path).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        moved = fresh.groupBy("founder_id").agg(F.max("ingested_at").alias("last_claimed_at")).withColumn("batch_id", F.lit(batch_id).cast("long"))
        moved.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(cursors)

    return write

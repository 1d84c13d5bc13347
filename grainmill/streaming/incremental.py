"""Incremental forms: rescans against a baseline, a cache whose entries expire, the state of jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainmill.operators.baseline import match


def rescan(spark: SparkSession, source: str, schema: str, prior: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """SS01: findings that arrive as Parquet are compared with the baseline batch by batch; ends when all that is there is read."""

    def each(batch: DataFrame, number: int) -> None:
        sink(match(batch, prior), number)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


SEEN = "fp string, n long"


def rescan_into(spark: SparkSession, source: str, schema: str, prior: DataFrame, path: str, files_a_batch: int = 1) -> None:
    """SS01 over many batches: a copy of a fingerprint uses up one of the baseline's, whichever batch it comes in; ends when all that is there is read.

    Findings (fp, seq, …) with their `state` go to `path`/results/batch=N, and how many of each fingerprint a batch had to
    `path`/seen/batch=N. A batch reads what batches before it have seen and replaces what an earlier try of itself wrote, so
    a run that was broken off and started again at the same path gives each finding once. A copy's place in a batch is by
    counts, not by gathering a fingerprint's findings: only fingerprints that the baseline holds are numbered.
    """
    spark.createDataFrame([], SEEN).coalesce(1).write.mode("ignore").parquet(f"{path}/seen/batch=-1")
    had = prior.groupBy("fp").agg(F.count("*").alias("__had"))

    def each(batch: DataFrame, number: int) -> None:
        seen = spark.read.schema(f"{SEEN}, batch long").parquet(f"{path}/seen").filter(F.col("batch") < number).groupBy("fp").agg(F.sum("n").alias("__seen"))
        # What the baseline has left for this batch.
        left = had.join(seen, "fp", "left").select("fp", (F.col("__had") - F.coalesce("__seen", F.lit(0))).alias("__left")).filter("__left > 0")
        batch.groupBy("fp").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/seen/batch={number}")
        held = batch.join(left, "fp").withColumn("__k", F.row_number().over(Window.partitionBy("fp").orderBy("seq")))
        known = held.withColumn("state", F.when(F.col("__k") <= F.col("__left"), "unchanged").otherwise("new")).drop("__k", "__left")
        fresh = batch.join(left.select("fp"), "fp", "left_anti").withColumn("state", F.lit("new"))
        known.select(*batch.columns, "state").unionByName(fresh).write.mode("overwrite").parquet(f"{path}/results/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("recursiveFileLookup", "true").parquet(source)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """SS02: counts by hour and kind; state older than the watermark goes, as cache entries do at their end."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


def job_states(events: DataFrame) -> DataFrame:
    """SS03: the latest state of each job by time, then id; the same expression in batch and stream (update mode)."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))

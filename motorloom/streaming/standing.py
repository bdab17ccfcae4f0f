"""Standing queries and ingest as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TTL_DAYS = 3


def read_posts(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def listing_key(rows: DataFrame, parts: list[str]) -> DataFrame:
    return rows.withColumn("dedup_key", F.sha1(F.concat_ws("_", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts))))


def fresh_only(rows: DataFrame, at: str, parts: list[str], days: int = TTL_DAYS) -> DataFrame:
    """Each listing once within the time to live, by event time; state older than that is dropped."""
    return listing_key(rows, parts).withWatermark(at, f"{days} days").dropDuplicatesWithinWatermark(["dedup_key"])


def daily_counts(rows: DataFrame, at: str, late: str = "2 days") -> DataFrame:
    day = F.window(at, "1 day")
    g = rows.withWatermark(at, late).groupBy(day).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("day"), "n")


def run_available(rows: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Every batch that is there now through ``apply``; a restart goes on where the checkpoint says."""
    q = rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))

"""Incremental work on arriving files with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arrivals(spark: SparkSession, path: str, schema: str, suffix: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", suffix).parquet(path)


def ingest(stream: DataFrame, out: str, checkpoint: str, key: str, work: Callable[[DataFrame], DataFrame] | None = None, valid: Callable[[DataFrame], bool] | None = None) -> StreamingQuery:
    """Appends work(batch) of all files that are there, each key once; what was done is not done again after a restart.

    A batch that valid() refuses raises, so its files stay unread for the next start.
    """

    def fill(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if valid and not valid(batch):
            raise ValueError(f"batch {number} is not valid")
        fresh = batch.dropDuplicates([key])
        try:
            done = spark.read.parquet(out).where(F.col("batch") < number).select(key).distinct()
            fresh = fresh.join(done, key, "left_anti")
        except Exception as missing:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
                raise
        (work(fresh) if work else fresh).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(fill).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts by event-time window and key, final once the watermark has passed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")

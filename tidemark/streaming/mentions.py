"""Streaming forms of batch steps: an addition, with the batch semantics where they carry over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import mention_id


def monthly_counts(stream: DataFrame, timestamp: str = "ts", key: str = "event_type", lateness: str = "2 days") -> DataFrame:
    """Counts by calendar day and key, final once the watermark has passed; sum them for months."""
    days = stream.withWatermark(timestamp, lateness).groupBy(F.window(timestamp, "1 day"), key)
    return days.agg(F.count(F.lit(1)).alias("n")).select(F.to_date("window.start").alias("day"), key, "n")


def exact_mentions(stream: DataFrame, timestamp: str = "published_at", lateness: str = "7 days") -> DataFrame:
    """The first of every mention with the same article and span, as far back as the watermark goes."""
    keyed = stream.withColumn("event_id", mention_id(F.col("article_id"), F.col("evidence")))
    return keyed.withWatermark(timestamp, lateness).dropDuplicatesWithinWatermark(["event_id"])


def upsert_batches(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str):
    """A query that keeps the last row of each key under path; a batch that is repeated writes the same version.

    Versions are folders named by batch; the reader takes the greatest that is complete.
    """
    from ..sources.sinks import upsert

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={number - 1}/_SUCCESS")
        there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        fresh = batch.drop(order)
        current = spark.read.parquet(f"{path}/version={number - 1}") if there else spark.createDataFrame([], fresh.schema)
        upsert(current, batch, keys, order).write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)

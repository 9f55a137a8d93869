"""Release days as a stream: each micro-batch of seeds is counted or traced as it arrives."""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from tidewright.operators.report import by_day


def daily_counters(spark: SparkSession, folder: str, schema: str, late: str = "1 day", when: str = "ended_at") -> DataFrame:
    """Counters by release day over a stream of ended particles, for output mode ``append``.

    Days are windows of event time: a day's row comes out, and its state goes, once the watermark (``late`` behind the latest ``when``) has
    passed its end; rows that come later than that are left out.
    """
    ended = spark.readStream.schema(schema).parquet(folder).withWatermark(when, late)
    counted = by_day(ended, F.window(when, "1 day").alias("day"))
    return counted.select(F.col("day")["start"].cast("date").alias("release_day"), *[c for c in counted.columns if c != "day"])


def trace_releases(seeds: DataFrame, trace: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    """Runs ``trace`` on every micro-batch and appends its result under the batch's number, so a repeated batch replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        trace(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return seeds.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""The recurring-problem register and hourly counts as incremental queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hangarlake.functions import text as x


def hourly_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", late: str = "2 hours") -> DataFrame:
    """(kind, begin, n): counts by hour; rows later than the watermark are dropped, as state has a bound."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, "1 hour"), kind).agg(F.count("*").alias("n")).select(kind, F.col("window.start").alias("begin"), "n")


def first_deliveries(records: DataFrame, key: str = "record_id", time: str = "received_at", late: str = "7 days") -> DataFrame:
    """Each record once: repeated deliveries within the watermark are dropped."""
    return records.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def register_updates(records: DataFrame) -> DataFrame:
    """(near_key, work_orders, bad): running counts of each problem, for an update-mode sink."""
    return records.groupBy(x.near_key("problem_text").alias("near_key")).agg(F.count("*").alias("work_orders"), F.count_if(x.outcome("action_text").isin("negative", "mixed")).alias("bad"))

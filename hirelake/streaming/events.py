"""The event log as a stream: exactly-once append, live daily counts, current status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.operators.events import EVENT_FOR_STATUS

DELAY = "1 hour"


def stream_event_dedupe(events: DataFrame, delay: str = DELAY, key: str = "event_id", time: str = "occurred_at") -> DataFrame:
    """Events once each, however often a client sent them within `delay`."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def stream_daily_activity(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Applications sent per user and UTC day; late events count until the watermark passes."""
    return (
        events.filter(F.col("type") == "APPLICATION_SENT")
        .withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))
        .withWatermark("occurred_at", delay)
        .groupBy(F.window("occurred_at", "1 day"), "user_id")
        .agg(F.count("*").alias("sent"))
        .select("user_id", F.date_format("window.start", "yyyy-MM-dd").alias("date"), "sent")
    )


def stream_status_fold(events: DataFrame) -> DataFrame:
    """Current status per application, for update mode: one small state row per application."""
    status = F.lit(None).cast("string")
    for s, e in [*EVENT_FOR_STATUS.items(), ("WISHLIST", "APPLICATION_CREATED")]:
        status = F.when(F.col("type") == e, s).otherwise(status)
    return (
        events.withColumn("status", status)
        .filter(F.col("status").isNotNull() & F.col("application_id").isNotNull())
        .groupBy("application_id")
        .agg(F.max(F.struct("occurred_at", "event_id", "status")).alias("last"))
        .select("application_id", F.col("last.status").alias("status"), F.col("last.occurred_at").alias("since"))
    )

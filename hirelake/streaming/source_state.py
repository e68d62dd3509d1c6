"""Crawl state per source URL, kept by the stream itself."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hirelake.functions.urls import normalise_source_url
from hirelake.operators.crawl import SchedulePolicy, backoff_hours

STATE = T.StructType(
    [
        T.StructField("failure_count", T.IntegerType()),
        T.StructField("last_error", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("job_count", T.IntegerType()),
        T.StructField("last_checked_at", T.TimestampType()),
        T.StructField("last_changed_at", T.TimestampType()),
        T.StructField("last_synced_at", T.TimestampType()),
    ]
)
OUTPUT = T.StructType([T.StructField("url", T.StringType()), *STATE.fields])


class SourceStateProcessor(StatefulProcessor):
    """Folds the finished runs of one URL, in time order, into its state row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = STATE.names
        kept = self.state.get()
        now = dict(zip(names, kept)) if kept is not None else dict.fromkeys(names) | {"failure_count": 0, "job_count": 0}
        for run in pd.concat(list(rows)).sort_values(["at", "error", "content_hash", "job_count"], kind="stable").itertuples():
            now["last_checked_at"] = run.at
            failed = isinstance(run.error, str) and run.error != ""
            now["failure_count"] = now["failure_count"] + 1 if failed else 0
            now["last_error"] = run.error if failed else None
            if isinstance(run.content_hash, str):
                now["content_hash"] = run.content_hash
            if pd.notna(run.job_count):
                now["job_count"] = int(run.job_count)
            if run.changed is True:
                now["last_changed_at"] = run.at
            if run.synced is True:
                now["last_synced_at"] = run.at
        self.state.update(tuple(now[n] for n in names))
        yield pd.DataFrame([{"url": key[0], **now}])

    def close(self) -> None:
        pass


def stream_source_state(runs: DataFrame) -> DataFrame:
    """Runs (url, at, error, content_hash, job_count, changed, synced) to updated state rows."""
    keyed = runs.select(
        normalise_source_url(F.col("url")).alias("url"), F.col("at").cast("timestamp").alias("at"), "error",
        "content_hash", "job_count", "changed", "synced",
    )
    return keyed.groupBy("url").transformWithStateInPandas(
        statefulProcessor=SourceStateProcessor(), outputStructType=OUTPUT, outputMode="Update", timeMode="None"
    )


def with_backoff(states: DataFrame, policy: SchedulePolicy = SchedulePolicy()) -> DataFrame:
    return states.withColumn("backoff_hours", backoff_hours(F.col("failure_count"), policy.max_failures_before_backoff))

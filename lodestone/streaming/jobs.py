"""Answer logs and calls as streams: windows, repeats, sessions, idempotent starts and last states."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a TIMESTAMP; zoneless times count as the session's zone."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def tumbling_counts(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and their value by window and type, late events up to ``late`` included."""
    rows = event_time(events).withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return rows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """A user's events without a pause of ``gap``."""
    rows = event_time(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return rows.agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


def first_events(events: DataFrame, key: list[str], late: str = "1 hour") -> DataFrame:
    """Each event once, by key, while the watermark remembers it."""
    return event_time(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def monthly_usage(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Calls by key and calendar month; months are truncated times, as windows may not be so long."""
    month = F.date_format(F.date_trunc("month", "ts"), "yyyy-MM")
    return event_time(events).groupBy(key, month.alias("month")).agg(F.count("*").alias("calls"))


class Starts(StatefulProcessor):
    """The first job of a key opens a span of ``SECONDS``; starts inside it get that job's id.  Failed jobs don't count."""

    SECONDS = 60

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "job_id string, at double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows)).sort_values(["ts", "job_id"])
        held = self.open.get() if self.open.exists() else None
        out = []
        for job, at, failed in zip(table["job_id"], table["ts"].map(pd.Timestamp.timestamp), table["failed"], strict=True):
            if held is None or at - held[1] > self.SECONDS:
                out.append((key[0], job, job))
                if not failed:
                    held = (job, at)
            else:
                out.append((key[0], job, held[0]))
        if held is not None:
            self.open.update(Row(job_id=held[0], at=held[1]))
        yield pd.DataFrame(out, columns=["target", "job_id", "answered_by"])

    def close(self) -> None:
        pass


def idempotent_starts(jobs: DataFrame) -> DataFrame:
    """``target, job_id, answered_by`` for a stream of starts (target, job_id, ts, failed)."""
    keyed = event_time(jobs).groupBy("target")
    return keyed.transformWithStateInPandas(
        Starts(), outputStructType="target string, job_id string, answered_by string", outputMode="Append", timeMode="None"
    )


class LastTwo(StatefulProcessor):
    """The verdict of each URL's newest check; a URL is reported when it and the one before are both broken."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "verdict string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows)).sort_values(["ts", "check_id"])
        before = self.last.get()[0] if self.last.exists() else None
        out = []
        for check, verdict in zip(table["check_id"], table["verdict"], strict=True):
            if verdict == "broken" and before == "broken":
                out.append((key[0], int(check)))
            before = verdict
        self.last.update(Row(verdict=before))
        yield pd.DataFrame(out, columns=["url", "check_id"])

    def close(self) -> None:
        pass


def broken_twice(checks: DataFrame) -> DataFrame:
    """``url, check_id`` of every check (url, ts, check_id, verdict) of a stream that is the second broken one in a row.

    Checks of a URL are taken in the order of their time within a batch; later batches come after earlier ones.
    """
    keyed = event_time(checks).groupBy("url")
    return keyed.transformWithStateInPandas(LastTwo(), outputStructType="url string, check_id long", outputMode="Append", timeMode="None")


def window_shares(counts: DataFrame) -> DataFrame:
    """``tumbling_counts`` with each type's ``share`` of its window in percent."""
    total = counts.groupBy("start").agg(F.sum("n").alias("all_n"))
    return counts.join(total, "start").select("start", "event_type", "n", F.round(F.col("n") * 100.0 / F.col("all_n"), 4).alias("share"))


def changed_since(rows: DataFrame, as_of: Any, days: int = 14) -> DataFrame:
    """``newest, changed, stale``: the newest change of a corpus (updated), how many rows changed in ``days`` and whether none did."""
    recent = F.datediff(F.lit(as_of), "updated") <= days
    return rows.agg(F.max("updated").alias("newest"), F.count_if(recent).alias("changed"), (F.count_if(recent) == 0).alias("stale"))

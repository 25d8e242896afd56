"""Keyed state over event streams; the same rules serve batches, as a batch is one micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DAY = 86400


def _accept(times: list[float], last: float | None, window: int) -> tuple[list[bool], float | None]:
    """An event is kept if none was kept within the window before it (strictly)."""
    out = []
    for t in times:
        keep = last is None or t - last >= window
        last = t if keep else last
        out.append(keep)
    return out, last


def dedupe_reports(reports: DataFrame, window: int = DAY, late: str = "1 hour") -> DataFrame:
    """Adds kept: a reporter's reports on a place within a day of a kept one are not kept.

    Reports without a reporter are always kept. Works on a stream (state: the last kept time of each
    pair, dropped once the watermark is a window past it; reports later than ``late`` are dropped) or
    on a batch. Expects id, place_id, reporter, created_at.
    """
    key = F.when(F.col("reporter").isNull(), F.concat(F.lit("-"), F.col("id").cast("string"))).otherwise(F.concat_ws("/", "place_id", "reporter"))
    if reports.isStreaming:
        reports = reports.withWatermark("created_at", late)
    keyed = reports.select("id", "place_id", "created_at", key.alias("key"))
    timeout = GroupStateTimeout.EventTimeTimeout if reports.isStreaming else GroupStateTimeout.NoTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        df = pd.concat(list(frames)).sort_values(["created_at", "id"])
        last = state.get[0] if state.exists else None
        df["kept"], last = _accept([t.timestamp() for t in df["created_at"]], last, window)
        state.update((last,))
        if timeout == GroupStateTimeout.EventTimeTimeout:
            state.setTimeoutTimestamp(max(int((last + window) * 1000), state.getCurrentWatermarkMs() + 1))
        yield df[["id", "place_id", "created_at", "kept"]]

    return keyed.groupBy("key").applyInPandasWithState(run, "id int, place_id int, created_at timestamp, kept boolean", "last double", "append", timeout)


def run_counts(runs: DataFrame, late: str = "1 hour") -> DataFrame:
    """Runs by status in hourly windows of event time; later events than the watermark are dropped."""
    return runs.withWatermark("started_at", late).groupBy(F.window("started_at", "1 hour"), "status").agg(F.count("*").alias("n"))


class FailureLog(StreamingQueryListener):
    """Hands the failures of streams that have ended for good to ``report(name, message)``."""

    def __init__(self, report: Callable[[str, str], None]):
        self.report, self.names = report, {}

    def onQueryStarted(self, event) -> None:
        self.names[event.id] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name = self.names.pop(event.id, str(event.id))
        if event.exception:
            self.report(name, event.exception)


# When jobs are due, in UTC: weekday (0 is Sunday; None: every day), hour. An outside scheduler starts them with ``availableNow``.
TRIGGERS = {"weekly_runs": (0, 3), "weekly_digest": (0, 4), "daily_recheck": (None, 5), "change_notes": (None, 5)}


def due(since: datetime, until: datetime) -> list[tuple[datetime, str]]:
    """(when, job) of all triggers after ``since`` and up to ``until``, in order."""
    out, day = [], since.replace(hour=0, minute=0, second=0, microsecond=0)
    while day <= until:
        for job, (weekday, hour) in TRIGGERS.items():
            at = day + timedelta(hours=hour)
            if since < at <= until and weekday in (None, (day.weekday() + 1) % 7):
                out.append((at, job))
        day += timedelta(days=1)
    return sorted(out)

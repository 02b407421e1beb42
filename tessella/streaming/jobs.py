"""Job states and caches over streams of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella import dims


def fold(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """A row (job_id, status, attempts, rounds, illegal, last) for each job and batch that has new
    events for it.

    ``events``: job_id, ts, event_id, event.  Events of a batch are taken in the order of (ts,
    event_id); later batches go on from the state that is kept.  States of jobs without events for
    ``delay`` of event time are dropped.
    """
    table = {(s, e): n for s, e, n in dims.TRANSITIONS}
    kept_for = int(pd.Timedelta(delay).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, attempts, rounds, illegal, last = state.get if state.exists else ("PLANNED", 0, 0, 0, 0)
        for event, ts in pd.concat(list(batches)).sort_values(["ts", "event_id"])[["event", "ts"]].itertuples(index=False):
            last = max(last, int(ts.timestamp() * 1000))
            after = table.get((status, event))
            if after is None:
                illegal += 1
                continue
            status = after
            if event == "TRANSIENT_ERROR":
                attempts += 1
            elif event == "START_EXECUTION":
                attempts = max(attempts, 1)
            elif event.startswith("REPAIR_REGENERATE"):
                attempts = 0
            rounds += event == "PLAN_REPAIR"
        state.update((status, attempts, rounds, illegal, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1) + kept_for)
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "attempts": [attempts], "rounds": [rounds], "illegal": [illegal], "last": [last]})

    out = "job_id string, status string, attempts int, rounds int, illegal int, last long"
    kept = "status string, attempts int, rounds int, illegal int, last long"
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return marked.groupBy("job_id").applyInPandasWithState(run, out, kept, "update", "EventTimeTimeout")


def cache_misses(requests: DataFrame, key: str, at: str = "ts", delay: str = "1 day") -> DataFrame:
    """The first request of each key within the delay: what a content-addressed cache must make."""
    return requests.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark([key])

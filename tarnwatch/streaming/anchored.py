"""Exact anchored bursts on a stream: state per key, decided as the watermark passes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "done boolean, times array<long>"


def first_burst(times: list[int], within: int, least: int, until: int) -> tuple[int | None, int, list[int]]:
    """Of sorted times, the first with `least` or more from it to `within` later, among those that no event can add to any
    more (time + within < until), with their number; and the times that are still open."""
    end = 0
    for k, t in enumerate(times):
        if t + within >= until:
            return None, 0, times[k:]
        end = max(end, k)
        while end < len(times) and times[end] <= t + within:
            end += 1
        if end - k >= least:
            return t, end - k, []
    return None, 0, []


def anchored_bursts(events: DataFrame, key: str, ts: str, within_minutes: int = 30, least: int = 3, late: str = "2 hours") -> DataFrame:
    """Per key the first event from which `least` or more follow within some minutes, itself included: key, burst_start,
    versions_in_burst. Each key is reported once, when the watermark has passed its burst's end.

    Equal to the batch rule on the same events, in whatever order they arrive within `late`; events later than that are
    dropped. State holds a key's events of the last `within_minutes` before the watermark and after it, or that it is done;
    a timer wakes it for the next one to decide."""
    within = within_minutes * 60_000_000

    def step(of: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, times = state.get if state.exists else (False, [])
        until = state.getCurrentWatermarkMs() * 1000
        fresh = [int(t) for b in batches for t in b["t"]] if not state.hasTimedOut else []
        if done:
            return
        start, n, open_ = first_burst(sorted([*times, *fresh]), within, least, until)
        if start is not None:
            state.update((True, []))
            yield pd.DataFrame({"key": [of[0]], "t": [start], "n": [n]})
        elif open_:
            state.update((False, open_))
            state.setTimeoutTimestamp(max(open_[0] // 1000 + within // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    e = events.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(ts).alias("at"), F.unix_micros(ts).alias("t")).withWatermark("at", late)
    kind = e.schema["key"].dataType.simpleString()
    found = e.groupBy("key").applyInPandasWithState(step, f"key {kind}, t long, n long", STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.col("key").alias(key), F.timestamp_micros("t").alias("burst_start"), F.col("n").alias("versions_in_burst"))

"""Structured Streaming: session leases, newest-wins upserts, and idempotent sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strataq.operators import views

OUTPUT = "user_id long, started long, last_seen long, n long, deadline long"
STATE = "started long, last_seen long, n long"


def lease_sessions(events: DataFrame, lease_us: int, delay: str = "1 hour") -> DataFrame:
    """Sessions of a stream of (user_id, ts): activity extends a lease, a gap of the lease or more ends the session.

    Events are sorted within a batch; a session is sent when a later one starts, or when the
    watermark passes its deadline. Events older than the watermark are dropped by Spark.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (user,) = key
        closed = []
        now = state.get if state.exists else None
        if state.hasTimedOut:
            closed.append((user, *now, now[1] + lease_us))
            state.remove()
        else:
            at = sorted(int(x) for f in frames for x in f["at"])
            for t in at:
                if now is not None and t - now[1] < lease_us:
                    now = (min(now[0], t), max(now[1], t), now[2] + 1)
                else:
                    if now is not None:
                        closed.append((user, *now, now[1] + lease_us))
                    now = (t, t, 1)
            state.update(now)
            state.setTimeoutTimestamp(max((now[1] + lease_us) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(closed, columns=["user_id", "started", "last_seen", "n", "deadline"])

    keyed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).select("user_id", "ts", F.unix_micros("ts").alias("at"))
    return keyed.groupBy("user_id").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def activity(events: DataFrame, window: str, delay: str = "1 hour") -> DataFrame:
    """Events and sums by window and type, with late events up to ``delay``."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def newest_wins_sink(read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], done: Callable[[], int]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that folds changes (key, op, oid, seq) into a table; a batch that was already applied is skipped."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= done():
            return
        write(views.replay(read(), batch), batch_id)

    return apply

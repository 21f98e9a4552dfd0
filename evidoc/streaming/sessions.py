"""Review sessions with a time to live, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evidoc.settings import DEFAULTS


def alive(created_at: Column, now: Column, ttl_seconds: int = DEFAULTS.session_ttl_seconds) -> Column:
    """Whether a session lives: exactly ``ttl_seconds`` old still does."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return micros(now) - micros(created_at) <= ttl_seconds * 1_000_000


def purge(sessions: DataFrame, now: Column, ttl_seconds: int = DEFAULTS.session_ttl_seconds) -> DataFrame:
    return sessions.filter(alive(F.col("created_at"), now, ttl_seconds))


def sessionized(events: DataFrame, gap_seconds: int = DEFAULTS.session_ttl_seconds, late: str = "10 minutes") -> DataFrame:
    """Activity windows of a key that end after ``gap_seconds`` of silence; works on streams, with a
    watermark, and on tables (user_id, ts)."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    own = marked.groupBy("user_id", F.session_window("ts", f"{gap_seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    return own.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_events")


def track(events: DataFrame, ttl_seconds: int = DEFAULTS.session_ttl_seconds, late: str = "10 minutes") -> DataFrame:
    """A stream of session states (session_id, ts): ``created`` at the first event, ``updated`` at
    later ones, ``expired`` once event time passes the time to live after the first."""
    schema = "session_id string, state string, created_at timestamp, n_events long"

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def row(kind: str, created: int, n: int) -> pd.DataFrame:
            return pd.DataFrame({"session_id": [key[0]], "state": [kind], "created_at": [pd.Timestamp(created, unit="us")], "n_events": [n]})

        if state.hasTimedOut:
            created, n = state.get
            state.remove()
            yield row("expired", created, n)
            return
        new = not state.exists
        created, n = (None, 0) if new else state.get
        for part in parts:
            first = int(part["ts"].min().value // 1000)
            created = first if created is None else min(created, first)
            n += len(part)
        state.update((created, n))
        state.setTimeoutTimestamp(max(created // 1000 + ttl_seconds * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield row("created" if new else "updated", created, n)

    return (
        events.withWatermark("ts", late)
        .groupBy("session_id")
        .applyInPandasWithState(step, schema, "created_us long, n_events long", "append", GroupStateTimeout.EventTimeTimeout)
    )

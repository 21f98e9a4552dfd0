"""Live sessions as keyed state that Spark itself lets lapse: a value state with a time to live."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from evidoc.settings import DEFAULTS

#: The store of states that state variables and times to live need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Whether batches without data run, as lapsing states make Spark do without end; off, a stream of what is
#: there already ends by itself.
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
SCHEMA = "session_id string, state string, created_at timestamp, n_events long"


class Sessions(StatefulProcessor):
    """``created`` for a session's first rows and ``updated`` for later ones. A session lives for its time
    after it was created, by the clock, whatever comes meanwhile; later rows create it anew."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Written once, at creation, so that later rows do not prolong it.
        self.created = handle.getValueState("created", "created_us long", ttlDurationMs=self.ttl_ms)
        self.count = handle.getValueState("count", "n long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first, n = None, 0
        for part in rows:  # a session's rows come in parts
            low = int(part["ts"].min().value // 1000)
            first, n = low if first is None else min(first, low), n + len(part)
        # Each call asks Spark for the state anew, so none asks first whether there is one.
        created = self.created.get()
        new = created is None
        if new:
            self.created.update((first,))
        else:
            first = created[0]
            n += (self.count.get() or (0,))[0]
        self.count.update((n,))
        yield pd.DataFrame({"session_id": [key[0]], "state": ["created" if new else "updated"], "created_at": [pd.Timestamp(first, unit="us")], "n_events": [n]})

    def close(self) -> None:
        pass


def live(events: DataFrame, ttl_seconds: float = DEFAULTS.session_ttl_seconds) -> DataFrame:
    """A stream of session states from a stream (session_id, ts), one row a session and micro-batch."""
    spark = events.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return events.select("session_id", "ts").groupBy("session_id").transformWithStateInPandas(Sessions(int(ttl_seconds * 1000)), SCHEMA, "Update", "processingTime")

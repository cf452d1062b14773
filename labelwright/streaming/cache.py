"""A cache with a time to live as keyed streaming state.

Every row of the stream asks for a key at a time, and brings what a fetch would give then (null: the fetch fails). An entry
at most ``ttl_days`` old, in calendar days, is served as it is and the fetch not looked at. Else the fetch is served and
becomes the entry; if it failed, the old entry is served, marked stale; without one the row is marked missing. An entry is
forgotten ``keep_days`` after its fetch, by an event-time timer, so that state is bounded by the keys of that span; a row
later than that finds none even before the timer fires.

Rows of a key are taken in order of time within a micro-batch, ties by value with failures last; a row that comes in a later
micro-batch than a newer one finds the newer entry fresh. So the result does not depend on how rows fall into micro-batches
as long as these come in order. Rows of one key and micro-batch are held in memory; ``maxFilesPerTrigger`` bounds them. A row
without a time, or later than ``late``, is dropped; a null key is a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State stores that keep timers and expiring values.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_DAY_MS = 86_400_000


class TtlCache(StatefulProcessor):
    def __init__(self, key: str, ttl_days: int, keep_days: int):
        self.key, self.ttl, self.keep = key, ttl_days, keep_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "fetched_ms long, value string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows), ignore_index=True)
        given["ms"] = given["ts"].astype("datetime64[ms]").astype("int64")
        given = given.sort_values(["ms", "fetched"], na_position="last", kind="stable")
        entry = self.entry.get() if self.entry.exists() else None
        before, out = entry, []
        for ms, fetched in zip(given["ms"].tolist(), given["fetched"].tolist()):
            age = None if entry is None else ms // _DAY_MS - entry[0] // _DAY_MS
            if age is not None and age > self.keep:
                entry, age = None, None
            if age is not None and age <= self.ttl:
                state, value = "fresh", entry[1]
            elif fetched is not None and fetched == fetched:
                entry = (ms, fetched)
                state, value = "fetched", fetched
            elif entry is not None:
                state, value = "stale_cache_served", entry[1]
            else:
                state, value = "missing", None
            out.append((key[0], datetime.fromtimestamp(ms / 1000, timezone.utc).replace(tzinfo=None), state, value))
        if entry != before and entry is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.entry.update(entry)
            self.handle.registerTimer((entry[0] // _DAY_MS + self.keep + 1) * _DAY_MS)
        yield pd.DataFrame(out, columns=[self.key, "ts", "state", "value"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.entry.clear()
        yield pd.DataFrame(columns=[self.key, "ts", "state", "value"])

    def close(self) -> None:
        pass


def ttl_cache(requests: DataFrame, ttl_days: int = 7, keep_days: int = 90, late: str = "1 hour") -> DataFrame:
    """key, ts, state, value of every row of the stream requests (key, ts, fetched), as the cache answers it.

    Times are kept to the millisecond. The session needs PROVIDER as its state store.
    """
    kind = requests.schema["key"].dataType.simpleString()
    rows = requests.select("key", F.col("ts").cast("timestamp").alias("ts"), F.col("fetched").cast("string").alias("fetched")).where("ts is not null").withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(TtlCache("key", ttl_days, keep_days), f"key {kind}, ts timestamp, state string, value string", "Append", "EventTime")

"""Keyed streams with processing-time timers: a feed with tombstones and keepalives, and retries that come back by themselves.

State is one small record a key, kept by Spark's state store; a timer wakes a key that gets no rows. The session needs
the RocksDB state store, see ``use_store``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Milliseconds after which a key that stays away is gone, and after which a silent one says that it is still there.
GONE_MS, KEEPALIVE_MS = 60_000, 15_000
#: Retries double their wait, to a minute at most, and end after so many.
FIRST_WAIT_MS, LONGEST_WAIT_MS, ATTEMPTS = 2000, 60_000, 5


def use_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class _Timed(StatefulProcessor):
    """A processor with one record a key and one timer, always that of the next thing due."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", self.fields)

    def _wake(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


class Feed(_Timed):
    """new, changed, keepalive and deleted of one key. The record: last value, when it was seen, when anything was sent."""

    fields = "value string, seen long, sent long"

    def __init__(self, gone_ms: int, keepalive_ms: int):
        self.gone_ms, self.keepalive_ms = gone_ms, keepalive_ms

    def _next(self, value, seen: int, sent: int) -> None:
        self.record.update((value, seen, sent))
        self._wake(min(seen + self.gone_ms, sent + self.keepalive_ms))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        known = self.record.exists()
        value, _, sent = self.record.get() if known else (None, now, now)
        out = []
        given = sorted(((s, v) for x in rows for s, v in zip(x["seq"], x["value"], strict=True)), key=lambda p: p[0])
        for _, v in given:
            v = None if pd.isna(v) else v
            if not known or v != value:
                out.append((key[0], v, "changed" if known else "new"))
                known, value, sent = True, v, now
        self._next(value, now, sent)
        yield pd.DataFrame(out, columns=["key", "value", "change"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        value, seen, sent = self.record.get()
        if now - seen >= self.gone_ms:
            self.record.clear()
            yield pd.DataFrame([(key[0], value, "deleted")], columns=["key", "value", "change"])
        else:
            quiet = now - sent >= self.keepalive_ms
            self._next(value, seen, now if quiet else sent)
            yield pd.DataFrame([(key[0], value, "keepalive")] if quiet else [], columns=["key", "value", "change"])


class Retry(_Timed):
    """When a failed key is to be tried again. The record: attempts so far; a key that succeeds is forgotten."""

    fields = "attempts int"

    def __init__(self, first_ms: int, longest_ms: int, attempts: int):
        self.first_ms, self.longest_ms, self.attempts = first_ms, longest_ms, attempts

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        out = []
        for _, event in sorted(((s, e) for x in rows for s, e in zip(x["seq"], x["event"], strict=True)), key=lambda p: p[0]):
            tried = self.record.get()[0] if self.record.exists() else 0
            if event == "failed" and tried < self.attempts:
                self.record.update((tried + 1,))
                self._wake(now + min(self.longest_ms, self.first_ms << tried))
            elif event in ("failed", "done"):
                self.record.clear()
                for old in list(self.handle.listTimers()):
                    self.handle.deleteTimer(old)
                out.append((key[0], tried, "given up" if event == "failed" else "done"))
        yield pd.DataFrame(out, columns=["key", "attempt", "what"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([(key[0], self.record.get()[0], "retry")], columns=["key", "attempt", "what"])


def feed(rows: DataFrame, gone_ms: int = GONE_MS, keepalive_ms: int = KEEPALIVE_MS) -> DataFrame:
    """(key, value, change) of a stream of snapshots (key, seq, value): new and changed as they come, deleted when a key has
    not been seen for ``gone_ms``, keepalive when nothing was sent for ``keepalive_ms``. A key that returns is new."""
    slim = rows.select(F.col("key").cast("string").alias("key"), "seq", "value")
    return slim.groupBy("key").transformWithStateInPandas(Feed(gone_ms, keepalive_ms), "key string, value string, change string", "append", "processingTime")


def retries(rows: DataFrame, first_ms: int = FIRST_WAIT_MS, longest_ms: int = LONGEST_WAIT_MS, attempts: int = ATTEMPTS) -> DataFrame:
    """(key, attempt, what) of a stream (key, seq, event): retry when a failed key's wait is over, done, or given up after ``attempts``."""
    slim = rows.select(F.col("key").cast("string").alias("key"), "seq", "event")
    return slim.groupBy("key").transformWithStateInPandas(Retry(first_ms, longest_ms, attempts), "key string, attempt int, what string", "append", "processingTime")

"""Structured Streaming: a keyed change feed, deduplication and session windows over an append stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def change_feed(rows: DataFrame, key: str = "user_id", value: str = "event_type") -> DataFrame:
    """(key, value, change) each time a key's value is new or differs from the last one seen, by keyed state.

    ``rows`` is a stream with key, value and ``seq``, the order inside a key. Null values are as none.
    """

    def step(keys: tuple, batches, state):
        last = state.get[0] if state.exists else None
        rows = sorted(((s, None if pd.isna(v) else v) for b in batches for s, v in zip(b["seq"], b["value"], strict=True)), key=lambda p: p[0])
        out = []
        for _, v in rows:
            if v != last:
                out.append((keys[0], v, "new" if last is None else "changed"))
                last = v
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["key", "value", "change"])

    slim = rows.select(F.col(key).cast("long").alias("key"), F.col(value).alias("value"), "seq")
    return slim.groupBy("key").applyInPandasWithState(step, "key long, value string, change string", "last string", "append", "NoTimeout")


def deduplicated(rows: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def sessions(rows: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each key: start, end and number of rows, a gap of ``gap`` ending one."""
    s = rows.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def folded(rows: DataFrame, key: str = "id") -> DataFrame:
    """The last state of every key of a feed of (key, seq, op, value): op patch keeps the last value given, delete takes the key out.

    A streaming aggregate for complete or update mode; the greatest seq counts, whatever the order of arrival.
    """
    last = F.max_by(F.struct("op", "value"), "seq").alias("last")
    return rows.groupBy(key).agg(last, F.max("seq").alias("seq")).filter("last.op <> 'delete'").select(key, F.col("last.value").alias("value"), "seq")


def tombstones(rows: DataFrame, key: str = "user_id", value: str = "event_type", gone: str = "deleted") -> DataFrame:
    """``change_feed`` in which a row with the value ``gone`` is a deletion."""
    feed = change_feed(rows, key, value)
    return feed.withColumn("change", F.when(F.col("value") == gone, "deleted").otherwise(F.col("change")))


def stage_machine(events: DataFrame) -> DataFrame:
    """The transitions of stages (key, seq, event) that are allowed: start, done, pause, fail, resume, reset; others change nothing.

    pending starts running; running ends done, paused or failed; paused and failed resume; anything is reset to pending.
    """
    step = {("pending", "start"): "running", ("running", "done"): "done", ("running", "pause"): "paused", ("running", "fail"): "failed", ("paused", "resume"): "running", ("failed", "resume"): "running"}

    def run(keys: tuple, batches, state):
        now = state.get[0] if state.exists else "pending"
        out = []
        for _, event in sorted((s, e) for b in batches for s, e in zip(b["seq"], b["event"], strict=True)):
            new = "pending" if event == "reset" else step.get((now, event))
            if new is not None and new != now:
                out.append((keys[0], now, new))
                now = new
        state.update((now,))
        yield pd.DataFrame(out, columns=["key", "was", "now"])

    return events.select("key", "seq", "event").groupBy("key").applyInPandasWithState(run, "key string, was string, now string", "now string", "append", "NoTimeout")


def throttled(rows: DataFrame, least_s: float = 0.5, least_step: float = 0.001) -> DataFrame:
    """Of (key, at_s, value) only rows that come ``least_s`` after the last one let through and differ from it by ``least_step``; the end (1.0) always."""

    def run(keys: tuple, batches, state):
        last = state.get if state.exists else None
        out = []
        for at, v in sorted((a, v) for b in batches for a, v in zip(b["at_s"], b["value"], strict=True)):
            if last is None or v >= 1.0 > last[1] or (at - last[0] >= least_s and abs(v - last[1]) >= least_step):
                out.append((keys[0], at, v))
                last = (at, v)
        if last is not None:
            state.update(last)
        yield pd.DataFrame(out, columns=["key", "at_s", "value"])

    return rows.select("key", "at_s", "value").groupBy("key").applyInPandasWithState(run, "key string, at_s double, value double", "at_s double, value double", "append", "NoTimeout")


def heartbeat(rows: DataFrame) -> DataFrame:
    """One row: the last worker and time heard of (update or complete mode)."""
    return rows.agg(F.max_by("worker", "at").alias("worker"), F.max("at").alias("at"))


def limited(hits: DataFrame, window_s: int = 600, most: int = 10) -> DataFrame:
    """Hits (key, hit_id, at) with ``allowed``, as the batch operator has it, over a stream: allowed hits of the window are the state."""

    def run(keys: tuple, batches, state):
        kept = list(state.get[0]) if state.exists else []
        out = []
        for at, hit in sorted((a, h) for b in batches for a, h in zip(b["at"], b["hit_id"], strict=True)):
            kept = [k for k in kept if k > at - window_s]
            ok = len(kept) < most
            if ok:
                kept.append(float(at))
            out.append((keys[0], hit, ok))
        state.update((kept,))
        yield pd.DataFrame(out, columns=["key", "hit_id", "allowed"])

    return hits.select("key", "hit_id", "at").groupBy("key").applyInPandasWithState(run, "key long, hit_id long, allowed boolean", "kept array<double>", "append", "NoTimeout")


def uncached(rows: DataFrame, cache: DataFrame, content: list[str]) -> DataFrame:
    """Rows with content_key, the first 32 hex digits of a SHA-256 over ``content``, that has no result in ``cache`` yet, each key once."""
    key = F.substring(F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256), 1, 32)
    return rows.withColumn("content_key", key).dropDuplicates(["content_key"]).join(cache.select("content_key"), "content_key", "left_anti")

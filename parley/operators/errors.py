"""Diarization error: missed, false and confused speech between a reference and a hypothesis, after the best 1:1 naming."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assignment(gain: np.ndarray) -> np.ndarray:
    """For each row of a matrix of gains a column of its own, -1 for none, with the largest sum of gains.

    Rows are added one by one. A row's cheapest alternating path to a free column is grown as shortest paths are, with
    prices on rows and columns that keep all reduced costs at 0 or more; so n rows take about n^3 steps. Gains of 0
    or less are never taken.
    """
    rows, columns = gain.shape
    size = max(rows, columns)
    cost = np.zeros((size, size))
    cost[:rows, :columns] = -np.maximum(gain, 0)
    row_price, column_price = np.zeros(size), np.zeros(size)
    owner = np.full(size, -1)
    for row in range(size):
        distance, came_from, done = np.full(size, np.inf), np.full(size, -1), np.zeros(size, bool)
        at, reached, last = row, 0.0, -1
        while True:
            through = reached + cost[at] - row_price[at] - column_price
            better = ~done & (through < distance)
            distance[better], came_from[better] = through[better], last
            last = int(np.argmin(np.where(done, np.inf, distance)))
            reached, done[last] = distance[last], True
            if owner[last] < 0:
                break
            at = owner[last]
        row_price[row] += reached
        settled = np.flatnonzero(done & (owner >= 0))
        row_price[owner[settled]] += reached - distance[settled]
        column_price[done] += distance[done] - reached
        while last >= 0:  # hand the columns on along the path
            before = came_from[last]
            owner[last] = row if before < 0 else owner[before]
            last = before
    found = np.full(rows, -1)
    for column in range(columns):
        if owner[column] < rows and gain[owner[column], column] > 0:
            found[owner[column]] = column
    return found


def best_naming(joint: dict[tuple[str, str], int]) -> dict[str, str]:
    """Reference speaker to hypothesis speaker, each at most once, with the most common frames."""
    refs, hyps = list(dict.fromkeys(r for r, _ in joint)), list(dict.fromkeys(h for _, h in joint))
    gain = np.array([[joint.get((r, h), 0) for h in hyps] for r in refs], dtype=float).reshape(len(refs), len(hyps))
    return {refs[i]: hyps[j] for i, j in enumerate(assignment(gain).tolist()) if j >= 0}


def der(reference: DataFrame, hypothesis: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """Per meeting frames of reference speech, missed, false alarms and confused. Both: meeting_id, speaker, frame.

    ``skip`` (meeting_id, frame) takes frames out, as a collar around the reference's boundaries does. Frames are
    joined and counted by Spark; only the table of speaker pairs of a meeting goes to one task, where they are named.
    """
    if skip is not None:
        reference, hypothesis = (x.join(skip, ["meeting_id", "frame"], "left_anti") for x in (reference, hypothesis))
    r, h = reference.withColumnRenamed("speaker", "r"), hypothesis.withColumnRenamed("speaker", "h")
    joint = r.join(h, ["meeting_id", "frame"]).groupBy("meeting_id", "r", "h").agg(F.count(F.lit(1)).alias("n"))

    def named(x: pa.Table) -> pa.Table:
        table = {(a, b): n for a, b, n in zip(*(x.column(c).to_pylist() for c in ("r", "h", "n")), strict=True)}
        correct = sum(table[p] for p in best_naming(table).items())
        return pa.table({"meeting_id": x.column("meeting_id").slice(0, 1), "correct": pa.array([correct], pa.int64())})

    kind = joint.select("meeting_id", F.lit(0).cast("long").alias("correct")).schema
    correct = joint.groupBy("meeting_id").applyInArrow(named, kind)
    n = lambda df, name: df.groupBy("meeting_id", "frame").agg(F.count(F.lit(1)).alias(name))
    frames = n(reference, "n_ref").join(n(hypothesis, "n_hyp"), ["meeting_id", "frame"], "full").fillna(0, ["n_ref", "n_hyp"])
    zero = F.lit(0)
    sums = frames.groupBy("meeting_id").agg(
        F.sum("n_ref").alias("total"), F.sum(F.greatest(zero, F.col("n_ref") - F.col("n_hyp"))).alias("missed"),
        F.sum(F.greatest(zero, F.col("n_hyp") - F.col("n_ref"))).alias("false_alarm"), F.sum(F.least("n_ref", "n_hyp")).alias("both"),
    )
    return sums.join(correct, "meeting_id", "left").select("meeting_id", "total", "missed", "false_alarm", (F.col("both") - F.coalesce("correct", F.lit(0))).alias("confused"))


def collar(turns: DataFrame, frame_ms: int, collar_ms: int) -> DataFrame:
    """(meeting_id, frame) within ``collar_ms`` of a boundary of the reference's turns."""
    edge = turns.select("meeting_id", F.explode(F.array("start_ms", "end_ms")).alias("t"))
    a, z = (F.rint((F.col("t") + d) / float(frame_ms)).cast("long") for d in (-collar_ms, collar_ms))
    some = edge.withColumns({"a": a, "z": z}).filter("z > a")
    return some.select("meeting_id", F.explode(F.sequence(F.col("a"), F.col("z") - 1)).alias("frame")).distinct()

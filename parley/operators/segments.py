"""Segments for transcription: a speaker's neighbouring turns, with micro segments absorbed, long ones cut, and padded.

Times are integer milliseconds. Everything is windows, joins and column expressions, and one fold:

* Absorbing depends on an order, as hosts grow by what they absorb, but nothing reaches further than ``near_ms``. So it is
  a fold along sorted partitions that holds what is near in time: hosts that have not ended, by speaker and start.
* Cutting the widest gap again and again needs no recursion. A gap is cut exactly if the nearest wider gaps on its two
  sides (of equals the earlier is the wider) are more than ``most_ms`` apart, and those can be looked for in a range of
  that width. What has no gap left is cut into equal parts, as many as halving makes.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.intervals import range_join
from parley.plans.folds import folded
from parley.plans.shared import materialize

ORDER = ["start_ms", "end_ms", "turn_id"]
_BEFORE = (Window.unboundedPreceding, -1)


def clamped(turns: DataFrame, ends: DataFrame | None) -> DataFrame:
    """Turns (meeting_id, speaker, start_ms, end_ms, turn_id, overlap) inside their recording, with its length ``until`` where it is known."""
    overlap = F.coalesce("overlap", F.lit(False)) if "overlap" in turns.columns else F.lit(False)
    rows = turns.select("meeting_id", "speaker", "start_ms", "end_ms", "turn_id", overlap.alias("overlap"))
    if ends is None:
        return rows.withColumn("until", F.lit(None).cast("long"))
    known = ends.groupBy("meeting_id").agg(F.max(F.when(F.col("end_ms") > 0, F.col("end_ms"))).alias("until"))
    rows = rows.join(known, "meeting_id", "left")
    inside = lambda c: F.when(F.col("until").isNull(), F.col(c)).otherwise(F.greatest(F.lit(0), F.least(F.col(c), F.col("until"))))
    return rows.withColumns({"start_ms": inside("start_ms"), "end_ms": inside("end_ms")})


def numbered(rows: DataFrame, order: list[str], gap_ms: int, out: str, apart: Column | None = None) -> DataFrame:
    """``rows`` with the number ``out`` of their run of one speaker: a new one begins where another speaks, behind a gap of more
    than ``gap_ms``, or where ``apart`` holds."""
    time = Window.partitionBy("meeting_id").orderBy(*order)
    rows = rows.withColumn("__other", ~F.col("speaker").eqNullSafe(F.lag("speaker").over(time)) | (F.row_number().over(time) == 1))
    rows = rows.withColumn("__run", F.sum(F.col("__other").cast("int")).over(time))
    reach = F.max("end_ms").over(Window.partitionBy("meeting_id", "__run").orderBy(*order).rowsBetween(*_BEFORE))
    begins = F.col("__other") | (F.col("start_ms") - reach > gap_ms)
    begins = begins if apart is None else begins | apart
    rows = rows.withColumn("__begins", F.coalesce(begins, F.lit(True)).cast("long"))
    return rows.withColumn(out, F.sum("__begins").over(time)).drop("__other", "__run", "__begins")


def _spans(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy("meeting_id", *keys).agg(F.first("speaker").alias("speaker"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.bool_or("overlap").alias("overlap"))


class _Absorbed:
    """The fold of a meeting's islands by start: hosts of each speaker by bounds that grow, micros that wait until all hosts near them are known."""

    def __init__(self, micro_ms: int, near_ms: int):
        self.micro_ms, self.near_ms = micro_ms, near_ms
        self.hosts: dict[str | None, list[tuple]] = {}  # (start, island, end), sorted
        self.waiting: deque[dict] = deque()
        self.looked = self.held = 0

    def step(self, r: dict) -> list[tuple]:
        found = self.settled(r["start_ms"])
        if r["end_ms"] - r["start_ms"] < self.micro_ms:
            self.waiting.append(r)
        else:
            self.hosts.setdefault(r["speaker"], []).append((r["start_ms"], r["island"], r["end_ms"]))
            self.held += 1
        return found

    def settled(self, until: int | None = None) -> list[tuple]:
        """(meeting_id, island, owner, own) of the waiting micros that no island from ``until`` on can reach."""
        found = []
        while self.waiting and (until is None or self.waiting[0]["end_ms"] + self.near_ms < until):
            m = self.waiting.popleft()
            speaker, host = self.pick(m)
            if host:
                grown = (min(host[0], m["start_ms"]), host[1], max(host[2], m["end_ms"]))
                held = self.hosts[speaker]
                held.pop(bisect_left(held, host))
                insort(held, grown)
                found.append((m["meeting_id"], m["island"], host[1], speaker == m["speaker"]))
            if self.looked > 2 * self.held + 1000:
                self.forget(m["start_ms"] - self.near_ms)
        return found

    def pick(self, m: dict) -> tuple:
        a, z, own = m["start_ms"], m["end_ms"], m["speaker"]
        best, whose = None, None
        for speaker, held in self.hosts.items():
            if speaker == own:
                continue
            for h in held:  # by start, so the first that contains it is the speaker's best
                self.looked += 1
                if h[0] > a or (best and h > best):
                    break
                if h[2] >= z:
                    best, whose = h, speaker
                    break
        if best:
            return whose, best
        least = None
        for speaker, held in self.hosts.items():
            for h in held:
                self.looked += 1
                if h[0] > z + self.near_ms:
                    break
                gap = max(0, max(h[0], a) - min(h[2], z))
                if gap <= self.near_ms:
                    key = (1, h[1]) if speaker == own else (0, gap, h[0] > a, h[0], h[1])
                    if least is None or key < least:
                        least, best, whose = key, h, speaker
        return whose, best

    def forget(self, before: int) -> None:
        """Hosts that ended before are out of the reach of all micros to come."""
        kept = {s: [h for h in held if h[2] >= before] for s, held in self.hosts.items()}
        self.hosts = {s: held for s, held in kept.items() if held}
        self.held, self.looked = sum(map(len, self.hosts.values())), 0


def hosts(islands: DataFrame, micro_ms: int = 1200, near_ms: int = 1000) -> DataFrame:
    """``islands`` (meeting_id, island, speaker, start_ms, end_ms, ...) with ``owner``, the island that each becomes part of,
    and ``own``: whether as its speech (else as an interjection). Islands are numbered by their starts.

    A segment under ``micro_ms`` goes to a host that is ``near_ms`` away at most: first to one of another speaker, which
    contains it before others, then the nearest, then one that began no later, then the earliest; else to the first host
    of its own speaker; else it stays. If all segments of a meeting are micro, all stay.
    """
    rows = islands.select("meeting_id", "island", "speaker", "start_ms", "end_ms")
    schema = rows.select("meeting_id", "island", F.col("island").alias("owner"), F.lit(True).alias("own")).schema
    start = lambda: _Absorbed(micro_ms, near_ms)
    gone = folded(rows, ["meeting_id"], ["island"], start, _Absorbed.step, schema, _Absorbed.settled)
    return islands.join(gone, ["meeting_id", "island"], "left").withColumns({"owner": F.coalesce("owner", "island"), "own": F.coalesce("own", F.lit(True))})


def cuts(segments: DataFrame, turns: DataFrame, most_ms: int = 600_000) -> DataFrame:
    """Pieces (meeting_id, segment, start_ms, end_ms, cut_start, cut_end) of ``most_ms`` or less.

    segments: meeting_id, segment, start_ms, end_ms; turns: own speech of the segments. Twice the times are compared,
    so the middle of a gap is exact.
    """
    key = ["meeting_id", "segment"]
    long_ = segments.filter(F.col("end_ms") - F.col("start_ms") > most_ms).select(*key, F.col("start_ms").alias("a"), F.col("end_ms").alias("z"))
    own = turns.join(long_, key)
    order = Window.partitionBy(*key).orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(order.rowsBetween(*_BEFORE))
    gaps = own.select(*key, "a", "z", (F.col("start_ms") + reach).alias("c"), (F.col("start_ms") - reach).alias("w")).filter("w > 0")
    near = Window.partitionBy(*key).orderBy("c")
    one = F.struct("c", "w")
    gaps = gaps.withColumn("__left", F.collect_list(one).over(near.rangeBetween(-2 * most_ms, -1))).withColumn("__right", F.collect_list(one).over(near.rangeBetween(1, 2 * most_ms)))
    wider = lambda side, more: F.transform(F.filter(side, more), lambda x: x["c"])
    left = F.array_max(wider("__left", lambda x: x["w"] >= F.col("w")))
    right = F.array_min(wider("__right", lambda x: x["w"] > F.col("w")))
    # Without a wider gap in reach the side goes on to the segment's end, or to a gap that is too far to matter.
    left = F.coalesce(left, F.greatest(2 * F.col("a"), F.col("c") - 2 * most_ms - 1))
    right = F.coalesce(right, F.least(2 * F.col("z"), F.col("c") + 2 * most_ms + 1))
    used = gaps.filter(right - left > 2 * most_ms).select(*key, F.col("c").alias("at"))
    edges = used.union(segments.select(*key, (2 * F.col("end_ms")).alias("at"))).join(segments.select(*key, F.col("start_ms").alias("a"), F.col("end_ms").alias("z")), key)
    edges = edges.withColumn("from", F.coalesce(F.lag("at").over(Window.partitionBy(*key).orderBy("at")), 2 * F.col("a")))
    # Halves of halves: the least power of two that brings the parts under the limit.
    wide = (F.col("at") - F.col("from")) / F.lit(2.0 * most_ms)
    parts = F.when(wide > 1, F.pow(2.0, F.ceil(F.log2(wide)))).otherwise(1.0).cast("long")
    parts = edges.select(*key, "a", "z", F.expr("from div 2").alias("from"), F.expr("at div 2").alias("at"), parts.alias("n"))
    parts = parts.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    bound = lambda i: F.expr(f"(from * (n - ({i})) + at * ({i})) div n")
    pieces = parts.select(*key, "a", "z", bound("i").alias("start_ms"), bound("i + 1").alias("end_ms"))
    return pieces.select(*key, "start_ms", "end_ms", (F.col("start_ms") > F.col("a")).alias("cut_start"), (F.col("end_ms") < F.col("z")).alias("cut_end"))


def build_segments(turns: DataFrame, ends: DataFrame | None = None, micro_ms: int = 1200, most_ms: int = 600_000, pad_ms: int = 250, gap_ms: int = 30_000, near_ms: int = 1000) -> DataFrame:
    """Segments of every meeting, numbered by ``idx`` from 0: turns clamped, merged, absorbed, merged again, cut and padded.

    turns: meeting_id, speaker, start_ms, end_ms, turn_id, and overlap if it is known; ``ends`` (meeting_id, end_ms) the
    recordings' lengths, where a null or 0 is unknown. speech_start_ms and speech_end_ms are without pads, which never
    stand at an inner cut nor beyond zero and the end. ``turns`` are the own turns in a piece, straddling ones cut,
    ``interjections`` what began in it. overlap: of any turn that went into the segment. Null speakers are one speaker;
    empty turns are left out; a meeting without others has no segment.
    """
    rows = clamped(turns, ends).filter("end_ms > start_ms")
    # What is read several times below is written once, and the fold runs once.
    rows = materialize(numbered(rows, ORDER, gap_ms, "island"))
    islands = materialize(hosts(_spans(rows, "island"), micro_ms, near_ms))
    all_micro = islands.groupBy("meeting_id").agg((F.max(F.col("end_ms") - F.col("start_ms")) < micro_ms).alias("all_micro"))
    owners = _spans(islands.withColumn("speaker", F.when(F.col("island") == F.col("owner"), F.col("speaker"))).withColumn("__named", F.col("island") == F.col("owner")), "owner").drop("speaker")
    named = islands.filter("island = owner").select("meeting_id", "owner", "speaker")
    merged = materialize(numbered(owners.join(named, ["meeting_id", "owner"]).join(all_micro, "meeting_id"), ["start_ms", "end_ms", "owner"], gap_ms, "segment", F.col("all_micro")))
    to = islands.select("meeting_id", "island", "owner", "own").join(merged.select("meeting_id", "owner", "segment"), ["meeting_id", "owner"])
    segments = _spans(merged, "segment")
    spoken = rows.join(to.filter("own"), ["meeting_id", "island"]).select("meeting_id", "segment", "start_ms", "end_ms")
    pieces = materialize(cuts(segments, spoken, most_ms))
    # Pieces of a segment meet its turns and interjections by time, not all by all.
    name = F.to_json(F.struct("meeting_id", "segment"))
    keyed = lambda df: df.withColumn("__m", F.col("meeting_id")).withColumn("meeting_id", name)
    piece = keyed(pieces.select("meeting_id", "segment", "start_ms", "end_ms"))
    own = range_join(keyed(spoken), piece)
    own = own.select("r.*", F.struct(F.greatest("l.start_ms", "r.start_ms").alias("start_ms"), F.least("l.end_ms", "r.end_ms").alias("end_ms")).alias("turn")).groupBy("__m", "segment", "start_ms").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    said = islands.select("meeting_id", "island", "speaker", "start_ms", "end_ms").join(to.filter("NOT own"), ["meeting_id", "island"])
    said = said.select("meeting_id", "segment", "start_ms", (F.col("start_ms") + 1).alias("end_ms"), F.struct("start_ms", "end_ms", "speaker").alias("said"))
    said = range_join(keyed(said), piece).select("r.*", "l.said").groupBy("__m", "segment", "start_ms").agg(F.sort_array(F.collect_list("said")).alias("interjections"))
    back = lambda df: df.withColumnRenamed("__m", "meeting_id")
    out = pieces.join(segments.select("meeting_id", "segment", "speaker", "overlap"), ["meeting_id", "segment"])
    out = out.join(back(own), ["meeting_id", "segment", "start_ms"], "left").join(back(said), ["meeting_id", "segment", "start_ms"], "left")
    out = out.join(rows.groupBy("meeting_id").agg(F.max("until").alias("until")), "meeting_id")
    start = F.when(F.col("cut_start"), F.col("start_ms")).otherwise(F.greatest(F.lit(0), F.col("start_ms") - pad_ms))
    end = F.when(F.col("cut_end"), F.col("end_ms")).otherwise(F.col("end_ms") + pad_ms)
    idx = F.row_number().over(Window.partitionBy("meeting_id").orderBy("segment", "start_ms")) - 1
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return out.select(
        "meeting_id", idx.cast("long").alias("idx"), "speaker", start.alias("start_ms"), F.least(end, "until").alias("end_ms"),
        F.col("start_ms").alias("speech_start_ms"), F.col("end_ms").alias("speech_end_ms"), "cut_start", "cut_end", "overlap",
        none("turns", "array<struct<start_ms:bigint,end_ms:bigint>>"), none("interjections", "array<struct<start_ms:bigint,end_ms:bigint,speaker:string>>"),
    )

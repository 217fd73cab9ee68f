"""What lies around a time: spans, chapters, context lines, previews; and recordings put one behind another."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.plans.folds import folded


def _dealt(df: DataFrame, lo: Column, hi: Column, bucket_ms: int) -> DataFrame:
    cell = lambda c: F.floor(c / bucket_ms).cast("long")
    return df.withColumn("__cell", F.explode(F.sequence(cell(lo), cell(hi))))


def point_in_span(points: DataFrame, spans: DataFrame, bucket_ms: int = 60_000) -> DataFrame:
    """Every point (meeting_id, point_id, t) with the start of the half-open span that holds it, or null.

    Spans are dealt to the buckets of time that they touch and points to their own, so a point meets the spans of its
    bucket alone. Where spans overlap, the one that starts first counts.
    """
    held = _dealt(spans.filter("end_ms > start_ms"), F.col("start_ms"), F.col("end_ms") - 1, bucket_ms).select("meeting_id", "__cell", "start_ms", "end_ms")
    asked = points.withColumn("__cell", F.floor(F.col("t") / bucket_ms).cast("long")).alias("p")
    at = (F.col("p.meeting_id") == F.col("s.meeting_id")) & (F.col("p.__cell") == F.col("s.__cell")) & (F.col("t") >= F.col("start_ms")) & (F.col("t") < F.col("end_ms"))
    found = asked.join(held.alias("s"), at, "left")
    return found.groupBy("p.meeting_id", "point_id", "t").agg(F.min("start_ms").alias("span_ms"))


def sections(windows: DataFrame) -> DataFrame:
    """Bounds of a meeting's windows (meeting_id, window, start_ms, end_ms): each reaches to the start of the next, the last to the latest end."""
    by = windows.groupBy("meeting_id", "window").agg(F.min("start_ms").alias("lo"), F.max("end_ms").alias("end"))
    order = Window.partitionBy("meeting_id").orderBy("window")
    last = F.max("end").over(Window.partitionBy("meeting_id"))
    return by.select("meeting_id", "window", "lo", F.coalesce(F.lead("lo").over(order), last).alias("hi"))


def chapter_asof(points: DataFrame, chapters: DataFrame) -> DataFrame:
    """Of every point the chapter that began last by then (idx from 0, -1 before the first) and how far it is through, 0 to 1000.

    points: meeting_id, point_id, t; chapters: meeting_id, idx, start_ms, end_ms. One sorted pass over the union.
    """
    none = F.lit(None)
    rows = points.select("meeting_id", "t", "point_id", none.cast("struct<idx:bigint,a:bigint,z:bigint>").alias("c")).unionByName(
        chapters.select("meeting_id", F.col("start_ms").alias("t"), none.cast("long").alias("point_id"), F.struct(F.col("idx").cast("long").alias("idx"), F.col("start_ms").cast("long").alias("a"), F.col("end_ms").cast("long").alias("z")).alias("c"))
    )
    down = Window.partitionBy("meeting_id").orderBy("t", F.col("point_id").isNotNull(), "c.idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("now", F.last("c", True).over(down)).filter("point_id is not null")
    through = F.expr("(t - now.a) * 1000 div greatest(now.z - now.a, 1)")
    return rows.select("meeting_id", "point_id", F.coalesce("now.idx", F.lit(-1)).alias("idx"), F.coalesce(F.greatest(F.lit(0), F.least(F.lit(1000), through)), F.lit(0)).alias("permille"))


def first_frames(chapters: DataFrame, frames: DataFrame) -> DataFrame:
    """The first frame of every chapter, which ends where the next begins. frames: meeting_id, frame_id, t."""
    nxt = F.lead("start_ms").over(Window.partitionBy("meeting_id").orderBy("idx"))
    spans = chapters.withColumn("end_ms", F.coalesce(nxt, "end_ms"))
    held = point_in_span(frames.select("meeting_id", F.col("frame_id").alias("point_id"), "t"), spans)
    best = held.filter("span_ms is not null").groupBy("meeting_id", "span_ms").agg(F.min_by("point_id", F.struct("t", "point_id")).alias("frame_id"))
    return spans.select("meeting_id", "idx", F.col("start_ms").alias("span_ms")).join(best, ["meeting_id", "span_ms"], "left").select("meeting_id", "idx", "frame_id")


def preview(points: DataFrame, lines: DataFrame, frames: DataFrame, chapters: DataFrame, reach_ms: int = 600_000) -> DataFrame:
    """What hovering over a time shows: the latest frame up to a second later, at most ``reach_ms`` old, the latest chapter
    begun by then, and the speaker of the latest line begun by then, unless it ended more than two seconds before. All three
    come from one sorted pass over the union, and every point gives one row, also one repeated or without a meeting or a
    time; of those that begin together the one of the largest id counts. points: meeting_id, point_id, t; lines: meeting_id,
    turn_id, speaker, start_ms, end_ms; frames: meeting_id, frame_id, t; chapters: meeting_id, idx, start_ms."""
    facts = {
        "frame": frames.select("meeting_id", (F.col("t") - 1000).alias("at"), F.struct("frame_id", "t").alias("frame")),
        "line": lines.select("meeting_id", F.col("start_ms").alias("at"), F.struct("turn_id", "end_ms", "speaker").alias("line")),
        "chapter": chapters.select("meeting_id", F.col("start_ms").alias("at"), F.struct(F.col("idx").cast("long").alias("idx")).alias("chapter")),
    }
    rows = points.select("meeting_id", F.col("t").alias("at"), F.struct("point_id").alias("point"))
    for fact in facts.values():
        rows = rows.unionByName(fact.filter("meeting_id IS NOT NULL AND at IS NOT NULL"), allowMissingColumns=True)
    down = Window.partitionBy("meeting_id").orderBy("at", F.col("point").isNotNull(), *facts).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select("meeting_id", "point", F.col("at").alias("t"), *[F.last(name, True).over(down).alias(name) for name in facts]).filter("point IS NOT NULL")
    fresh, going = F.col("t") - F.col("frame.t") <= reach_ms, F.col("line.end_ms") >= F.col("t") - 2000
    return out.select("meeting_id", "point.point_id", F.when(fresh, F.col("frame.frame_id")).alias("frame_id"), F.when(going, F.col("line.speaker")).alias("speaker"), F.col("chapter.idx").alias("chapter"))


def without_frames(moments: DataFrame, frames: DataFrame, near_ms: int = 1000) -> DataFrame:
    """Moments without a frame of their own (moment_id) and without any frame less than ``near_ms`` away.

    An OR would be a nested loop; two anti joins do it, one by the id and one by buckets of time.
    """
    own = frames.filter("moment_id is not null").select("moment_id")
    rest = moments.join(own, "moment_id", "left_anti")
    cell = lambda c: F.floor(c / near_ms).cast("long")
    near = frames.select(F.col("meeting_id").alias("m"), F.col("t").alias("ft"), F.explode(F.array(*[cell(F.col("t")) + i for i in (-1, 0, 1)])).alias("cell"))
    close = (F.col("meeting_id") == F.col("m")) & (cell(F.col("t")) == F.col("cell")) & (F.abs(F.col("t") - F.col("ft")) < near_ms)
    return rest.join(near, close, "left_anti")


class _Near:
    """The fold of a meeting for ``context_lines``: lines in the order of their starts, those out of reach of later points left out."""

    def __init__(self, band_ms: int, most: int):
        self.band_ms, self.most = band_ms, most
        self.starts: list[int] = []
        self.lines: list[tuple] = []  # (line_id, tokens, until)
        self.looked = 0

    def step(self, r: dict) -> list[tuple]:
        if r["kind"] == 0:
            self.starts.append(r["at"])
            self.lines.append((r["line_id"], r["tokens"] or 0, r["until"]))
            return []
        t = r["at"] - self.band_ms
        found = [(r["meeting_id"], r["point_id"], i) for i in self.kept(t)]
        if self.looked > 2 * len(self.lines) + 1000:
            alive = [(s, x) for s, x in zip(self.starts, self.lines, strict=True) if x[2] >= t - self.band_ms]
            self.starts, self.lines = [s for s, _ in alive], [x for _, x in alive]
            self.looked = 0
        return found

    def kept(self, t: int) -> list:
        """The lines that would go last, as long as their tokens are not too many."""
        found, total = [], 0
        for i in self.inward(t):
            total += self.lines[i][1]
            if total > self.most:
                break
            found.append(self.lines[i][0])
        return found

    def inward(self, t: int) -> Iterator[int]:
        """Places of the lines around ``t``, the one that would be cut last first."""
        starts, lines, least = self.starts, self.lines, t - self.band_ms
        middle = bisect_right(starts, t)

        def next_left(i: int) -> int:
            while i >= 0 and lines[i][2] < least:
                self.looked += 1
                i -= 1
            return i

        def next_right(j: int) -> int:
            while j < len(starts) and lines[j][2] < least:
                self.looked += 1
                j += 1
            return j

        i, j = next_left(middle - 1), next_right(middle)
        if j < len(starts) and (i < 0 or t - starts[i] >= starts[j] - t):
            # The first lines behind t are left alone at last: equally far, they go from the first on.
            end = bisect_right(starts, starts[j])
            for k in range(end - 1, j - 1, -1):
                self.looked += 1
                if lines[k][2] >= least:
                    yield k
            j = next_right(end)
        while i >= 0 or j < len(starts):
            self.looked += 1
            if j < len(starts) and (i < 0 or t - starts[i] >= starts[j] - t):
                yield j
                j = next_right(j + 1)
            else:
                yield i
                i = next_left(i - 1)


def context_lines(points: DataFrame, lines: DataFrame, band_ms: int = 60_000, most: int = 3000) -> DataFrame:
    """Lines within ``band_ms`` around every point, cut from the end that is further away until their tokens are ``most`` or fewer.

    points: meeting_id, point_id, t; lines: meeting_id, line_id, start_ms, end_ms, tokens (null is 0). A line without an end
    (null or 0) ends at its start. Returns meeting_id, point_id, line_id. Of equally far ends the first line goes. A
    meeting's lines and points pass in the order of time; each point looks from itself outwards, as far as its tokens
    reach, and only lines that points to come may still need are held.
    """
    until = F.coalesce(F.nullif("end_ms", F.lit(0)), "start_ms")
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    heard = lines.filter("start_ms IS NOT NULL").select("meeting_id", F.col("start_ms").cast("long").alias("at"), F.lit(0).alias("kind"), "line_id", "tokens", until.cast("long").alias("until"), none(points, "point_id"))
    asked = points.filter("t IS NOT NULL").select("meeting_id", (F.col("t") + band_ms).cast("long").alias("at"), F.lit(1).alias("kind"), none(lines, "line_id"), none(lines, "tokens"), F.lit(None).cast("long").alias("until"), "point_id")
    rows = heard.unionByName(asked).filter("meeting_id IS NOT NULL")
    # A line is behind all points that it is too late for, and before the point whose band it begins at the end of.
    return folded(rows, ["meeting_id"], ["at", "kind", "line_id", "tokens"], lambda: _Near(band_ms, most), _Near.step, rows.select("meeting_id", "point_id", "line_id").schema)


def concatenated(recordings: DataFrame) -> DataFrame:
    """Recordings of a group (group_id, part, length_ms) with the offset at which each begins when they are put one behind another."""
    before = Window.partitionBy("group_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return recordings.withColumn("offset_ms", F.coalesce(F.sum("length_ms").over(before), F.lit(0)))


def joined_recordings(recordings: DataFrame, turns: DataFrame, head_ms: int | None = None, times: int = 1) -> DataFrame:
    """Turns (group_id, speaker, start_ms, end_ms) of each group's recordings put one behind another, the whole ``times`` times over.

    With ``head_ms`` only the first so many milliseconds of every recording count: turns behind go, those across its
    end are cut. recordings: group_id, part, length_ms; turns: group_id, part, speaker, start_ms, end_ms.
    """
    length = F.col("length_ms") if head_ms is None else F.least(F.col("length_ms"), F.lit(head_ms))
    placed = concatenated(recordings.withColumn("length_ms", length))
    total = placed.groupBy("group_id").agg(F.sum("length_ms").alias("total"))
    rows = turns.join(placed, ["group_id", "part"]).join(total, "group_id").withColumn("end_ms", F.least("end_ms", "length_ms")).filter("end_ms > start_ms")
    rows = rows.withColumn("__again", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    shift = F.col("offset_ms") + F.col("__again") * F.col("total")
    return rows.select("group_id", "speaker", (F.col("start_ms") + shift).alias("start_ms"), (F.col("end_ms") + shift).alias("end_ms"))


def clamped_lines(chunks: DataFrame) -> DataFrame:
    """Lines of a segment's speech span [lo, hi]: clamped, in order, without steps back; the first begins at lo, the last ends at hi.

    chunks: segment_id, n (their order), clip_ms, lo, hi, start_ms, end_ms, text; times are within the clip and null
    where they could not be read, which stands for the whole span. A segment with no line but a text of its own is
    left to the caller. A line never ends later than it is clamped to, so the line before tells where it may begin.
    """
    rows = chunks.filter(F.regexp_like("text", F.lit(r"(?U)\S")))
    a = F.least(F.greatest(F.coalesce(F.col("clip_ms") + F.col("start_ms"), "lo"), "lo"), "hi")
    b = F.coalesce(F.col("clip_ms") + F.col("end_ms"), "hi")
    rows = rows.select("segment_id", "n", "lo", "hi", a.alias("a"), F.least(F.greatest(b, a), "hi").alias("b"), "text")
    of = Window.partitionBy("segment_id").orderBy("n")
    before = F.lag("b").over(of)
    start = F.when(before.isNull(), F.col("lo")).when((F.col("a") < before) & (before <= F.col("b")), before).otherwise(F.col("a"))
    end = F.when(F.lead("n").over(of).isNull(), F.col("hi")).otherwise(F.col("b"))
    return rows.select("segment_id", "n", start.alias("start_ms"), end.alias("end_ms"), "text")

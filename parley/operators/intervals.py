"""Interval operators: islands, sweeps, bucketed range joins, as-of joins. Times are integer milliseconds.

Every operator takes (meeting_id, speaker, start_ms, end_ms, turn_id) and works per meeting, so meetings parallelise.
Ordered ones use the total order (start_ms, end_ms, turn_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ["start_ms", "end_ms", "turn_id"]
BEFORE = (Window.unboundedPreceding, -1)


def talk_time(turns: DataFrame) -> DataFrame:
    """Milliseconds and turns per meeting and speaker."""
    return turns.groupBy("meeting_id", "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("talk_ms"), F.count(F.lit(1)).alias("n_turns"))


def talk_share(turns: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Each speaker's share of the meeting's talk; where turns give nothing the lines' clamped time counts; zeros go."""
    spoken = talk_time(turns).select("meeting_id", "speaker", "talk_ms")
    if lines is not None:
        clamped = lines.groupBy("meeting_id", "speaker").agg(F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).alias("line_ms"))
        spoken = spoken.join(clamped, ["meeting_id", "speaker"], "full").withColumn("talk_ms", F.coalesce(F.nullif("talk_ms", F.lit(0)), "line_ms", F.lit(0)))
    total = F.sum("talk_ms").over(Window.partitionBy("meeting_id"))
    return spoken.select("meeting_id", "speaker", "talk_ms", (F.col("talk_ms") / F.when(total == 0, 1).otherwise(total)).alias("share")).filter("talk_ms > 0")


def speaker_count(turns: DataFrame) -> DataFrame:
    return turns.groupBy("meeting_id").agg(F.countDistinct("speaker").alias("n_speakers"))


def _islands(turns: DataFrame, keys: list[str], begins: Column, **more: Column) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(*ORDER)
    marked = turns.withColumn("island", F.sum(begins.cast("int")).over(order))
    return marked.groupBy("meeting_id", "speaker", "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n_turns"), *[c.alias(n) for n, c in more.items()]).drop("island")


def merge_same_speaker(turns: DataFrame, gap_ms: int = 30_000) -> DataFrame:
    """Neighbouring turns of one speaker joined over gaps up to ``gap_ms``; anyone else's turn between them ends it.

    A run's running end equals its island's, so one window over runs of a speaker is enough.
    """
    order = Window.partitionBy("meeting_id").orderBy(*ORDER)
    turns = turns.filter("end_ms > start_ms").withColumn("new", F.coalesce(F.col("speaker") != F.lag("speaker").over(order), F.lit(True)))
    turns = turns.withColumn("run", F.sum(F.col("new").cast("int")).over(order))
    reach = F.max("end_ms").over(Window.partitionBy("meeting_id", "run").orderBy(*ORDER).rowsBetween(*BEFORE))
    turns = turns.withColumn("begins", F.col("new") | (F.col("start_ms") - reach > gap_ms))
    return _islands(turns, ["meeting_id"], F.col("begins"))


def merge_gaps(turns: DataFrame, gap_ms: int = 800) -> DataFrame:
    """A speaker's turns joined where the gap is strictly below ``gap_ms``, whatever others say between."""
    reach = F.max("end_ms").over(Window.partitionBy("meeting_id", "speaker").orderBy(*ORDER).rowsBetween(*BEFORE))
    turns = turns.withColumn("begins", F.coalesce(F.col("start_ms") - reach >= gap_ms, F.lit(True)))
    return _islands(turns, ["meeting_id", "speaker"], F.col("begins"))


def speaker_bands(turns: DataFrame, gap_ms: int = 2000) -> DataFrame:
    """As ``merge_same_speaker``, keeping empty turns, gaps up to and including ``gap_ms``."""
    order = Window.partitionBy("meeting_id").orderBy(*ORDER)
    turns = turns.withColumn("new", F.coalesce(F.col("speaker") != F.lag("speaker").over(order), F.lit(True)))
    turns = turns.withColumn("run", F.sum(F.col("new").cast("int")).over(order))
    reach = F.max("end_ms").over(Window.partitionBy("meeting_id", "run").orderBy(*ORDER).rowsBetween(*BEFORE))
    return _islands(turns.withColumn("begins", F.col("new") | (F.col("start_ms") - reach > gap_ms)), ["meeting_id"], F.col("begins"))


def range_join(left: DataFrame, right: DataFrame, bucket_ms: int = 60_000) -> DataFrame:
    """Pairs (l, r) of overlapping spans of one meeting: an equi-join on time buckets, each pair found in one bucket.

    Both sides need meeting_id, start_ms, end_ms; the result has structs ``l`` and ``r``. A span is copied once per
    bucket that it touches, so work follows the overlaps and not the product of a meeting's sides.
    """

    def dealt(df: DataFrame, name: str) -> DataFrame:
        first, last = F.expr(f"start_ms div {bucket_ms}"), F.expr(f"greatest(start_ms, end_ms - 1) div {bucket_ms}")
        return df.select("meeting_id", F.struct(*df.columns).alias(name), F.explode(F.sequence(first, last)).alias("bucket"))

    pairs = dealt(left, "l").join(dealt(right, "r"), ["meeting_id", "bucket"])
    once = F.expr(f"greatest(l.start_ms, r.start_ms) div {bucket_ms}") == F.col("bucket")
    return pairs.filter(once & (F.col("l.start_ms") < F.col("r.end_ms")) & (F.col("r.start_ms") < F.col("l.end_ms"))).select("l", "r")


def overlap_flag(turns: DataFrame, least_ms: int = 200) -> DataFrame:
    """Every turn with the time it shares with other speakers, summed per pair, and whether that is ``least_ms`` or more.

    No pair is formed. Time shared with all turns is the growth, from a turn's start to its end, of the sum over all starts
    and ends so far of how long ago they are, ends counted against; time shared with its own speaker's turns goes off. A
    turn that ends before it starts meets others as in ``range_join``; without a speaker or a time it meets none.
    """
    some = turns.filter("speaker IS NOT NULL")
    ends = F.array(F.struct(F.col("start_ms").alias("t"), F.lit(1).cast("long").alias("d")), F.struct(F.col("end_ms").alias("t"), F.lit(-1).cast("long").alias("d")))
    marks = some.filter("end_ms > start_ms").select("meeting_id", "speaker", "turn_id", F.explode(ends).alias("m")).select("meeting_id", "speaker", "turn_id", "m.t", "m.d")

    def so_far(*keys: str) -> Column:
        w = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
        return F.col("t") * F.sum("d").over(w) - F.sum(F.col("d") * F.col("t")).over(w)  # marks of one time add nothing to each other

    marks = marks.filter("meeting_id IS NOT NULL").withColumn("all", so_far("meeting_id")).withColumn("own", so_far("meeting_id", "speaker"))
    parts = marks.select("turn_id", (-F.col("d") * (F.col("all") - F.col("own"))).alias("ms"))
    back = some.filter("end_ms < start_ms")
    pairs = range_join(back, some).unionByName(range_join(some.filter("end_ms >= start_ms"), back)).filter("l.speaker <> r.speaker")
    parts = parts.unionByName(pairs.select(F.col("l.turn_id").alias("turn_id"), (F.least("l.end_ms", "r.end_ms") - F.greatest("l.start_ms", "r.start_ms")).alias("ms")))
    shared = parts.groupBy("turn_id").agg(F.sum("ms").alias("shared_ms"))
    out = turns.join(shared, "turn_id", "left").withColumn("shared_ms", F.coalesce("shared_ms", F.lit(0)))
    return out.select("turn_id", "meeting_id", "speaker", "shared_ms", (F.col("shared_ms") >= least_ms).alias("overlap"))


def overlap_regions(turns: DataFrame, least_ms: int = 200, gap_ms: int = 800) -> DataFrame:
    """Stretches in which two speakers or more talk, by a sweep over starts and ends (ends first at equal times).

    Speakers' own turns are joined first, so the number of active turns is the number of active speakers.
    """
    spans = merge_gaps(turns, gap_ms).filter("end_ms > start_ms")
    marks = spans.select("meeting_id", F.explode(F.array(F.struct(F.col("start_ms").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_ms").alias("t"), F.lit(-1).alias("d")))).alias("m"))
    marks = marks.groupBy("meeting_id", F.col("m.t").alias("t"), F.col("m.d").alias("d")).agg(F.sum("m.d").alias("change"))
    order = Window.partitionBy("meeting_id").orderBy("t", "d")
    marks = marks.withColumn("active", F.sum("change").over(order)).withColumn("was", F.coalesce(F.lag("active").over(order), F.lit(0)))
    edges = marks.filter("(active >= 2) <> (was >= 2)").withColumn("end_ms", F.lead("t").over(order))
    regions = edges.filter("active >= 2").select("meeting_id", F.col("t").alias("start_ms"), "end_ms").filter(F.col("end_ms") - F.col("start_ms") >= least_ms)
    who = range_join(regions, spans.select("meeting_id", "speaker", "start_ms", "end_ms"))
    return who.groupBy("l.meeting_id", "l.start_ms", "l.end_ms").agg(F.array_join(F.sort_array(F.collect_set("r.speaker")), ",").alias("speakers"))


def relabel_speakers(turns: DataFrame) -> DataFrame:
    """S1, S2, ... per meeting in the order of first appearance."""
    first = turns.groupBy("meeting_id", "speaker").agg(F.min("start_ms").alias("first_ms"))
    rank = F.row_number().over(Window.partitionBy("meeting_id").orderBy("first_ms", "speaker"))
    return first.select("meeting_id", "speaker", "first_ms", F.concat(F.lit("S"), rank.cast("string")).alias("label"))


def asof(probes: DataFrame, facts: DataFrame, value: str = "turn_id") -> DataFrame:
    """probes (meeting_id, probe_id, t) with the last fact at or before t and the first one at or after it.

    Both come from one sorted pass over the union, so no pair is formed. facts: meeting_id, t, ``value``; equal
    times: the last value is the one before, the first the one after.
    """
    none = F.lit(None)
    rows = probes.select("meeting_id", "t", "probe_id", none.cast("struct<t:bigint,v:bigint>").alias("fact")).unionByName(
        facts.select("meeting_id", "t", none.cast("long").alias("probe_id"), F.struct(F.col("t").cast("long").alias("t"), F.col(value).cast("long").alias("v")).alias("fact"))
    )
    key = Window.partitionBy("meeting_id")
    is_probe = F.col("probe_id").isNotNull().cast("int")
    down = key.orderBy("t", is_probe, "fact.v").rowsBetween(Window.unboundedPreceding, 0)
    up = key.orderBy(F.desc("t"), is_probe, F.desc("fact.v")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("before", F.last("fact", True).over(down)).withColumn("after", F.last("fact", True).over(up))
    return rows.filter("probe_id is not null").select("meeting_id", "probe_id", "t", "before", "after")


def asof_active(turns: DataFrame) -> DataFrame:
    """For the end of every turn: the turn that began last by then, and whether it is still going on (-1: none)."""
    found = asof(turns.select("meeting_id", F.col("turn_id").alias("probe_id"), F.col("end_ms").alias("t")), turns.withColumn("t", F.col("start_ms")))
    return found.select("meeting_id", "probe_id", "t", F.coalesce("before.v", F.lit(-1)).alias("active_id"))


def asof_nearest(turns: DataFrame, within_ms: int = 20_000) -> DataFrame:
    """For the end of every turn: the nearest start of a turn within ``within_ms`` on either side, the earlier of two."""
    found = asof(turns.select("meeting_id", F.col("turn_id").alias("probe_id"), F.col("end_ms").alias("t")), turns.withColumn("t", F.col("start_ms")))
    back, ahead = F.col("t") - F.col("before.t"), F.col("after.t") - F.col("t")
    near = F.when(back.isNull() | (ahead < back), F.col("after")).otherwise(F.col("before"))
    found = found.withColumn("near", near).withColumn("away_ms", F.abs(F.col("near.t") - F.col("t")))
    hit = F.col("away_ms") <= within_ms
    return found.select("meeting_id", "probe_id", "t", F.when(hit, F.col("near.t")).alias("snap_ms"))


def waveform(turns: DataFrame, bin_ms: int = 60_000) -> DataFrame:
    """Per bin the speech in it and the speaker with most of it (the one who spoke first in it, of equals)."""
    cells = turns.filter("end_ms > start_ms").withColumn("bin", F.explode(F.sequence(F.expr(f"start_ms div {bin_ms}"), F.expr(f"(end_ms - 1) div {bin_ms}"))))
    part = F.least(F.col("end_ms"), (F.col("bin") + 1) * bin_ms) - F.greatest(F.col("start_ms"), F.col("bin") * bin_ms)
    by = cells.groupBy("meeting_id", "bin", "speaker").agg(F.sum(part).alias("ms"), F.min(F.struct("start_ms", "turn_id")).alias("first"))
    best = F.min_by("speaker", F.struct(-F.col("ms"), F.col("first")))
    return by.groupBy("meeting_id", "bin").agg(F.sum("ms").alias("speech_ms"), best.alias("speaker"))


def raster(turns: DataFrame, frame_ms: int = 10_000) -> DataFrame:
    """(meeting_id, speaker, frame) of the frames in which each speaker is active, each once."""
    a, b = (F.rint(F.col(c) / float(frame_ms)).cast("long") for c in ("start_ms", "end_ms"))
    some = turns.withColumn("a", a).withColumn("b", b).filter("b > a")
    return some.select("meeting_id", "speaker", F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("frame")).distinct()


def median_filter(active: DataFrame, window: int = 3, ends: DataFrame | None = None) -> DataFrame:
    """Binary majority over a centred odd window of frames, from active frames alone.

    A frame is on if more than half of the window around it is. Past the edges frame 0 and the last frame of the
    recording go on. ``ends`` (meeting_id, n_frames) tells where recordings end; without it, behind their last active
    frame. Each active frame votes for the frames around it, so silent frames are never made.
    """
    if window % 2 == 0:
        raise ValueError("an odd window is needed")
    half = window // 2
    last = active.groupBy("meeting_id").agg((F.max("frame") + 1).alias("n_frames")) if ends is None else ends
    ends = last.select("meeting_id", F.lit(0).cast("long").alias("lo"), (F.col("n_frames") - 1).alias("hi"))
    rows = active.join(ends, "meeting_id")
    near = F.explode(F.sequence(F.col("frame") - half, F.col("frame") + half)).alias("at")
    at_edge = lambda edge, gap: F.when(F.col("frame") == F.col(edge), F.greatest(F.lit(0), half - gap)).otherwise(0)
    votes = rows.select("meeting_id", "speaker", "frame", "lo", "hi", near).filter("at between lo and hi")
    n = F.lit(1) + at_edge("lo", F.col("at") - F.col("lo")) + at_edge("hi", F.col("hi") - F.col("at"))
    counted = votes.groupBy("meeting_id", "speaker", F.col("at").alias("frame")).agg(F.sum(n).alias("n"))
    return counted.filter(F.col("n") > half).select("meeting_id", "speaker", "frame")


def active_runs(frames: DataFrame, least: int = 1) -> DataFrame:
    """Half-open runs [first, last) of consecutive frames, those of ``least`` frames or more."""
    run = F.col("frame") - F.row_number().over(Window.partitionBy("meeting_id", "speaker").orderBy("frame"))
    runs = frames.withColumn("run", run).groupBy("meeting_id", "speaker", "run").agg(F.min("frame").alias("first"), (F.max("frame") + 1).alias("last"))
    return runs.filter(F.col("last") - F.col("first") >= least).drop("run")

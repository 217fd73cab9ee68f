"""Rendering of timed lines: text, SRT, VTT, RTTM, Markdown-free projections built from format strings alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import words


def clock(ms: Column, mark: str = "") -> Column:
    """HH:MM:SS, with ``mark`` and three digits of milliseconds if a mark is given; null and negative times are 0."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    ms = F.greatest(F.lit(0), F.coalesce(ms, F.lit(0)))
    s = F.floor(ms / 1000)
    hours = F.floor(s / 3600).cast("string")
    parts = [F.lpad(hours, F.greatest(F.lit(2), F.length(hours)), F.lit("0")), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60)]
    return F.concat(*parts, *([F.lit(mark), F.lpad((ms % 1000).cast("string"), 3, "0")] if mark else []))


def named(rows: DataFrame, names: DataFrame | None, label: str = "speaker", out: str = "who") -> DataFrame:
    """``rows`` with ``out``, what a speaker's label is shown as. names: meeting_id, label, display; without one, by the label alone."""
    if names is None:
        return rows.withColumn(out, words.speaker_name(F.col(label)))
    known = names.groupBy(F.col("meeting_id").alias("__m"), F.col("label").alias("__label")).agg(F.max("display").alias("__display"))
    both = rows.join(known, (F.col("meeting_id") == F.col("__m")) & (F.col(label) == F.col("__label")), "left")
    return both.withColumn(out, words.speaker_name(F.col(label), F.col("__display"))).drop("__m", "__label", "__display")


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def txt(lines: DataFrame, names: DataFrame | None = None) -> DataFrame:
    line = F.concat(F.lit("["), clock(F.col("start_ms")), F.lit("] "), "who", F.lit(": "), _text())
    return named(lines, names).select("meeting_id", "line_id", line.alias("line"))


def srt(lines: DataFrame, names: DataFrame | None = None) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("meeting_id").orderBy("start_ms", "line_id"))
    cue = F.concat(n.cast("string"), F.lit("\n"), clock(F.col("start_ms"), ","), F.lit(" --> "), clock(F.col("end_ms"), ","), F.lit("\n"), "who", F.lit(": "), _text(), F.lit("\n"))
    return named(lines, names).select("meeting_id", "line_id", cue.alias("cue"))


def vtt(lines: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """A voice's name can't hold '>', and a cue's text can't hold an arrow."""
    cue = F.concat(clock(F.col("start_ms"), "."), F.lit(" --> "), clock(F.col("end_ms"), "."), F.lit("\n<v "), F.replace("who", F.lit(">"), F.lit("")), F.lit(">"), F.replace(_text(), F.lit("-->"), F.lit("->")), F.lit("\n"))
    return named(lines, names).select("meeting_id", "line_id", cue.alias("cue"))


def rttm(turns: DataFrame) -> DataFrame:
    sec = lambda ms: F.format_string("%d.%03d", F.floor(ms / 1000), ms % 1000)
    length = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))
    row = F.concat(F.lit("SPEAKER "), F.col("meeting_id"), F.lit(" 1 "), sec(F.col("start_ms")), F.lit(" "), sec(length), F.lit(" <NA> <NA> "), F.col("speaker"), F.lit(" <NA> <NA>"))
    return turns.select("turn_id", row.alias("row"))


def filename(title: Column) -> Column:
    """A safe file name of 80 characters at most, without dashes at its ends; "meeting" if nothing is left."""
    safe = F.substring(F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), r"[^A-Za-z0-9._-]+", "-"), "^-+|-+$", ""), 1, 80)
    return F.when(safe == "", "meeting").otherwise(safe)


def document(cues: DataFrame, column: str, head: str = "", between: str = "\n", end: str = "") -> DataFrame:
    """One text per meeting: ``head`` and the rendered ``column`` of all lines in the order of their ids."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_id", column))), lambda x: x[column]), between)
    return cues.groupBy("meeting_id").agg(F.concat(F.lit(head), joined, F.lit(end)).alias("document"))


def documents(lines: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(meeting_id, format, document): every meeting's lines as whole txt, srt and vtt files."""
    made = {"txt": document(txt(lines, names), "line", end="\n"), "srt": document(srt(lines, names), "cue"), "vtt": document(vtt(lines, names), "cue", head="WEBVTT\n\n")}
    out = [d.select("meeting_id", F.lit(kind).alias("format"), "document") for kind, d in made.items()]
    return out[0].union(out[1]).union(out[2])


def event_frame(event: Column, data: Column) -> Column:
    """An event as a stream of server-sent events holds it: its name, and its row (a struct) as JSON on one line; null fields stay."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), F.to_json(data, {"ignoreNullFields": "false"}), F.lit("\n\n"))

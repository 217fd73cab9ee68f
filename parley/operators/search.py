"""Search without an index: substrings, snippets around the first match, highlights, grounding of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import words

def substring_search(lines: DataFrame, query: str) -> DataFrame:
    needle = query.strip().lower()
    if not needle:
        return lines.select("meeting_id", "line_id").limit(0)
    return lines.filter(F.contains(F.lower("text"), F.lit(needle))).select("meeting_id", "line_id")


def snippet(text: Column, query: str, around: int = 60, otherwise: int = 120) -> Column:
    """The first match with ``around`` characters on either side, dots where something was cut; else the text's start."""
    at = F.instr(F.lower(text), query.lower())
    lo = F.greatest(at - around, F.lit(1))
    hi = F.least(at + len(query) + around, F.length(text) + 1)
    cut = F.concat(F.when(lo > 1, "…").otherwise(""), F.substring(text, lo, hi - lo), F.when(hi <= F.length(text), "…").otherwise(""))
    return F.when(at > 0, cut).otherwise(F.substring(text, 1, otherwise))


def salient_words(lines: DataFrame) -> DataFrame:
    """The stems of each line's words that carry meaning, sorted."""
    return lines.select("meeting_id", "line_id", F.array_join(F.array_sort(words.salient(F.col("text"))), " ").alias("words"))


def grounding(claims: DataFrame, lines: DataFrame, ends: DataFrame, band_ms: int = 90_000, slack_ms: int = 2000) -> DataFrame:
    """Whether a claim shares enough stems with other lines of the meeting within ``band_ms`` of its time.

    One shared stem is enough for a claim of three or fewer, else two are needed. A claim without a stem, without a
    time, or with one outside the meeting (0 .. end + ``slack_ms``) is never grounded. claims and lines: meeting_id,
    line_id, start_ms, end_ms, text; ends: meeting_id, end_ms. A line without an end stands at its start. The band
    join runs on time buckets.
    """
    c = claims.select("meeting_id", F.col("line_id").alias("claim_id"), F.col("start_ms").alias("t"), words.salient(F.col("text")).alias("want"))
    near = F.explode(F.sequence(F.expr(f"(t - {band_ms}) div {band_ms}") - 1, F.expr(f"(t + {band_ms}) div {band_ms}")))
    until = F.coalesce(F.nullif("end_ms", F.lit(0)), "start_ms")
    b = lines.select("meeting_id", "line_id", "start_ms", until.alias("until"), words.salient(F.col("text")).alias("has"))
    # A line that began before the band may still reach into it: it is dealt to every bucket that it touches.
    b = b.withColumn("bucket", F.explode(F.sequence(F.expr(f"start_ms div {band_ms}"), F.expr(f"greatest(start_ms, until) div {band_ms}"))))
    pairs = c.withColumn("bucket", near).join(b, ["meeting_id", "bucket"])
    pairs = pairs.filter((F.col("line_id") != F.col("claim_id")) & (F.col("start_ms") <= F.col("t") + band_ms) & (F.col("until") >= F.col("t") - band_ms))
    found = pairs.select("meeting_id", "claim_id", F.explode(F.array_intersect("want", "has")).alias("stem")).groupBy("meeting_id", "claim_id").agg(F.countDistinct("stem").alias("k"))
    out = c.join(found, ["meeting_id", "claim_id"], "left").join(ends.select("meeting_id", F.col("end_ms").alias("until")), "meeting_id", "left")
    n, k = F.size("want"), F.coalesce("k", F.lit(0)).cast("int")
    inside = F.coalesce((F.col("t") >= 0) & (F.col("t") <= F.col("until") + slack_ms), F.lit(False))
    return out.select("meeting_id", "claim_id", n.alias("n_words"), k.alias("n_found"), (inside & (n > 0) & (k >= F.when(n <= 3, 1).otherwise(2))).alias("grounded"))


def highlight(text: Column, query: str) -> Column:
    """The text cut into [text, hit] pieces: every match of the query, regardless of case and without overlaps, is a hit."""
    import re

    pattern = f"(?i)({re.escape(query)})"
    marked = F.regexp_replace(text, pattern, "\u0001$1\u0002")
    pieces = F.filter(F.split(marked, "[\u0001\u0002]"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(p.alias("text"), p.rlike(f"{pattern}$").alias("hit")))


def markers(snippet_: Column) -> Column:
    """The texts between [[ and ]] of a snippet."""
    return F.regexp_extract_all(snippet_, F.lit(r"\[\[(.*?)\]\]"), F.lit(1))

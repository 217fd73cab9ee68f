"""Changes that go through several tables at once: a person is removed, two speakers become one. Each gives the new tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIVE = ("deleting", "cancelled")


def removed(tables: dict[str, DataFrame], person: int, heir: int, transfer: bool = True) -> dict[str, DataFrame]:
    """``tables`` (meetings, shares, uploads, users, and any others with user_id) after ``person`` is gone.

    With ``transfer`` the person's meetings are the heir's, who needs no share of what is now their own; else live ones
    are marked for deletion. Uploads go to the heir in any case, invitations lose their inviter, and all other rows of
    the person go. meetings: meeting_id, owner_id, status; shares: meeting_id, user_id; uploads: owner_id; users:
    user_id, invited_by.
    """
    out = dict(tables)
    theirs = F.col("owner_id").eqNullSafe(F.lit(person))
    to_heir = F.when(theirs, F.lit(heir)).otherwise(F.col("owner_id"))
    meetings = tables["meetings"]
    if transfer:
        out["meetings"] = meetings.withColumn("owner_id", to_heir)
        own = out["meetings"].filter(F.col("owner_id") == heir).select("meeting_id", F.lit(heir).alias("user_id"))
        out["shares"] = tables["shares"].join(own, ["meeting_id", "user_id"], "left_anti").select(*tables["shares"].columns)
    else:
        out["meetings"] = meetings.withColumn("status", F.when(theirs & ~F.col("status").isin(*LIVE), "deleting").otherwise(F.col("status")))
    out["uploads"] = tables["uploads"].withColumn("owner_id", to_heir)
    out["users"] = tables["users"].filter(~F.col("user_id").eqNullSafe(F.lit(person))).withColumn("invited_by", F.when(F.col("invited_by") == person, None).otherwise(F.col("invited_by")))
    for name in tables.keys() - {"meetings", "uploads", "users"}:
        out[name] = out[name].filter(~F.col("user_id").eqNullSafe(F.lit(person)))
    return out


def relabelled(rows: DataFrame, merges: DataFrame, label: str = "speaker", said: str | None = None) -> DataFrame:
    """Rows whose label is a merge's source under its target; ``said`` names an array of (start_ms, end_ms, speaker) that is
    rewritten too. merges: meeting_id, source, target, a source once a meeting."""
    to = merges.groupBy(F.col("meeting_id").alias("__m")).agg(F.map_from_entries(F.collect_list(F.struct("source", "target"))).alias("__to"))
    both = rows.join(to, F.col("meeting_id") == F.col("__m"), "left")
    new = lambda c: F.coalesce(F.element_at("__to", c), c)
    both = both.withColumn(label, new(F.col(label)))
    if said is not None:
        both = both.withColumn(said, F.transform(said, lambda x: F.struct(x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), new(x["speaker"]).alias("speaker"))))
    return both.select(*rows.columns)


def merged_speakers(speakers: DataFrame, merges: DataFrame) -> DataFrame:
    """speakers (meeting_id, label, display_name, suggested_name, evidence_t) after merges: a source's row goes, and fills what its
    target lacks. A target without a row gets one. Of several sources of a target the first by label fills first."""
    gone = speakers.join(merges.withColumnRenamed("source", "label"), ["meeting_id", "label"])
    fill = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("label"))).alias(f"__{c}")
    names = ["display_name", "suggested_name", "evidence_t"]
    filled = gone.groupBy("meeting_id", F.col("target").alias("label")).agg(*map(fill, names))
    wanted = merges.select("meeting_id", F.col("target").alias("label")).distinct().join(filled, ["meeting_id", "label"], "left")
    stay = speakers.join(merges.select("meeting_id", F.col("source").alias("label")), ["meeting_id", "label"], "left_anti")
    out = stay.join(wanted, ["meeting_id", "label"], "full")
    return out.select("meeting_id", "label", *[F.coalesce(n, f"__{n}").alias(n) for n in names])


def notes_after_merge(notes: DataFrame, merges: DataFrame) -> DataFrame:
    """notes (meeting_id, action_items with an owner, speaker_suggestions with a label) after merges: owners follow, suggestions
    for a source go."""
    to = merges.groupBy(F.col("meeting_id").alias("__m")).agg(F.map_from_entries(F.collect_list(F.struct("source", "target"))).alias("__to"))
    both = notes.join(to, F.col("meeting_id") == F.col("__m"), "left")
    fields = [f.name for f in notes.schema["action_items"].dataType.elementType]
    owner = lambda x: F.coalesce(F.element_at("__to", x["owner"]), x["owner"])
    items = F.transform("action_items", lambda x: F.struct(*[(owner(x) if f == "owner" else x[f]).alias(f) for f in fields]))
    suggested = F.filter("speaker_suggestions", lambda x: F.element_at("__to", x["label"]).isNull())
    return both.withColumns({"action_items": items, "speaker_suggestions": suggested}).select(*notes.columns)

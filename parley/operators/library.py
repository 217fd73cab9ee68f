"""Listings: access levels, states, progress, grouping by day, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stages of a recording's processing, in order (fixed values).
STAGES = ["prepare", "diarize", "segment", "transcribe", "moments", "frames", "notes"]


def access_levels(meetings: DataFrame, shares: DataFrame) -> DataFrame:
    """(meeting_id, user_id, access): the highest of ownership, the user's best share and what everyone may do.

    meetings: meeting_id, owner_id, everyone (edit, view or null); shares: meeting_id, user_id, access. One row for
    the owner and everyone with a share; others have just what everyone may do, which stays with the meeting.
    """
    level = lambda c: F.when(c == "edit", 2).when(c == "view", 1).otherwise(0)
    owner = meetings.select("meeting_id", F.col("owner_id").alias("user_id"), F.lit(3).alias("rank"))
    shared = shares.select("meeting_id", "user_id", level(F.col("access")).alias("rank"))
    best = owner.unionByName(shared).groupBy("meeting_id", "user_id").agg(F.max("rank").alias("rank"))
    best = best.join(meetings.select("meeting_id", level(F.col("everyone")).alias("all")), "meeting_id").withColumn("rank", F.greatest("rank", "all")).filter("rank > 0")
    return best.select("meeting_id", "user_id", F.element_at(F.array(*map(F.lit, ("view", "edit", "owner"))), F.col("rank")).alias("access"))


def people_list(users: DataFrame, meetings: DataFrame, shares: DataFrame) -> DataFrame:
    """Every user with the number and sum of own meetings and the number of meetings shared with them, 0 for none."""
    own = meetings.groupBy(F.col("owner_id").alias("user_id")).agg(F.count(F.lit(1)).alias("n_meetings"), F.sum("cents").alias("cents"))
    given = shares.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_shared"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return users.join(own, "user_id", "left").join(given, "user_id", "left").select("user_id", "name", none("n_meetings"), none("cents"), none("n_shared"))


def day_group(day: Column, today: Column) -> Column:
    """today, yesterday, this week (under 7 days), or the month as yyyy-mm."""
    age = F.datediff(today, day)
    return F.when(age == 0, "today").when(age == 1, "yesterday").when((age > 1) & (age < 7), "this week").otherwise(F.date_format(day, "yyyy-MM"))


def invite_state(used: Column, revoked: Column, expires: Column, now: Column) -> Column:
    return F.when(used.isNotNull(), "used").when(revoked.isNotNull(), "revoked").when(expires <= now, "expired").otherwise("pending")


def progress(stages: DataFrame) -> DataFrame:
    """Per meeting the mean progress of stages that aren't skipped (done: 1) in ten thousandths, and the first stage not done.

    stages: meeting_id, ord, stage, status, permille. No stage left to do: null and 10000.
    """
    live = F.col("status") != "skipped"
    part = F.when(F.col("status") == "done", 1000).otherwise(F.col("permille"))
    todo = live & (F.col("status") != "done")
    return stages.groupBy("meeting_id").agg(
        F.min_by("stage", F.when(todo, F.col("ord"))).alias("at_stage"),
        F.coalesce(F.expr("0") + F.sum(F.when(live, part)) * 10 / F.count(F.when(live, 1)), F.lit(10_000.0)).alias("progress"),
    )


def queue(meetings: DataFrame) -> DataFrame:
    """Waiting meetings in the order in which they run: running, queued, paused; then by time and id."""
    rank = F.when(F.col("status") == "running", 0).when(F.col("status") == "queued", 1).when(F.col("status") == "paused", 2)
    waiting = meetings.withColumn("rank", rank).filter("rank is not null")
    return waiting.select("meeting_id", "status", "created", "rank")


def best_status(models: DataFrame) -> DataFrame:
    """The best status each model has (ready, degraded, disabled, quarantined, missing, unknown), the first of equals."""
    rank = F.array_position(F.array(*map(F.lit, ("unknown", "missing", "quarantined", "disabled", "degraded", "ready"))), F.col("status"))
    return models.groupBy("model").agg(F.max_by("status", F.struct(rank, -F.col("seq"))).alias("status"))


def cover_frame(frames: DataFrame) -> DataFrame:
    """Per meeting its first relevant frame (unknown relevance counts), else its first frame."""
    key = F.struct((F.coalesce("relevance", F.lit(1)) <= 0).cast("int"), F.col("t"), F.col("frame_id"))
    return frames.groupBy("meeting_id").agg(F.min_by("frame_id", key).alias("frame_id"))


def key_visuals(frames: DataFrame, top: int = 30) -> DataFrame:
    """Per meeting the ``top`` frames of relevance 2 or more, most relevant first, then earliest."""
    order = Window.partitionBy("meeting_id").orderBy(F.desc("relevance"), "t", "frame_id")
    return frames.filter("relevance >= 2").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top).select("meeting_id", "frame_id", "t", "relevance")


def vote_top_name(votes: DataFrame) -> DataFrame:
    """Per meeting and label the name with most votes; of equals the one with the earliest evidence."""
    tally = votes.groupBy("meeting_id", "label", "name").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t"))
    return tally.groupBy("meeting_id", "label").agg(F.min_by("name", F.struct(-F.col("n"), F.col("t"), F.col("name"))).alias("name"), F.max("n").alias("n"))


LIVE = ["deleting", "cancelled"]


def stage_rows(meetings: DataFrame, stages: DataFrame) -> DataFrame:
    """Every meeting with every stage in order; a stage without a row is pending. stages: meeting_id, stage, status, permille.

    A meeting is dealt once, by its id, and its stages are made where it lands. They meet its rows by the id and then by
    place, so neither the grid nor the result is dealt again for what joins or groups by meeting.
    """
    names = F.array(*map(F.lit, STAGES))
    given = stages.select("meeting_id", F.array_position(names, F.col("stage")).alias("__at"), "status", "permille").filter("__at > 0")
    grid = meetings.select("meeting_id").repartition("meeting_id").select("meeting_id", F.posexplode(names).alias("ord", "stage"))
    # A difference, as an equality would become a key of the join and deal the grid by stage as well.
    here = (F.col("g.meeting_id") == F.col("s.meeting_id")) & (F.col("g.ord") - F.col("s.__at") == -1)
    rows = grid.alias("g").join(given.alias("s"), here, "left")
    return rows.select("g.meeting_id", "ord", "stage", F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("permille", F.lit(0)).alias("permille"))


def listing(meetings: DataFrame, stages: DataFrame) -> DataFrame:
    """Live meetings with progress, the stage they are at and their place in their owner's list, newest first, then by id."""
    live = meetings.filter(~F.col("status").isin(LIVE))
    order = Window.partitionBy("owner_id").orderBy(F.desc("created"), "meeting_id")
    rows = live.withColumn("place", F.row_number().over(order))
    return rows.join(progress(stage_rows(live, stages)), "meeting_id", "left").select("meeting_id", "owner_id", "place", (F.col("everyone").isNotNull()).alias("shared"), "at_stage", F.floor("progress").cast("long").alias("progress"))


def totals(meetings: DataFrame) -> DataFrame:
    """Per owner: live meetings, those being worked on, those shared with everyone, and the sum of their lengths."""
    live = meetings.filter(~F.col("status").isin(LIVE))
    n = lambda c: F.count(F.when(c, 1))
    return live.groupBy("owner_id").agg(F.count(F.lit(1)).alias("n"), n(F.col("status").isin("queued", "running")).alias("busy"), n(F.col("everyone").isNotNull()).alias("shared"), F.coalesce(F.sum("length_ms"), F.lit(0)).alias("length_ms"))


def next_meetings(meetings: DataFrame, retries: DataFrame, now: Column, key: str) -> DataFrame:
    """For each worker's ``key`` the meeting to work on next: the first in the order of ``queue`` whose time to try again, if it
    is paused and has one, has come. retries: meeting_id, retry_at; the least counts."""
    due = retries.groupBy("meeting_id").agg(F.min("retry_at").alias("retry_at"))
    rank = F.when(F.col("status") == "running", 0).when(F.col("status") == "queued", 1).when(F.col("status") == "paused", 2)
    rows = meetings.withColumn("rank", rank).filter("rank IS NOT NULL").join(due, "meeting_id", "left")
    rows = rows.filter((F.col("rank") < 2) | F.col("retry_at").isNull() | (F.col("retry_at") <= now))
    return rows.groupBy(key).agg(F.min_by(F.struct("meeting_id", "status"), F.struct("rank", "created", "meeting_id")).alias("m")).select(key, "m.meeting_id", "m.status")


def queue_stats(meetings: DataFrame, uploads: DataFrame) -> DataFrame:
    """One row: queued meetings, open uploads, and the bytes that open uploads still need (unknown ones count as none)."""
    q = meetings.agg(F.count(F.when(F.col("status").isin("running", "queued", "paused"), 1)).alias("queued"))
    left = F.greatest(F.lit(0), F.col("size") - F.coalesce("received", F.lit(0)))
    u = uploads.agg(F.count(F.when(F.col("open"), 1)).alias("uploads"), F.coalesce(F.sum(F.when(F.col("open"), left)), F.lit(0)).alias("reserved"))
    return q.crossJoin(u)  # one row each


def phase(status: Column, paused: Column) -> Column:
    """What is shown of a meeting: failed before paused before done before running before queued."""
    return F.when(status == "failed", "failed").when(paused | (status == "paused"), "paused").when(status == "done", "done").when(status == "running", "running").otherwise("queued")


def allowed(access: Column, need: str) -> Column:
    rank = lambda c: F.coalesce(F.array_position(F.array(*map(F.lit, ("view", "edit", "owner"))), c), F.lit(0))
    return rank(access) >= rank(F.lit(need))


def shown(meetings: DataFrame, query: str) -> DataFrame:
    """Meetings (meeting_id, title, gist, names) of which title, gist and names together hold every word of the query."""
    text = F.lower(F.concat_ws(" ", "title", "gist", F.array_join("names", " ")))
    found = meetings
    for w in query.lower().split():
        found = found.filter(F.contains(text, F.lit(w)))
    return found.select("meeting_id")


def palette(meetings: DataFrame, query: str, most: int = 8) -> DataFrame:
    """The newest ``most`` meetings whose title holds every word of the query."""
    found = meetings
    for w in query.lower().split():
        found = found.filter(F.contains(F.lower("title"), F.lit(w)))
    return found.orderBy(F.desc("created"), "meeting_id").limit(most).select("meeting_id")


def labels(*sources: DataFrame) -> DataFrame:
    """Per meeting the labels of all sources (meeting_id, speaker), each once, in natural order: place from 1."""
    every = sources[0].select("meeting_id", "speaker")
    for s in sources[1:]:
        every = every.unionByName(s.select("meeting_id", "speaker"))
    from parley.functions.words import label_order

    order = Window.partitionBy("meeting_id").orderBy(*label_order(F.col("speaker")))
    every = every.filter("speaker is not null").distinct()
    return every.select("meeting_id", "speaker", F.row_number().over(order).alias("place"))


def subset_position(lines: DataFrame, active: DataFrame, hidden: list[str]) -> DataFrame:
    """Where a meeting's active line stands among the lines of speakers that aren't hidden, from 0; -1 if it is hidden itself."""
    seen = lines.filter(~F.col("speaker").isin(hidden))
    order = Window.partitionBy("meeting_id").orderBy("start_ms", "line_id")
    placed = seen.select("meeting_id", "line_id", (F.row_number().over(order) - 1).alias("place"))
    return active.join(placed, ["meeting_id", "line_id"], "left").select("meeting_id", "line_id", F.coalesce("place", F.lit(-1)).alias("place"))


def retention(meetings: DataFrame, today: Column, days: int) -> DataFrame:
    """Meetings whose video may go: done, not deleted, with a video (unknown: by their mode), finished ``days`` ago or more.

    A negative number of days keeps all. finished is the latest end of their stages.
    """
    if days < 0:
        return meetings.limit(0).select("meeting_id")
    video = (F.col("has_video") == 1) | (F.col("has_video").isNull() & (F.col("mode") == "video"))
    return meetings.filter((F.col("status") == "done") & F.col("deleted").isNull() & video & (F.datediff(today, F.col("finished")) >= days)).select("meeting_id")


def stale_uploads(uploads: DataFrame, today: Column, days: int = 7) -> DataFrame:
    return uploads.filter(F.col("open") & (F.datediff(today, F.col("touched")) > days)).select("upload_id")


def interrupted(stored: DataFrame, active: DataFrame) -> DataFrame:
    """Stored uploads that aren't going on, newest first: place from 1 per user."""
    order = Window.partitionBy("user_id").orderBy(F.desc("created"), "upload_id")
    return stored.join(active.select("upload_id"), "upload_id", "left_anti").select("upload_id", "user_id", F.row_number().over(order).alias("place"))


def invites(rows: DataFrame, users: DataFrame, now: Column, most: int = 200) -> DataFrame:
    """Every inviter's newest ``most`` invitations with their state and the names of who sent and who used them."""
    order = Window.partitionBy("by_user").orderBy(F.desc("created"), F.desc("invite_id"))
    rows = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    name = lambda key, out: users.select(F.col("user_id").alias(key), F.col("name").alias(out))
    rows = rows.join(name("by_user", "sender"), "by_user", "left").join(name("used_by", "guest"), "used_by", "left")
    state = invite_state(F.col("used_by"), F.col("revoked"), F.col("expires"), now)
    return rows.select("invite_id", "place", "sender", "guest", state.alias("state"), state.isin("pending", "expired").alias("waiting"))


def sessions(rows: DataFrame, users: DataFrame, now: Column, current: int) -> DataFrame:
    """Valid sessions of users that aren't disabled: the current one first, then by last use; place from 1 per user."""
    live = rows.filter(F.col("expires") > now).join(users.filter("disabled is null").select("user_id"), "user_id")
    order = Window.partitionBy("user_id").orderBy((F.col("session_id") != current).cast("int"), F.desc("seen"), "session_id")
    return live.select("session_id", "user_id", F.row_number().over(order).alias("place"))


def people_order(users: DataFrame) -> DataFrame:
    """Users with sort_name (lower case, the address without a name) and inviter: a place among those of their group, admins first."""
    sort = F.lower(F.coalesce(F.nullif("name", F.lit("")), "email"))
    order = Window.partitionBy("team").orderBy(F.desc("admin"), sort, "user_id")
    inviter = users.select(F.col("user_id").alias("invited_by"), F.col("name").alias("inviter"))
    return users.withColumn("place", F.row_number().over(order)).join(inviter, "invited_by", "left").select("user_id", "place", "inviter")


def gates(parts: DataFrame) -> DataFrame:
    """Whether a meeting goes on: at most 5 % of its segments and at most half of its frames and sections may fail.

    parts: meeting_id, kind (segment, frame, section), failed.
    """
    n = lambda c: F.count(F.when(c, 1))
    bad = lambda kind, permille: 1000 * n((F.col("kind") == kind) & F.col("failed")) > permille * n(F.col("kind") == kind)
    return parts.groupBy("meeting_id").agg(bad("segment", 50).alias("stt_failed"), bad("frame", 500).alias("frames_failed"), bad("section", 500).alias("notes_failed"))


def grouped_hits(hits: DataFrame) -> DataFrame:
    """Meetings in the order of their best hit, with their numbers of hits. hits: meeting_id, source (0 transcript, 1 frames), rank."""
    by = hits.groupBy("meeting_id").agg(F.min(F.struct("source", "rank")).alias("first"), F.count(F.lit(1)).alias("n_hits"))
    return by.select("meeting_id", "n_hits", F.col("first.source").alias("source"), F.col("first.rank").alias("rank"))


def next_stage(rows: DataFrame, audio: Column) -> DataFrame:
    """The first stage of a meeting that isn't done; in audio mode moments and frames are skipped. None left: done."""
    todo = (F.col("status") != "done") & ~(audio & F.col("stage").isin("moments", "frames")) & (F.col("status") != "skipped")
    return rows.groupBy("meeting_id").agg(F.coalesce(F.min_by("stage", F.when(todo, F.col("ord"))), F.lit("done")).alias("next"))


def rerun(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Stage rows after a rerun from a chosen stage (meeting_id, stage): it and all later ones are pending again."""
    from_ = chosen.select("meeting_id", (F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")) - 1).alias("from_ord"))
    again = F.coalesce(F.col("ord") >= F.col("from_ord"), F.lit(False))
    out = rows.join(from_, "meeting_id", "left")
    return out.select("meeting_id", "ord", "stage", F.when(again, "pending").otherwise(F.col("status")).alias("status"), F.when(again, 0).otherwise(F.col("permille")).alias("permille"))


def capable(entries: DataFrame) -> DataFrame:
    """Models with the capability in any entry: their best status and the name of the last entry that has it.

    entries: model, seq, name, status, capable.
    """
    some = entries.join(entries.filter("capable").select("model").distinct(), "model")
    best = best_status(some).withColumnRenamed("status", "best")
    return some.join(best, "model").filter("status = best").groupBy("model").agg(F.max_by("name", "seq").alias("name"), F.first("best").alias("status"))


def usable(status: Column) -> Column:
    return status.isin("ready", "degraded")


def blocked(needed: DataFrame, statuses: DataFrame) -> DataFrame:
    """(meeting_id, model, reason) of meetings that have to wait: the first of their models, by name, that can't be used, and why.

    needed: meeting_id, model; statuses: model, status; a model without one is missing.
    """
    rows = needed.join(statuses, "model", "left").withColumn("status", F.coalesce("status", F.lit("missing"))).filter(~usable(F.col("status")))
    rows = rows.groupBy("meeting_id").agg(F.min(F.struct("model", "status")).alias("m")).select("meeting_id", "m.*")
    at = lambda before, after="": F.concat(F.lit(before), "model", F.lit(after))
    reason = F.when(F.col("status") == "unknown", at("STT paused: llm-proxy catalog unreachable (model ", ")")).when(F.col("status") == "missing", at("STT model ", " is missing from llm-proxy"))
    return rows.select("meeting_id", "model", reason.otherwise(F.concat(at("STT model ", " is "), "status", F.lit(" in llm-proxy"))).alias("reason"))


def run_figures(runs: DataFrame) -> DataFrame:
    """(run, rtf, minutes_per_hour, peak_mib) of runs (run, wall_s, duration_s, peak_bytes): time spent for each second and hour of
    sound, and the largest memory. Without sound the first two are null."""
    ratio = F.col("wall_s") / F.nullif("duration_s", F.lit(0.0))
    return runs.select("run", F.round(ratio, 4).alias("rtf"), F.round(ratio * 60, 2).alias("minutes_per_hour"), F.round(F.col("peak_bytes") / 2**20).cast("long").alias("peak_mib"))


def worker_detail(meetings: DataFrame, user: int) -> DataFrame:
    """What the worker says of its meeting, for the meeting's owner alone; others see that it is busy."""
    own = F.col("owner_id") == user
    return meetings.filter("status = 'running'").select("meeting_id", F.when(own, F.col("title")).otherwise("busy").alias("detail"))


def settings(defaults: dict[str, int], overrides: DataFrame) -> DataFrame:
    """Known settings (name, value): an override that reads as a number counts, a blank or unknown one doesn't."""
    spark = overrides.sparkSession
    base = spark.createDataFrame(list(defaults.items()), "name string, value long")
    given = overrides.select("name", F.trim("value").try_cast("long").alias("given")).filter("given is not null")
    return base.join(given, "name", "left").select("name", F.coalesce("given", "value").alias("value"))


def poster(frames: DataFrame) -> DataFrame:
    """A meeting's first frame of some relevance, else its first frame."""
    return cover_frame(frames)

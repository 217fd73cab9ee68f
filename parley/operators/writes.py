"""Writes as merges: every function maps the old table and the changes to the new table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.plans.joins import row_hash


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], fill: Sequence[str] = ()) -> DataFrame:
    """``new`` replaces rows of equal keys; a column of ``fill`` keeps the old value unless that is null."""
    o, n = old.withColumn("__o", F.lit(True)).alias("o"), new.withColumn("__n", F.lit(True)).alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    both = o.join(n, on, "full")
    pick = lambda c: F.coalesce(f"o.{c}", f"n.{c}") if c in fill else F.when(F.col("n.__n"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*[pick(c).alias(c) for c in old.columns])


def insert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.unionByName(new.join(old, list(keys), "left_anti").select(*old.columns))


def next_version(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` with version: one above the old row's, 1 without one; other old rows stay."""
    versions = old.select(key, F.col("version").alias("__v"))
    fresh = new.join(versions, key, "left").withColumn("version", F.coalesce("__v", F.lit(0)) + 1).select(*old.columns)
    return old.join(new, key, "left_anti").select(*old.columns).unionByName(fresh)


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, key: str, unlinked: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """``tables`` without the rows of the keys in ``gone``; those named in ``unlinked`` keep their rows and lose the link."""
    keys = gone.select(F.col(key).alias("__gone")).distinct()
    out = {}
    for name, t in tables.items():
        if name in unlinked:
            both = t.join(keys, F.col(key) == F.col("__gone"), "left")
            out[name] = both.withColumn(key, F.when(F.col("__gone").isNull(), F.col(key))).select(*t.columns)
        else:
            out[name] = t.join(keys, F.col(key) == F.col("__gone"), "left_anti").select(*t.columns)
    return out


def snapshot_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): new, changed or deleted, by the hash of a row's other columns, in which nulls count."""
    digest = lambda df: row_hash(df.drop(key))
    o, n = old.select(F.col(key).alias("ko"), digest(old).alias("ho")), new.select(F.col(key).alias("kn"), digest(new).alias("hn"))
    both = o.join(n, F.col("ko") == F.col("kn"), "full")
    change = F.when(F.col("ko").isNull(), "new").when(F.col("kn").isNull(), "deleted").when(F.col("ho") != F.col("hn"), "changed")
    return both.select(F.coalesce("ko", "kn").alias(key), change.alias("change")).filter("change is not null")


def reconcile(old: DataFrame, new: DataFrame) -> DataFrame:
    """Segments after a new segmentation: (segment_id, verdict) with verdict kept, in flight, retry, pending; and stale.

    Both: segment_id, speaker, start_ms, end_ms, sha; old also status and job. Of old duplicates the last counts.
    """
    match = ["speaker", "start_ms", "end_ms", "sha"]
    last = old.groupBy(*match).agg(F.max(F.struct("segment_id", "status", "job")).alias("old"))
    both = new.join(last, match, "full")
    old_status = F.col("old.status")
    verdict = (
        F.when(F.col("segment_id").isNull(), "stale")
        .when(F.col("old").isNull(), "pending")
        .when(old_status == "done", "kept")
        .when((old_status == "submitted") & F.col("old.job").isNotNull(), "in flight")
        .when(old_status.isin("failed", "cancelled"), "retry")
        .otherwise("pending")
    )
    return both.select(F.coalesce("segment_id", "old.segment_id").alias("segment_id"), verdict.alias("verdict"))


def with_stages(meetings: DataFrame, stages: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """New meetings and one pending row per stage of each."""
    rows = meetings.select("meeting_id", F.posexplode(F.array(*map(F.lit, stages))).alias("ord", "stage"))
    return meetings, rows.withColumn("status", F.lit("pending"))


def appended_events(log: DataFrame, events: DataFrame, most: int = 2000) -> DataFrame:
    """The log with new events behind it, their messages cut to ``most`` characters."""
    return log.unionByName(events.withColumn("message", F.substring("message", 1, most)).select(*log.columns))


def replace_partition(old: DataFrame, new: DataFrame, key: str, gone: DataFrame | None = None) -> DataFrame:
    """All rows of the keys in ``new`` are replaced; keys in ``gone`` lose theirs even without new ones."""
    keys = new.select(key) if gone is None else new.select(key).unionByName(gone.select(key))
    return old.join(keys.distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def guarded_update(old: DataFrame, changes: DataFrame, key: str, column: str, state: str) -> DataFrame:
    """``column`` set to the changes' value where the row's status is ``state``; others stay."""
    new = changes.select(key, F.col(column).alias("__new"), F.lit(True).alias("__there"))
    value = F.when(F.col("__there") & (F.col("status") == state), F.col("__new")).otherwise(F.col(column))
    return old.join(new, key, "left").select(*[value.alias(c) if c == column else F.col(c) for c in old.columns])


def remapped(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``key`` replaced by way of ``ids`` (old, new) in one step: no row meets an id that another is leaving. Others stay."""
    out = rows.join(ids, F.col(key) == F.col("old"), "left")
    return out.select(*[F.coalesce("new", key).alias(c) if c == key else F.col(c) for c in rows.columns])


def without_person(meetings: DataFrame, person: int, heir: int | None) -> DataFrame:
    """Meetings after a person is removed: theirs go to the heir, or go altogether."""
    if heir is None:
        return meetings.filter(~F.col("owner_id").eqNullSafe(F.lit(person)))
    return meetings.withColumn("owner_id", F.when(F.col("owner_id") == person, heir).otherwise(F.col("owner_id")))


def superseded(invites: DataFrame, fresh: DataFrame) -> DataFrame:
    """Invitations with ``revoked``: pending ones to an address that is invited anew are revoked at that time; a date already there stays."""
    again = fresh.groupBy("email").agg(F.min("created").alias("at"))
    out = invites.join(again, "email", "left")
    pending = F.col("used_by").isNull() & F.col("at").isNotNull() & (F.col("created") < F.col("at"))
    return out.select(*[F.coalesce("revoked", F.when(pending, F.col("at"))).alias(c) if c == "revoked" else F.col(c) for c in invites.columns])


def renewed(tokens: DataFrame, fresh: DataFrame, key: str = "user_id", used: str = "used_at") -> DataFrame:
    """One-time tokens after ``fresh`` ones were issued: earlier ones of the same user that weren't used are gone."""
    again = fresh.select(F.col(key).alias("__key")).distinct()
    stale = tokens.join(again, F.col(key) == F.col("__key"), "left").withColumn("__again", F.col("__key").isNotNull())
    return stale.filter(~(F.col("__again") & F.col(used).isNull())).select(*tokens.columns).unionByName(fresh.select(*tokens.columns))


def guard_last_admin(users: DataFrame, changes: DataFrame) -> DataFrame:
    """Users after ``changes`` (user_id, admin, active); refused if no active admin of the team would be left.

    Each team's changes count together; a team that would lose its last active admin keeps all its rows.
    """
    after = users.join(changes.select("user_id", F.col("admin").alias("a"), F.col("active").alias("b")), "user_id", "left")
    after = after.withColumns({"a": F.coalesce("a", "admin"), "b": F.coalesce("b", "active")})
    left = after.groupBy("team").agg(F.count(F.when(F.col("a") & F.col("b"), 1)).alias("left"))
    out = after.join(left, "team")
    keep = F.col("left") > 0
    return out.select("user_id", "team", F.when(keep, F.col("a")).otherwise(F.col("admin")).alias("admin"), F.when(keep, F.col("b")).otherwise(F.col("active")).alias("active"))


def merge_speakers(rows: DataFrame, merges: DataFrame, others: str | None = None) -> DataFrame:
    """Rows with label source of a meeting under label target (merges: meeting_id, source, target); ``others`` names an
    array column of labels that is rewritten too, each label once, in its order."""
    to = merges.select(F.col("meeting_id").alias("__m"), F.col("source").alias("__s"), F.col("target").alias("__t"))
    out = rows.join(to, (F.col("meeting_id") == F.col("__m")) & (F.col("speaker") == F.col("__s")), "left")
    out = out.withColumn("speaker", F.coalesce("__t", "speaker")).select(*rows.columns)
    if others is None:
        return out
    map_ = merges.groupBy(F.col("meeting_id").alias("__m")).agg(F.map_from_entries(F.collect_list(F.struct("source", "target"))).alias("__map"))
    out = out.join(map_, F.col("meeting_id") == F.col("__m"), "left")
    new = F.array_distinct(F.transform(others, lambda x: F.coalesce(F.element_at("__map", x), x)))
    return out.withColumn(others, F.coalesce(new, others)).select(*rows.columns)

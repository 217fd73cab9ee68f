"""Small rules on hand-made cases, and changes through several tables."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from parley.functions import wording
from parley.operators import people


def each(spark, values, kind, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_titles(spark):
    cases = {
        "Discussion with Sales Team-20230208_145424-Meeting Recording.mp4": "Discussion with Sales Team", "GMT20240102-101112_Recording_1920x1080.mp4": "Recording",
        "infra-weekly.mp4": "Infra weekly", "q4.roadmap.webm": "Q4 roadmap", "Standup 2024-05-06 09-30.m4a": "Standup", "a.mp4": "a", "Board - - review.mp4": "Board – review", "x": "x", ".mp4": ".mp4",
        "weekly_sync_recording 2.mp3": "Weekly sync", "Plan 2025.docx": "Plan 2025",
    }
    assert each(spark, [*cases, None], "string", wording.title) == [*cases.values(), None]


def test_dates(spark):
    now = datetime(2025, 9, 22, 9, 30)
    at = lambda f: lambda c: f(c, F.lit(now))
    times = [now - timedelta(minutes=16), now - timedelta(days=1), datetime(2025, 9, 12), datetime(2024, 9, 12), None]
    assert each(spark, times, "timestamp", at(wording.spoken_date)) == ["Today 09:14", "Yesterday", "12 Sep", "12 Sep 2024", ""]
    times = [now + timedelta(hours=1), now - timedelta(seconds=89), now - timedelta(seconds=90), now - timedelta(hours=3), now - timedelta(hours=25), now - timedelta(days=4), now - timedelta(days=10), None]
    assert each(spark, times, "timestamp", at(wording.ago)) == ["Just now", "Just now", "2 min ago", "3 h ago", "Yesterday", "4 days ago", "12 Sep", ""]
    times = [now, now + timedelta(seconds=10), now + timedelta(minutes=20), now + timedelta(hours=47), now + timedelta(days=6), None]
    assert each(spark, times, "timestamp", at(wording.left)) == ["", "in 1 min", "in 20 min", "in 47 h", "in 6 days", ""]


def test_passwords_and_names(spark):
    values = ["", None, "abcdefg", "abc", "aaaaaaaaa", "Password1!", "abcdefgh", "abcdefg1", "long enough words", "Abcdefgh1234"]
    got = each(spark, values, "string", wording.password_strength)
    assert [tuple(g) for g in got] == [
        (0, "At least 8 characters"), (0, "At least 8 characters"), (0, "1 more character"), (0, "5 more characters"), (1, "Easy to guess"), (1, "Easy to guess"), (1, "Could be stronger"), (2, "Good"), (3, "Strong"), (3, "Strong"),
    ]
    assert each(spark, [" A\x07nn \t  Lee ", None, "x" * 99], "string", wording.clean_name) == ["Ann Lee", "", "x" * 80]


def test_uploads_and_ranges(spark):
    raw = [{"filename": r"C:\a\talk.mp4", "language": "en-GB", "expected_speakers": " 3 "}, {}, {"filename": ".mp4", "title": " T ", "language": "auto", "expected_speakers": "9"}, {"language": "english", "expected_speakers": "x"}]
    got = [tuple(g) for g in each(spark, raw, "map<string,string>", wording.upload_details)]
    assert got == [
        ("talk.mp4", "talk", "en-GB", 3, None), ("recording", "recording", None, None, None),
        (".mp4", "T", None, None, "expected_speakers must be between 1 and 8."), ("recording", "recording", None, None, "expected_speakers must be a number."),
    ]
    headers = [None, "bytes=0-9", "bytes=90-", "bytes=-5", "bytes=-500", "bytes=100-", "bytes=9-3", "bytes=-", "bytes=5-900", "items=1-2", "bytes=-0"]
    got = each(spark, headers, "string", lambda h: wording.byte_range(h, F.lit(100).cast("long")))
    assert [g and tuple(g) for g in got] == [(0, 99), (0, 9), (90, 99), (95, 99), (0, 99), None, None, None, (5, 99), None, None]


def test_statuses(spark):
    lists = [{"m": "ready"}, {"m": {"status": "off"}}, {"notes": {"model": "m", "status": "busy"}}, {"notes": {"model": "n", "status": "busy"}, "m": "ready"}, {"notes": {"status": "open"}}, {"x": "ready"}, {}, [], {"m": {"status": 4}}]
    got = each(spark, [json.dumps(x) for x in lists], "string", lambda c: wording.model_status(F.parse_json(c), F.lit("m"), F.lit("notes")))
    assert got == ["ready", "off", "busy", "ready", "open", "missing", "unknown", "unknown", "missing"]
    reasons = ["LLM-proxy catalog unreachable: x", "model disabled in llm-proxy", "quota", None]
    assert each(spark, reasons, "string", lambda c: wording.pause_message(F.lit("transcribe"), c, F.lit(None))) == ["Speech service unavailable.", "Speech model unavailable.", "Waiting to resume.", "Waiting to resume."]
    assert each(spark, reasons[1:2], "string", lambda c: wording.pause_message(F.lit("notes"), F.lit(""), c)) == ["Processing model unavailable."]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_person_removed(spark):
    frame = spark.createDataFrame
    tables = {
        "meetings": frame([(1, 7, "done"), (2, 7, "deleting"), (3, 8, "done"), (4, None, "done")], "meeting_id int, owner_id int, status string"),
        "shares": frame([(1, 9), (1, 8), (3, 7), (3, 9), (2, 8)], "meeting_id int, user_id int"),
        "uploads": frame([(1, 7), (2, 8)], "upload int, owner_id int"),
        "users": frame([(7, None), (8, 7), (9, 8)], "user_id int, invited_by int"),
        "sessions": frame([("a", 7), ("b", 8)], "id string, user_id int"),
    }
    given = people.removed(tables, 7, 8)
    assert rows(given["meetings"]) == rows(frame([(1, 8, "done"), (2, 8, "deleting"), (3, 8, "done"), (4, None, "done")], tables["meetings"].schema))
    assert rows(given["shares"]) == [(1, 9), (3, 9)]
    assert rows(given["uploads"]) == [(1, 8), (2, 8)] and rows(given["users"]) == [(8, None), (9, 8)] and rows(given["sessions"]) == [("b", 8)]
    gone = people.removed(tables, 7, 8, transfer=False)
    assert (1, 7, "deleting") in rows(gone["meetings"]) and (3, 8, "done") in rows(gone["meetings"])
    assert rows(gone["shares"]) == [(1, 8), (1, 9), (2, 8), (3, 9)]


def test_speakers_merged(spark):
    frame = spark.createDataFrame
    merges = frame([(1, "S2", "S1"), (1, "S3", "S1"), (2, "S1", "S9")], "meeting_id int, source string, target string")
    segments = frame([(1, "S2", [(0, 5, "S3"), (6, 7, "S4")]), (2, "S2", [(0, 1, "S1")]), (3, "S2", None)], "meeting_id int, speaker string, said array<struct<start_ms:int,end_ms:int,speaker:string>>")
    got = {r.meeting_id: (r.speaker, r.said and [x.speaker for x in r.said]) for r in people.relabelled(segments, merges, said="said").collect()}
    assert got == {1: ("S1", ["S1", "S4"]), 2: ("S2", ["S9"]), 3: ("S2", None)}
    speakers = frame([(1, "S1", None, "Al", None), (1, "S2", "Bo", "B", 5), (1, "S3", "Cy", None, 9), (2, "S1", "Di", None, None), (3, "S2", "Ed", None, None)], "meeting_id int, label string, display_name string, suggested_name string, evidence_t int")
    assert rows(people.merged_speakers(speakers, merges)) == [(1, "S1", "Bo", "Al", 5), (2, "S9", "Di", None, None), (3, "S2", "Ed", None, None)]
    notes = frame([(1, [("S2", "do"), (None, "x")], [("S3", "Cy"), ("S1", "Al")]), (3, [("S2", "y")], [])], "meeting_id int, action_items array<struct<owner:string,task:string>>, speaker_suggestions array<struct<label:string,name:string>>")
    after = {r.meeting_id: ([a.owner for a in r.action_items], [s.label for s in r.speaker_suggestions]) for r in people.notes_after_merge(notes, merges).collect()}
    assert after == {1: (["S1", None], ["S1"]), 3: (["S2"], [])}


def test_cascade_tokens_models_and_frames(spark):
    from parley.operators import exports, library, writes

    frame = spark.createDataFrame
    tables = {"lines": frame([(1, "a"), (2, "b")], "meeting_id int, x string"), "uploads": frame([(1, "u"), (2, "v"), (None, "w")], "meeting_id int, x string")}
    out = writes.cascade_delete(tables, frame([(1,), (1,)], "meeting_id int"), "meeting_id", unlinked=("uploads",))
    assert rows(out["lines"]) == [(2, "b")] and rows(out["uploads"]) == [(2, "v"), (None, "u"), (None, "w")]
    tokens = frame([("a", 1, None), ("b", 1, 5), ("c", 2, None), ("d", None, None)], "token string, user_id int, used_at int")
    assert rows(writes.renewed(tokens, frame([("e", 1, None)], tokens.schema))) == [("b", 1, 5), ("c", 2, None), ("d", None, None), ("e", 1, None)]
    needed = frame([(1, "b"), (1, "a"), (2, "c"), (3, "d"), (4, "e")], "meeting_id int, model string")
    got = rows(library.blocked(needed, frame([("a", "ready"), ("b", "off"), ("c", "degraded"), ("d", "unknown")], "model string, status string")))
    assert got == [(1, "b", "STT model b is off in llm-proxy"), (3, "d", "STT paused: llm-proxy catalog unreachable (model d)"), (4, "e", "STT model e is missing from llm-proxy")]
    runs = frame([("x", 12.0, 600.0, 3 << 20), ("y", 1.0, 0.0, None)], "run string, wall_s double, duration_s double, peak_bytes long")
    assert rows(library.run_figures(runs)) == [("x", 0.02, 1.2, 3), ("y", None, None, None)]
    made = frame([(1, "é", None)], "id int, status string, progress double").select(exports.event_frame(F.lit("meeting"), F.struct("id", "status", "progress"))).first()[0]
    assert made == 'event: meeting\ndata: {"id":1,"status":"é","progress":null}\n\n'

"""Queries on small tables made to differ where they once did, against their SQL in DuckDB."""

import random
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from parley import registry
from parley.functions import loose, words
from parley.operators import context, diarize, fulltext, intervals, moments, segments

DAY = datetime(2024, 1, 1)


def written_events(folder, rows):
    """events of (event_id, seconds from the start of a day, user_id, value)."""
    ids, at, users, values = zip(*rows, strict=True)
    kinds, props = ["view"] * len(rows), ["{}"] * len(rows)
    ts = pa.array([None if s is None else DAY + timedelta(seconds=s) for s in at], pa.timestamp("us"))
    table = pa.table({"event_id": pa.array(ids, pa.int64()), "ts": ts, "user_id": pa.array(users, pa.int64()), "event_type": kinds, "value": pa.array(values, pa.float64()), "props": props})
    pq.write_table(table, folder / "events.parquet")
    return str(folder)


def same_as_sql(spark, folder, name, *tables):
    got = registry.QUERIES[name](spark, folder)
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.sql(registry.ORACLE_SQL[name])
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    at = [want.columns.index(n) for n in names]
    rows = Counter(tuple(r[n] for n in names) for r in got.collect())
    assert rows == Counter(tuple(r[i] for i in at) for r in want.fetchall())
    return rows


def test_clip_names_of_long_ids(spark, tmp_path):
    rows = same_as_sql(spark, written_events(tmp_path, [(7, 60, 1, 1.0), (182469, 120, 2, 2.5), (99999, 3600, 3, 0.0)]), "retry_key_bump", "events")
    assert {r[0] for r in rows} == {"00007_000010000_000011000", "18246_000020000_000022500", "99999_000600000_000600000"}


def test_preview_of_lines_that_begin_together(spark, tmp_path):
    # The lines 1 and 2 begin together; the one that ends later has the smaller id. SQL leaves open which one counts.
    folder = written_events(tmp_path, [(1, 60, 1, 9.0), (2, 60, 2, 8.0), (3, 300, 3, 1.0)])
    rows = registry.QUERIES["hover_preview"](spark, folder).collect()
    assert {r.point_id: r.speaker for r in rows} == {1: "S3", 2: "S3", 3: "S4"}


def test_preview_of_odd_points(spark, tmp_path):
    # Rows that stand twice, one without a time, one without a user, one without an end, one without an id: each gives its row.
    rows = [(9, 60, 1, 9.0), (40, 61, 2, 1.0), (3, 62, 3, 1.0), (3, 62, 3, 1.0), (4, None, 4, 1.0), (5, 63, None, 7.0), (6, 64, 6, None), (None, 65, 7, 1.0), (36, None, 4, 1.0), (80, None, 5, 1.0)]
    found = same_as_sql(spark, written_events(tmp_path, rows), "hover_preview", "events")
    names = sorted(["meeting_id", "point_id", "frame_id", "speaker", "chapter"])
    assert sum(found.values()) == len(rows) and sum(n for r, n in found.items() if r[names.index("point_id")] == 3) == 2


def test_turns_in_which_no_other_talks(spark, tmp_path):
    # Of two channels: frames 0 to 10 the first alone, 20 to 30 both, 40 to 43 the second alone.
    on = [range(0, 10), range(40, 43)]
    vectors = [[0.2 if t in on[c] or 20 <= t < 30 else -0.2 for c in (0, 1)] + [-0.2] * 62 for t in range(100)]
    pq.write_table(pa.table({"vec_id": list(range(100)), "embedding": pa.array(vectors, pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    rows = same_as_sql(spark, str(tmp_path), "diarization_turns", "embeddings")
    names = sorted(["meeting_id", "speaker", "first", "last", "overlap"])
    assert {(r[names.index("speaker")], r[names.index("first")], r[names.index("overlap")]) for r in rows} == {("S1", 0, True), ("S1", 20, True), ("S2", 20, True), ("S2", 40, True)}
    # Unless asked for, a turn in which no other talks is none of overlap.
    spans = spark.createDataFrame([(0, 1, 0, 10), (0, 1, 20, 30), (0, 2, 20, 30), (0, 2, 40, 41)], "meeting_id long, number int, first long, last long")
    flags = lambda **kind: {(r.speaker, r.first): r.overlap for r in diarize.turns(spans, 2, **kind).collect()}
    want = {("S1", 0): False, ("S1", 20): True, ("S2", 20): True, ("S2", 40): False}
    assert flags() == want and flags(alone=True) == want | {("S1", 0): True}


def test_reasons_are_joined_in_columns_and_in_folds_alike(spark, tmp_path):
    rows = same_as_sql(spark, written_events(tmp_path, [(i, 60 * i, i, 1.0) for i in range(1, 31)]), "speaker_names", "events")
    assert len(rows) == 30
    texts = [None, "", " \u3000", "a b", " b\n", "c", "x" * 498, "\U0001f600" * 499, "y" * 600]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    got = df.select("a", "b", words.joined_columns(F.col("a"), F.col("b")).alias("v")).collect()
    assert len(got) == 81 and [r.v for r in got] == [words.joined(r.a, r.b) for r in got]


def test_near_hashes_up_to_twenty_bits(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    vectors = [[rng.choice((-1.0, 1.0)) for _ in range(64)] for _ in range(60)]
    vectors += [[-x if i < 2 * k else x for i, x in enumerate(vectors[k])] for k in range(14)] + [vectors[3], vectors[3]]
    pq.write_table(pa.table({"vec_id": list(range(len(vectors))), "embedding": pa.array(vectors, pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    monkeypatch.setattr(moments, "BLOCK", 8)  # ten blocks, so most pairs are of two
    rows = same_as_sql(spark, str(tmp_path), "hamming_neardup", "embeddings")
    assert {r[0] for r in rows} >= set(range(60, 71)) and max(r[1] for r in rows) == 20


def test_absorbing_where_thousands_talk_at_once(spark):
    # Each of 20,000 micros lies in each of 20,000 hosts: the first one gets all.
    n = 20_000
    at = spark.range(2 * n).withColumn("host", F.col("id") < n)
    rows = at.select(F.lit("m").alias("meeting_id"), (F.col("id") + 1).alias("island"), F.when(F.col("host"), F.concat(F.lit("h"), F.col("id") % 5)).otherwise("c").alias("speaker"), F.col("id").alias("start_ms"), F.when(F.col("host"), F.col("id") + 10**7).otherwise(F.col("id") + 5).alias("end_ms"))
    got = segments.hosts(rows).groupBy("owner").count().filter("count > 1").collect()
    assert [(r.owner, r["count"]) for r in got] == [(1, n + 1)]


def test_context_where_thousands_of_lines_are_near(spark):
    n = 20_000
    lines = spark.range(n).select(F.lit("m").alias("meeting_id"), F.col("id").alias("line_id"), F.col("id").alias("start_ms"), (F.col("id") + 1000).alias("end_ms"), F.lit(700).cast("long").alias("tokens"))
    got = context.context_lines(lines.select("meeting_id", F.col("line_id").alias("point_id"), F.col("start_ms").alias("t")), lines)
    by = {r.point_id: r.ids for r in got.groupBy("point_id").agg(F.sort_array(F.collect_list("line_id")).alias("ids")).collect()}
    # Of the two ends that are equally far the first line goes: one line more behind a point than before it.
    assert all(by[p] == [i for i in range(p - 1, p + 3) if 0 <= i < n] for p in range(2, n - 2)) and len(by) == n


def test_overlap_where_thousands_talk_at_once(spark):
    n = 20_000
    turns = spark.range(n).select(F.lit("m").alias("meeting_id"), F.col("id").alias("turn_id"), F.concat(F.lit("S"), F.col("id") % 4).alias("speaker"), F.lit(1000).cast("long").alias("start_ms"), F.lit(1007).cast("long").alias("end_ms"))
    odd = spark.createDataFrame([("m", n, None, 0, 5000), ("m", n + 1, "S0", 1005, 1005), ("m", n + 2, "S9", 1005, 1002), ("m", n + 3, "S9", 1004, None)], "meeting_id string, turn_id long, speaker string, start_ms long, end_ms long")
    got = {r.turn_id: (r.shared_ms, r.overlap) for r in intervals.overlap_flag(turns.unionByName(odd.select(*turns.columns))).collect()}
    back = n * -3  # it ends before it starts, inside of all others
    assert got[0] == (7 * 3 * n // 4 - 3, True) and got[n] == (0, False) and got[n + 1] == (0, False) and got[n + 2] == (back, False) and got[n + 3] == (0, False)


def test_index_splits_texts_once(spark, tmp_path, monkeypatch):
    asked, terms = [], fulltext.terms
    monkeypatch.setattr(fulltext, "terms", lambda c: asked.append(c) or terms(c))
    docs = spark.createDataFrame([(1, "Ab c ab"), (2, None)], "doc_id long, text string")
    fulltext.write_index(docs, str(tmp_path))
    rows, sizes = fulltext.read_index(spark, str(tmp_path))
    assert sorted(map(tuple, rows.collect())) == [("ab", 1, 0, 0, 3), ("ab", 1, 0, 2, 3), ("c", 1, 0, 1, 3)]
    assert sorted(map(tuple, sizes.collect())) == [(1, 3), (2, 0)] and len(asked) == 1


def test_loose_json_is_looked_for_once(spark):
    df = spark.createDataFrame([('```json\n{"a": " x "}\n```',), ('so: {"a": 1} bye',), ("none",), (None,)], "text string")
    out = df.select(F.to_json(loose.parsed(F.col("text"))).alias("v"))
    assert out._jdf.queryExecution().analyzed().toString().count("regexp_extract") == 1
    assert [r.v for r in out.collect()] == ['{"a":" x "}', '{"a":1}', None, None]


def test_stages_of_a_meeting_are_dealt_by_its_id_alone(spark):
    """Nulls, unknown stages and meetings, repeated rows; no exchange is by stage, and each table is dealt once."""
    from parley.operators import library

    meetings = spark.createDataFrame([(1,), (2,), (3,), (None,)], "meeting_id long")
    rows = [(1, "prepare", "done", 5), (1, "notes", None, None), (2, "segment", "running", 7), (2, "segment", "done", 8), (2, "odd", "done", 1), (2, None, "done", 1), (9, "prepare", "done", 1), (None, "prepare", "done", 1)]
    stages = spark.createDataFrame(rows, "meeting_id long, stage string, status string, permille long")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = library.rerun(library.stage_rows(meetings, stages), meetings.filter("meeting_id = 2").selectExpr("meeting_id", "'transcribe' AS stage"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = Counter(map(tuple, found.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    want = Counter()
    for (m,) in meetings.collect():
        for o, name in enumerate(library.STAGES):
            mine = [(s, p) for i, n, s, p in rows if i == m is not None and n == name] or [(None, None)]
            want.update((m, o, name, "pending" if m == 2 and o >= library.STAGES.index("transcribe") else s or "pending", 0 if m == 2 and o >= library.STAGES.index("transcribe") else p or 0) for s, p in mine)
    assert got == want
    assert plan.count("Exchange hashpartitioning") == 3 and "hashpartitioning(meeting_id#" in plan and ", stage#" not in "".join(x for x in plan.splitlines() if "Exchange hash" in x)

"""Operators without SQL against plain-Python versions, readers on small files, streams against their batches."""

import base64
import itertools
import json
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley import sources, streaming
from parley.operators import context, errors, intervals, moments
from parley.plans.derive import turns


def halving(n):
    """The order that repeated halving gives, told from its definition: round by round, part by part, what was not yet seen."""
    if n <= 2:
        return list(range(n))
    seen, r = [], 0
    while len(seen) < n and 2**r <= 4 * n:
        for j in range(2**r):
            at = min(math.floor((2 * j + 1) * n / 2 ** (r + 1)), n - 1)
            if at not in seen:
                seen.append(at)
        r += 1
    return seen + [i for i in range(n) if i not in seen]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 30, 97])
def test_spread(spark, n):
    rows = spark.range(n).select("id", moments.spread_rank(F.col("id"), F.lit(n)).alias("turn")).orderBy("turn", "id").collect()
    assert [r.id for r in rows] == halving(n)


def test_select_moments(spark):
    rng = np.random.default_rng(5)
    rows = [("m%d" % (i % 2), int(i * 1000), int(rng.integers(0, 3)), float(rng.integers(1, 9)), None if i % 9 == 0 else f"{int(rng.integers(0, 4)) * 0x1111000011110000 + int(rng.integers(0, 2)):016x}", f"w{i}") for i in range(80)]
    got = moments.select_moments(spark.createDataFrame(rows, "meeting_id string, t long, priority int, weight double, phash string, why string"), 12).collect()
    for m in ("m0", "m1"):
        order = []
        for p in (2, 1, 0):
            some = [r for r in rows if r[0] == m and r[2] == p]
            some.sort(key=(lambda r: (-r[3], r[1])) if p == 1 else (lambda r: r[1]))
            order += some if p == 1 else [some[i] for i in halving(len(some))]
        kept = []
        for r in order:
            if len(kept) == 12:
                break
            twin = next((k for k in kept if r[4] and k[4] and (int(k[4], 16) ^ int(r[4], 16)).bit_count() <= 6), None)
            if twin is None:
                kept.append(list(r))
            elif twin[2] == r[2] == 2:
                twin[5] += f"; {r[5]}"
        assert sorted((k[1], k[5]) for k in kept) == sorted((r.t, r.why) for r in got if r.meeting_id == m)


def test_der(spark):
    rng = np.random.default_rng(7)
    ref = {(f"r{k}", int(f)) for k in range(4) for f in rng.choice(60, 20, replace=False)}
    hyp = {(f"h{(int(r[1]) + (f % 7 == 0)) % 4}", f) for r, f in ref if f % 5} | {("h9", int(f)) for f in rng.choice(60, 9, replace=False)}
    frame = lambda s: spark.createDataFrame([("m", a, f) for a, f in s], "meeting_id string, speaker string, frame long")
    got = errors.der(frame(ref), frame(hyp)).first()
    best = max(sum((r, f) in ref and (h, f) in hyp for r, h in zip(p, ("h0", "h1", "h2", "h3", "h9"), strict=True) for f in range(60)) for p in itertools.permutations(("r0", "r1", "r2", "r3", None)))
    n = lambda s, f: sum(x[1] == f for x in s)
    both = sum(min(n(ref, f), n(hyp, f)) for f in range(60))
    assert tuple(got)[1:] == (len(ref), sum(max(0, n(ref, f) - n(hyp, f)) for f in range(60)), sum(max(0, n(hyp, f) - n(ref, f)) for f in range(60)), both - best)


def test_median_filter_edges(spark):
    active = spark.createDataFrame([("m", "S", f) for f in (5, 9, 10, 11)], "meeting_id string, speaker string, frame long")
    ends = spark.createDataFrame([("m", 30)], "meeting_id string, n_frames long")
    assert sorted(r.frame for r in intervals.median_filter(active, 3, ends).collect()) == [9, 10, 11]
    rng = np.random.default_rng(0)
    x = rng.random(60) < 0.5
    padded = np.r_[[x[0]] * 2, x, [x[-1]] * 2]
    want = [i for i in range(60) if padded[i : i + 5].sum() > 2]
    rows = spark.createDataFrame([("m", "S", int(f)) for f in np.flatnonzero(x)], "meeting_id string, speaker string, frame long")
    assert sorted(r.frame for r in intervals.median_filter(rows, 5, spark.createDataFrame([("m", 60)], "meeting_id string, n_frames long")).collect()) == want


def test_folds(spark, sf_dir):
    t = turns(spark, sf_dir)
    rows = sorted((r.meeting_id, r.start_ms) for r in t.collect())
    want, last = [], {}
    for m, at in rows:
        if m not in last or at - last[m] >= 300_000:
            want.append((m, at))
            last[m] = at
    assert sorted(tuple(r) for r in moments.dedupe_close(t.select("meeting_id", F.col("start_ms").alias("t")), 300_000).collect()) == want
    hits = [(k, i, int(a)) for i, (k, a) in enumerate((i % 3, a) for i, a in enumerate(np.sort(np.random.default_rng(1).integers(0, 4000, 300))))]
    allowed, kept = set(), defaultdict(list)
    for k, i, at in hits:
        kept[k] = [x for x in kept[k] if x > at - 600]
        if len(kept[k]) < 5:
            kept[k].append(at)
            allowed.add(i)
    table = spark.createDataFrame(hits, "key long, hit_id long, at long")
    assert {r.hit_id for r in moments.rate_limit(table, 600, 5).collect() if r.allowed} == allowed
    lines = spark.createDataFrame([("m", i, i * 7000, "w" * (i % 40) + (" " if i % 40 == 0 else "")) for i in range(200)], "meeting_id string, line_id long, start_ms long, text string")
    number, first, total, want = -1, 0, 0, []
    for i in range(200):
        if i % 40 == 0:
            continue
        tokens = math.ceil((i % 40) / 3.5) + 6
        if number < 0 or i * 7000 - first >= 60_000 or total + tokens > 80:
            number, first, total = number + 1, i * 7000, 0
        total += tokens
        want.append((i, number))
    assert sorted((r.line_id, r.window) for r in moments.greedy_windows(lines, 60_000, 80).collect()) == want


def test_context_and_clamped_lines(spark):
    rng = np.random.default_rng(3)
    lines = [("m", i, int(s), None if i % 7 == 0 else int(s + rng.integers(0, 30_000)), int(rng.integers(200, 900))) for i, s in enumerate(np.sort(rng.integers(0, 600_000, 60)))]
    points = [("m", i, int(t)) for i, t in enumerate(rng.integers(0, 600_000, 15))]
    got = defaultdict(set)
    for r in context.context_lines(spark.createDataFrame(points, "meeting_id string, point_id long, t long"), spark.createDataFrame(lines, "meeting_id string, line_id long, start_ms long, end_ms long, tokens long"), most=2000).collect():
        got[r.point_id].add(r.line_id)
    for _, p, t in points:
        near = [x for x in lines if (x[3] or x[2]) >= t - 60_000 and x[2] <= t + 60_000]
        while sum(x[4] for x in near) > 2000:
            near.pop(0 if abs(near[0][2] - t) >= abs(near[-1][2] - t) else -1)
        assert got[p] == {x[1] for x in near}
    chunks = [(1, 0, 1000, 1000, 9000, None, None, "a"), (1, 1, 1000, 1000, 9000, 500, 4000, "b"), (1, 2, 1000, 1000, 9000, 2000, 6000, "c"), (1, 3, 1000, 1000, 9000, 7000, 90_000, " ")]
    out = context.clamped_lines(spark.createDataFrame(chunks, "segment_id long, n long, clip_ms long, lo long, hi long, start_ms long, end_ms long, text string")).orderBy("n").collect()
    assert [(r.start_ms, r.end_ms) for r in out] == [(1000, 9000), (1500, 5000), (5000, 9000)]


def test_sources(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"duration": 10, "segments": [{"speaker": "x", "start": 5, "end": 20}, {"speaker": "y", "start": 1, "end": 2}, {"speaker": "y", "start": 3, "end": 3}, {"speaker": "x", "start": "NaN", "end": 4}]}))
    assert sorted(tuple(r)[1:] for r in sources.diarizer_json(spark, str(tmp_path / "d.json")).collect()) == [("S1", 1.0, 2.0), ("S2", 5.0, 10.0)]
    (tmp_path / "r.rttm").write_text("SPEAKER rec 1 0.50 2.00 <NA> <NA> A <NA> <NA>\nLEXEME rec 1 0 1 x y z\nSPEAKER rec 1 bad 1 <NA> <NA> B <NA>\n")
    assert [tuple(r) for r in sources.rttm(spark, str(tmp_path / "r.rttm")).collect()] == [("rec", "A", 0.5, 2.5)]
    (tmp_path / "s.json").write_text(json.dumps({"text": "all", "segments": [{"start": 0, "end": 1, "text": " hi "}, {"start": 1, "end": 2, "text": " "}]}))
    assert [(r.n, r.text) for r in sources.transcription_json(spark, str(tmp_path / "s.json")).collect()] == [(0, "hi")]
    (tmp_path / "c.json").write_text(json.dumps({"models": [{"id": "m", "status": "OFFLINE", "capabilities": ["transcribe"]}, {"id": "n", "name": "N", "status": "ready"}]}))
    assert [tuple(r) for r in sources.model_catalog(spark, str(tmp_path / "c.json")).collect()] == [("m", 0, "m", "quarantined", True), ("n", 1, "N", "ready", False)]
    (tmp_path / "p.json").write_text(json.dumps({"format": {"duration": "9.5"}, "streams": [{"codec_type": "video", "disposition": {"attached_pic": 1}, "width": 1, "height": 1}, {"codec_type": "video", "width": 640, "height": 360, "duration": "10.5", "tags": {"rotate": "90"}}, {"codec_type": "audio"}]}))
    assert tuple(sources.probe_json(spark, str(tmp_path / "p.json")).first())[1:] == (10.5, True, 360, 640)
    (tmp_path / "log.txt").write_text("frame=1\nout_time_us=5000000\nx time=00:01:40.0 y\n")
    assert [r.permille for r in sources.progress_lines(spark, str(tmp_path / "log.txt"), 100).orderBy("n").collect()] == [50, 1000]
    (tmp_path / "sc.txt").write_text("pts_time:1.5\nlavfi.scene_score=0.25\npts_time:2\npts_time:3\nlavfi.scene_score=0.5\n")
    assert [tuple(r)[1:] for r in sources.scene_scores(spark, str(tmp_path / "sc.txt")).collect()] == [(1.5, 0.25), (3.0, 0.5)]
    head = f"name {base64.b64encode('é'.encode()).decode()},empty"
    assert spark.range(1).select(sources.metadata_header(F.lit(head)).alias("m")).first().m == {"name": "é", "empty": ""}
    for bad in ("name !!!", "a YQ==,b Y", "a YQ== x", "a YQ==,a Yg=="):
        assert spark.range(1).select(sources.metadata_header(F.lit(bad)).alias("m")).first().m is None


def stream(spark, tmp_path, name, rows, schema, f, mode="append", parts=3):
    """All results of a stream over ``rows``, which come in ``parts`` files."""
    folder = tmp_path / name
    for i in range(parts):
        spark.createDataFrame(rows[i::parts] if mode != "append" else rows[i * len(rows) // parts : (i + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").parquet(str(folder))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = f(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    feed = [(1, "a", 1), (1, "a", 2), (1, "b", 3), (2, "a", 4), (1, "deleted", 5), (2, "a", 6)]
    got = stream(spark, tmp_path, "feed", feed, "user_id long, event_type string, seq long", streaming.tombstones)
    assert sorted(map(tuple, got)) == [(1, "a", "new"), (1, "b", "changed"), (1, "deleted", "deleted"), (2, "a", "new")]
    ops = [("x", 1, "patch", "1"), ("x", 2, "patch", "2"), ("y", 3, "patch", "1"), ("y", 4, "delete", None), ("z", 5, "patch", "9"), ("x", 0, "patch", "0")]
    got = stream(spark, tmp_path, "fold", ops, "id string, seq long, op string, value string", streaming.folded, "complete")
    assert sorted(map(tuple, got)) == [("x", "2", 2), ("z", "9", 5)]
    steps = [("s", 1, "start"), ("s", 2, "start"), ("s", 3, "pause"), ("s", 4, "done"), ("s", 5, "resume"), ("s", 6, "done")]
    got = stream(spark, tmp_path, "machine", steps, "key string, seq long, event string", streaming.stage_machine)
    assert [r.now for r in got] == ["running", "paused", "running", "done"]
    hits = [(k % 2, k, k * 10) for k in range(60)]
    schema = "key long, hit_id long, at long"
    got = stream(spark, tmp_path, "limit", hits, schema, lambda s: streaming.limited(s, 100, 3))
    want = moments.rate_limit(spark.createDataFrame(hits, schema), 100, 3).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    beats = [("p", 0.0, 0.0), ("p", 0.1, 0.2), ("p", 0.6, 0.2004), ("p", 0.7, 0.3), ("p", 0.8, 1.0)]
    got = stream(spark, tmp_path, "throttle", beats, "key string, at_s double, value double", streaming.throttled)
    assert [r.at_s for r in got] == [0.0, 0.6, 0.8]  # 0.7 comes too soon after 0.6, the end always counts
    got = stream(spark, tmp_path, "beat", [("w1", 5), ("w2", 9), ("w1", 7)], "worker string, at long", streaming.heartbeat, "complete")
    assert tuple(got[0]) == ("w2", 9)
    cache = spark.createDataFrame([], "content_key string")
    some = spark.createDataFrame([("a", 1), ("a", 1), (None, 1)], "text string, n int")
    first = streaming.uncached(some, cache, ["text", "n"])
    assert first.count() == 2 and streaming.uncached(some, first.select("content_key"), ["text", "n"]).count() == 0

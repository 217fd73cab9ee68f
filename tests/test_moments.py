"""Fused moments, folds with nulls and the naming of speakers against plain versions."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley import registry
from parley.operators import context, errors, moments

TEXTS = "meeting_id string, n long, t long, why string, look_for string"


def joined(texts):
    out = texts[0] or ""
    for b in texts[1:]:
        a, b = out.strip(), (b or "").strip()
        out = a if b in a else f"{a}; {b}"[:500] if a else b
    return out


def plain_fuse(texts, cuts, spans, until):
    """(t, source, priority, weight, why, look_for) of one meeting, view by view."""
    clamp = lambda t: max(0, min(t, max(0, until - 500)))
    holding = lambda t: next((s for s in sorted(spans) if s[0] <= t < s[1]), None)
    in_span, outside = defaultdict(list), []
    for _, t, why, look in sorted(texts):
        if t is None or not 0 <= t <= until + 1000:
            continue
        cut = min(cuts, key=lambda c: (abs(c - t), c), default=None)
        if snap := cut is not None and abs(cut - t) <= 20_000:
            span = holding(cut) or min((s for s in spans if s[0] >= cut), default=None)
            t = (span[0] + span[1]) // 2 if span and span[1] - span[0] < 3000 else (span[0] if span else cut) + 1500
        t = clamp(t)
        if span := holding(t):
            near = [v for v in in_span[span] if abs(v["t"] - t) < 60_000]
            if near:
                near[0]["said"].append((why, look))
                if snap and not near[0]["snap"]:
                    near[0].update(t=t, snap=True)
            else:
                in_span[span].append({"t": t, "snap": snap, "said": [(why, look)]})
        else:
            outside.append((t, snap, why, look))
    kept = []
    for t, snap, why, look in sorted(outside, key=lambda x: x[0]):
        if kept and t - kept[-1]["t"] < 10_000:
            kept[-1]["said"].append((why, look))
        else:
            kept.append({"t": t, "snap": snap, "said": [(why, look)]})
    out = [(v["t"], "text+scene" if v["snap"] else "text", 2, 1.0, *(joined([s[k] for s in v["said"]]) for k in (0, 1))) for v in [*itertools.chain(*in_span.values()), *kept]]
    for a, z in spans:
        if z - a > 30_000 and (a, z) not in in_span:
            out.append((clamp(a + min(3000, (z - a) // 2)), "scene", 1, (z - a) / 1000, None, None))
    return sorted(out, key=str)


def fused(df):
    found = defaultdict(list)
    for r in df.collect():
        found[r.meeting_id].append(tuple(r)[1:])
    return {m: sorted(rows, key=str) for m, rows in found.items()}


def test_fuse(spark):
    """Random meetings, with moments at and behind the end, cuts without a span behind them, and short spans."""
    rng, texts, cuts, spans, ends = random.Random(6), [], [], [], []
    for m in range(60):
        until, name = rng.choice([400, 20_000, 300_000, 900_000]), f"m{m}"
        ends.append((name, until))
        edges = sorted({rng.randrange(0, until + 1) // 10 * 10 for _ in range(rng.randint(0, 8))} | ({until} if rng.random() < 0.5 else set()))
        cuts += [(name, c) for c in {*edges[:: rng.choice([1, 2])], *(rng.randrange(0, until + 1) for _ in range(rng.randint(0, 3)))}]
        spans += [(name, a, z) for a, z in zip(edges, edges[1:], strict=False) if rng.random() < 0.7]
        for n in range(rng.randint(0, 25)):
            t = rng.choice([None, rng.randrange(0, until + 3000), until, until - 200, until + 1000, until + 1001, -1, 0])
            # texts at one place have one text, so the order of ties is no matter
            texts.append((name, n, t, f"why {t}" if n % 4 else " why ", None if n % 7 == 0 else f"look {t}"))
    frame = spark.createDataFrame
    got = fused(moments.fuse(frame(texts, TEXTS), frame(cuts, "meeting_id string, t long"), frame(spans, "meeting_id string, start_ms long, end_ms long"), frame(ends, "meeting_id string, end_ms long")))
    for name, until in ends:
        of = lambda rows: [r[1:] for r in rows if r[0] == name]  # noqa: E731, B023
        want = plain_fuse(of(texts), [c for (c,) in of(cuts)], of(spans), until)
        assert got.pop(name, []) == want, name
    assert not got


def test_fuse_query(spark, sf_dir):
    from parley.plans.derive import turns

    t = turns(spark, sf_dir).collect()
    got = fused(registry.QUERIES["fuse_moments"](spark, sf_dir))
    spans = defaultdict(list)
    ends = spark.createDataFrame([(m, max(r.end_ms for r in t if r.meeting_id == m)) for m in {r.meeting_id for r in t}], "meeting_id string, end_ms long")
    for r in moments.scene_spans(spark.createDataFrame([(r.meeting_id, r.start_ms) for r in t], "meeting_id string, t long"), ends).collect():
        spans[r.meeting_id].append((r.start_ms, r.end_ms))
    for r in ends.collect():
        mine = [x for x in t if x.meeting_id == r.meeting_id]
        texts = [(x.turn_id, x.end_ms, "said", f"look {x.speaker}") for x in mine if x.turn_id % 5 == 0]
        assert got.pop(r.meeting_id, []) == plain_fuse(texts, [x.start_ms for x in mine], spans[r.meeting_id], r.end_ms)
    assert not got


def test_fuse_many_moments_of_a_span(spark):
    """Moments of a span stream by, with only its views held, though thousands lie in one; also those that lie together outside."""
    rng, until = random.Random(9), 14_400_000
    cuts, spans = [5000, 9_000_000, 14_399_900], [(0, 4000), (10_000, 14_000_000)]
    texts = [(n, t, f"why {t // 1_000_000} " if n % 3 else None, f"look {t // 40_000}") for n, t in enumerate(rng.choices(range(until), k=4000))]
    frame = spark.createDataFrame
    found = moments.fuse(frame([("m", *r) for r in texts], TEXTS), frame([("m", c) for c in cuts], "meeting_id string, t long"), frame([("m", *x) for x in spans], "meeting_id string, start_ms long, end_ms long"), frame([("m", until)], "meeting_id string, end_ms long"))
    assert fused(found)["m"] == plain_fuse(texts, cuts, spans, until)
    assert "collect_list" not in found._jdf.queryExecution().toString()


def test_dedupe_joins_texts(spark):
    rows = [("m", 0, "a", 1), ("m", 5000, "b", 2), ("m", 9999, "a", 3), ("m", 10_000, None, 4), ("m", 12_000, "x", 5), ("n", 3, "z", 6), ("n", None, "y", 7), (None, 1, "p", 8), (None, 2, "q", 9)]
    got = moments.dedupe_close(spark.createDataFrame(rows, "meeting_id string, t long, why string, k long")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [("m", 0, "a; b", 1), ("m", 10_000, "x", 4), ("n", 3, "z", 6), (None, 1, "p; q", 8)]))


def test_folds_keep_long_keys_beside_nulls(spark):
    hits = [(9007199254740993, 1, 10), (None, 2, 10), (None, 3, 11), (None, 4, 12), (9007199254740993, 5, 11)]
    got = {(r.key, r.hit_id): r.allowed for r in moments.rate_limit(spark.createDataFrame(hits, "key long, hit_id long, at long").repartition(1), 600, 1).collect()}
    assert got == {(9007199254740993, 1): True, (9007199254740993, 5): False, (None, 2): True, (None, 3): False, (None, 4): False}


def test_select_joins_both_texts(spark):
    rows = [("m", 1, 2, 1.0, "00", "a", "x"), ("m", 2, 2, 1.0, "01", "b", None), ("m", 3, 0, 1.0, "ff00ff00ff00ff00", "c", "z")]
    got = moments.select_moments(spark.createDataFrame(rows, "meeting_id string, t long, priority int, weight double, phash string, why string, look_for string"), 5).collect()
    assert sorted((r.t, r.why, r.look_for) for r in got) == [(1, "a; b", "x"), (3, "c", "z")]


def test_assignment():
    rng = np.random.default_rng(2)
    for _ in range(300):
        rows, columns = rng.integers(0, 6, 2)
        gain = rng.integers(0, 5, (rows, columns)).astype(float)
        got = errors.assignment(gain)
        taken = [j for j in got if j >= 0]
        assert len(set(taken)) == len(taken)
        wide = np.pad(gain, ((0, max(0, columns - rows)), (0, max(0, rows - columns))))
        best = max((sum(wide[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(len(wide)))), default=0)
        assert sum(gain[i, j] for i, j in enumerate(got) if j >= 0) == best


def test_many_speakers_a_side(spark):
    """30 speakers a side: no exchange of names, however long, may give more (no negative cycle is left)."""
    rng = np.random.default_rng(4)
    gain = rng.integers(0, 1000, (30, 30)).astype(float)
    got = errors.assignment(gain)
    assert sorted(got.tolist()) == list(range(30))
    loss = gain[np.arange(30), got][:, None] - gain[:, got]  # what row i loses by taking row j's column
    for k in range(30):
        loss = np.minimum(loss, loss[:, [k]] + loss[[k], :])
    assert (np.diag(loss) >= 0).all()
    ref = [("m", f"r{i}", f) for i in range(30) for f in range(i * 10, i * 10 + 10)]
    hyp = [("m", f"h{(i * 7) % 30}", f) for i in range(30) for f in range(i * 10 + (i % 3), i * 10 + 10)]
    frame = lambda rows: spark.createDataFrame(rows, "meeting_id string, speaker string, frame long")
    assert tuple(errors.der(frame(ref), frame(hyp)).first())[1:] == (300, 30, 0, 0)


@pytest.mark.parametrize("seed", [1, 2])
def test_clamped_lines(spark, seed):
    rng, rows, want = random.Random(seed), [], []
    for s in range(40):
        lo, hi, clip, end, mine = rng.randint(0, 50), rng.randint(60, 120), rng.randint(-5, 30), None, []
        for n in range(rng.randint(1, 6)):
            a, b, text = rng.choice([None, rng.randint(-20, 130)]), rng.choice([None, rng.randint(-20, 130)]), rng.choice(["x", " ", "y z"])
            rows.append((s, n, clip, lo, hi, a, b, text))
            if text == " ":
                continue
            start = min(max(lo if a is None else clip + a, lo), hi)
            stop = min(max(hi if b is None else clip + b, start), hi)
            if end is not None and start < end <= stop:
                start = end
            end = stop
            mine.append([s, n, start, stop, text])
        if mine:
            mine[0][2], mine[-1][3] = lo, hi
        want += map(tuple, mine)
    given = spark.createDataFrame(rows, "segment_id long, n long, clip_ms long, lo long, hi long, start_ms long, end_ms long, text string")
    assert sorted(map(tuple, context.clamped_lines(given).collect())) == sorted(want)
    assert context.clamped_lines(given.filter(F.lit(False))).collect() == []


def test_votes_said_nearby(spark):
    from parley.operators import notes

    votes = spark.createDataFrame([("m", "S1", "Ann", 100_000), ("m", "S2", "Bo", 100_000), ("m", "S1", "Cy", 400_000), ("n", "S1", "Ann", 100_000)], "meeting_id string, label string, name string, t long")
    lines = spark.createDataFrame([("m", 10_000, 12_000, "hi ANN!"), ("m", 191_000, 192_000, "bo"), ("m", 0, 310_000, "so cy said"), ("n", 9000, 9999, "ann")], "meeting_id string, start_ms long, end_ms long, text string")
    got = sorted(tuple(r) for r in notes.vote_near(votes, lines).collect())
    assert got == [("m", "S1", "Ann", 100_000), ("m", "S1", "Cy", 400_000)]


def test_grounded_items_and_tldr(spark):
    from parley.operators import notes

    items = spark.createDataFrame([("m", 1, 5), ("m", 2, None), ("m", 3, 7)], "meeting_id string, item long, t long")
    sources_ = spark.createDataFrame([("m", 1, 10), ("m", 1, 11), ("m", 2, 10), ("m", 3, 11)], "meeting_id string, item long, claim_id long")
    verdicts = spark.createDataFrame([("m", 10, True), ("m", 11, False)], "meeting_id string, claim_id long, grounded boolean")
    assert sorted(tuple(r) for r in notes.grounded_items(items, sources_, verdicts).collect()) == [("m", 1, 5, True), ("m", 2, 0, False), ("m", 3, 7, False)]
    points = spark.createDataFrame([("m", k, f"p{k}") for k in range(8)] + [("n", 0, " ")], "meeting_id string, n long, text string")
    chapters = spark.createDataFrame([(m, k, "" if k == 1 else f"c{k}") for m in ("m", "n") for k in range(8)], "meeting_id string, n long, title string")
    got = sorted(tuple(r) for r in notes.tldr(points, chapters).collect())
    assert got == [("m", k + 1, f"p{k}") for k in range(6)] + [("n", i + 1, f"c{k}") for i, k in enumerate((0, 2, 3, 4, 5))]

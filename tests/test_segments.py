"""Segment building against a plain version written from the rules: growing hosts, repeated cuts at the widest gap, pads."""

import random

import pytest

from parley import registry
from parley.operators import segments
from parley.plans.derive import turns as derived


def plain(turns, until, micro, most, pad, gap, near):
    """Segments of one meeting as tuples. ``turns``: (start, end, id, speaker, overlap)."""
    if until:
        turns = [(max(0, a), min(until, z), *rest) for a, z, *rest in turns]
    runs = []
    for a, z, _, who, over in sorted((t for t in turns if t[1] > t[0]), key=lambda t: t[:3]):
        if runs and runs[-1]["who"] == who and a - runs[-1]["z"] <= gap:
            runs[-1]["z"] = max(runs[-1]["z"], z)
            runs[-1]["own"].append((a, z))
            runs[-1]["over"] |= over
        else:
            runs.append({"who": who, "a": a, "z": z, "own": [(a, z)], "said": [], "over": over})
    big = [r for r in runs if r["z"] - r["a"] >= micro]
    if big:
        left = []
        for m in runs:
            if m["z"] - m["a"] >= micro:
                continue
            options = []
            for n, h in enumerate(big):
                distance = max(0, max(h["a"], m["a"]) - min(h["z"], m["z"]))
                if distance <= near:
                    same = h["who"] == m["who"]
                    options.append((True, n) if same else (False, not (h["a"] <= m["a"] and m["z"] <= h["z"]), distance, h["a"] > m["a"], h["a"], n))
            if not options:
                left.append(m)
                continue
            same, *_, n = min(options)
            host = big[n]
            if same:
                host["own"] += m["own"]
            else:
                host["said"].append((m["a"], m["z"], m["who"]))
            host["a"], host["z"], host["over"] = min(host["a"], m["a"]), max(host["z"], m["z"]), host["over"] | m["over"]
        runs = []
        for r in sorted(big + left, key=lambda r: (r["a"], r["z"])):
            if runs and runs[-1]["who"] == r["who"] and r["a"] - runs[-1]["z"] <= gap:
                last = runs[-1]
                last["z"], last["own"], last["said"], last["over"] = max(last["z"], r["z"]), last["own"] + r["own"], last["said"] + r["said"], last["over"] | r["over"]
            else:
                runs.append(r)

    def cut(a, z, own):  # twice the times
        if z - a <= 2 * most:
            return [(a, z)]
        reach, found = None, []
        for s, e in sorted(own):
            if reach is not None and s > reach:
                found.append((reach - s, s + reach))
            reach = e if reach is None else max(reach, e)
        found = [(w, c) for w, c in found if a < c < z]
        if found:
            at = min(found)[1]
            return cut(a, at, [t for t in own if 2 * t[0] < at]) + cut(at, z, [t for t in own if 2 * t[1] > at])
        k = 1
        while (z - a) > 2 * most * k:
            k *= 2
        a, z = a // 2, z // 2
        edges = [(a * (k - i) + z * i) // k for i in range(k + 1)]
        return [(2 * x, 2 * y) for x, y in zip(edges, edges[1:], strict=False)]

    out = []
    for r in runs:
        pieces = [(x // 2, y // 2) for x, y in cut(2 * r["a"], 2 * r["z"], r["own"])]
        for a, z in pieces:
            first, last = a == r["a"], z == r["z"]
            begin, stop = max(0, a - pad) if first else a, z + pad if last else z
            own = sorted((max(a, s), min(z, e)) for s, e in r["own"] if s < z and e > a)
            said = sorted(x for x in r["said"] if a <= x[0] < z)
            out.append((len(out), r["who"], begin, min(stop, until) if until else stop, a, z, not first, not last, r["over"], own, said))
    return out


def got(df):
    found = {}
    for r in df.collect():
        row = (r.idx, r.speaker, r.start_ms, r.end_ms, r.speech_start_ms, r.speech_end_ms, r.cut_start, r.cut_end, r.overlap, [tuple(t) for t in r.turns], [tuple(t) for t in r.interjections])
        found.setdefault(r.meeting_id, []).append(row)
    return {m: sorted(rows) for m, rows in found.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_meetings(spark, seed):
    rng, rows, ends = random.Random(seed), [], []
    for m in range(60):
        at, scale = 0, rng.choice([1, 4])
        for i in range(rng.randint(0, 60)):
            at += rng.choice([0, 0, 50, 300, 900, 1000, 1001, 1500, 4000, 31_000]) // scale
            length = rng.choice([0, -5, 100, 500, 1199, 1200, 1201, 3000, 9000, 40_001])
            rows.append((f"m{m}", rng.choice(["A", "A", "B", "C"]), at, at + length, i, rng.random() < 0.1))
            at += max(0, length - rng.choice([0, 0, 200, 2000]))
        ends.append((f"m{m}", rng.choice([None, 0, max(1, at - 300), at + 10_000])))
    turns = spark.createDataFrame(rows, "meeting_id string, speaker string, start_ms long, end_ms long, turn_id long, overlap boolean")
    known = spark.createDataFrame(ends, "meeting_id string, end_ms long")
    want = {}
    for m, until in ends:
        found = plain([(a, z, i, who, over) for x, who, a, z, i, over in rows if x == m], until, 1200, 10_000, 250, 30_000, 1000)
        if found:
            want[m] = found
    found = got(segments.build_segments(turns, known, most_ms=10_000))
    for m in want:
        assert found.pop(m) == want[m]
    assert not found


def test_repeated_cuts(spark):
    """Long speech with many gaps, equal ones among them: the closed form against cutting again and again."""
    rng, rows = random.Random(9), []
    for m in range(30):
        at = 0
        for i in range(150):
            at += rng.choice([0, 1, 2, 2, 3, 7, 7, 15])
            length = rng.choice([1, 5, 20, 300])
            rows.append((f"m{m}", "A", at, at + length, i, False))
            at += length - rng.choice([0, 0, 0, 1])
    turns = spark.createDataFrame(rows, "meeting_id string, speaker string, start_ms long, end_ms long, turn_id long, overlap boolean")
    kind = {"micro_ms": 0, "most_ms": 200, "pad_ms": 3}
    want = {f"m{m}": plain([(a, z, i, w, o) for x, w, a, z, i, o in rows if x == f"m{m}"], None, 0, 200, 3, 30_000, 1000) for m in range(30)}
    assert got(segments.build_segments(turns, **kind)) == want


@pytest.mark.parametrize(("name", "kind"), [("absorb_micro", (30_000, 10**9, 0)), ("build_segments", (1200, 120_000, 250))])
def test_queries(spark, sf_dir, name, kind):
    by = {}
    for r in derived(spark, sf_dir).collect():
        by.setdefault(r.meeting_id, []).append((r.start_ms, r.end_ms, r.turn_id, r.speaker, False))
    until = {m: max(t[1] for t in rows) if name == "build_segments" else None for m, rows in by.items()}
    micro, most, pad = kind
    assert got(registry.QUERIES[name](spark, sf_dir)) == {m: plain(rows, until[m], micro, most, pad, 30_000, 1000) for m, rows in by.items()}


def test_empty(spark):
    none = spark.createDataFrame([], "meeting_id string, speaker string, start_ms long, end_ms long, turn_id long")
    assert segments.build_segments(none).collect() == []

"""The tensor program against a plain shortest path over (row, state, audit), on damaged and on random conversations."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from parley.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string, code int, at long"
GRAMMAR = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """(cost, audit, lines) by Dijkstra over whole audits: the first goal taken is the cheapest, the least of equals.

    ``rows`` are (initial, role, text, must go, breaks off).
    """
    heap, seen = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, state, lines = heapq.heappop(heap)
        if at == len(rows) and state in ("", "a"):
            return cost, audit, lines
        if (audit, at, state) in seen or cost > 4 * len(rows) + 8:
            continue
        seen.add((audit, at, state))
        for role, name in (("u", "user"), ("a", "assistant")):
            if (state, role) in GRAMMAR:
                heapq.heappush(heap, (cost + 3, audit + "I", at, role, (*lines, f"{name}:")))
        if at < len(rows):
            initial, whole, text, gone, extra = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, lines))
            if not gone:
                if (state, initial) in GRAMMAR:
                    heapq.heappush(heap, (cost + 3 * extra, audit + "K", at + 1, initial, (*lines, f"{whole}:{text}")))
                for role, name in (("u", "user"), ("a", "assistant")):
                    if (state, role) in GRAMMAR:
                        heapq.heappush(heap, (cost + 3 + 3 * extra, audit + "R", at + 1, role, (*lines, f"{name}:{text}")))


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        one = lambda x: " " if x is None else x
        fault = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def reported(ids, rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role if role is not None else " ", text if text is not None else " "))
    out = {}
    for conv in set(ids):
        found = sorted(by.get(conv, []))
        turns = [t for known, t, _, _ in found if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        count, seen, coded = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
        for _, _, role, text in found:
            ink = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            coded.append((role[:1], role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(coded, coded[1:], strict=False))
        cost, audit, lines = cheapest(coded)
        out[conv] = (gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def as_dict(df):
    rows = df.collect()
    found = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(found) == len(rows)
    return found


def random_rows(seed, n, most, roles=("user", "assistant", "system", "tool", "", None, "umbrella")):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why? ", "so it goes", "", " \n", "ends.\t\x0b", "not. so", None, "é。", "🙂?"]
    rows = []
    for conv in range(n):
        turn = 0
        for _ in range(rng.randint(0, most)):
            turn += rng.choice([0, 1, 1, 1, 3])
            rows.append((rng.choice([conv, None]) if conv == 0 else conv, rng.choice([turn, turn, turn, None]), rng.choice(roles[:3] if rng.random() < 0.7 else roles), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}."))
    return rows


@pytest.mark.parametrize("size", [repair.CHUNK, 1, 3])
def test_random_conversations(spark, size):
    rows = random_rows(11, 120, 9)
    given = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    ids = given.select("conv_id").union(spark.createDataFrame([(10**15,), (9007199254740993,)], "conv_id long"))
    assert as_dict(repair.report(ids, given, size)) == reported([r.conv_id for r in ids.collect()], rows)


def test_all_short_conversations(spark):
    """Every conversation of up to four rows over all codes, so that every tie is met."""
    kinds = [("system", "a."), ("user", "b."), ("assistant", "c."), ("user", ""), ("tool", "d."), ("assistant", "cut"), ("system", "cut")]
    rows, conv = [], 0
    for length in range(1, 5):
        for k in range(len(kinds) ** length):
            conv += 1
            if length == 4 and conv % 3:
                continue
            for turn in range(length):
                role, text = kinds[k // len(kinds) ** turn % len(kinds)]
                rows.append((conv, turn, role, text and f"{turn} {text}"))
    given = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    assert as_dict(repair.report(given, given)) == reported([r[0] for r in rows], rows)


def test_long_conversation_in_chunks(spark):
    """A conversation of many chunks has the same edits as in one chunk."""
    rows = [(5, *r[1:]) for r in random_rows(2, 300, 9)]
    given = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    one, many = as_dict(repair.report(given, given, 1 << 20)), as_dict(repair.report(given, given, 64))
    assert one == many
    assert len(one[5][6]) >= len(rows)


def test_damage(spark):
    rows = random_rows(4, 200, 8) + [(None, None, None, None), (None, 3, "user", "x.")]
    given = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    key = lambda r: tuple((x is not None, x or 0 if not isinstance(x, str) else x) for x in r)
    assert sorted(map(tuple, repair.damaged(given).collect()), key=key) == sorted(damaged(rows), key=key)


def test_query_as_registered(spark, sf_dir):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    assert as_dict(queries.QUERIES["op11_repair"](spark, sf_dir)) == reported([r[0] for r in rows], damaged(rows))


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.report(none, none).collect() == []

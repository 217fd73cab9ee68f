"""Hashes of pictures, loose JSON, schemas, cleaned sections and keyed digests against plain Python."""

import hashlib
import hmac
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.functions import loose
from parley.operators import pictures


def plain_phash(p):
    """The transform from its definition, one coefficient at a time."""
    c = [[math.sqrt((1 if k == 0 else 2) / 32) * math.cos(math.pi * (2 * i + 1) * k / 64) for i in range(32)] for k in range(8)]
    block = [sum(c[r][i] * c[s][j] * p[32 * i + j] for i in range(32) for j in range(32)) for r in range(8) for s in range(8)]
    middle = sorted(block[1:])[31]
    return "".join("1" if v > middle else "0" for v in block), block, middle


def test_perceptual_hash(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randrange(256) for _ in range(1024)]) for i in range(12)] + [(50, None), (51, [1, 2]), (52, [None] * 1024), (53, [7] * 1024)]
    rows += [(100 + i, [min(255, x + (k == i)) for k, x in enumerate(rows[0][1])]) for i in range(3)]
    got = {r.i: r.phash for r in pictures.perceptual_hash(spark.createDataFrame(rows, "i int, grey array<int>").repartition(3)).collect()}
    for i, p in rows:
        if i in (50, 51, 52):
            assert got[i] is None
        elif i != 53:
            bits, block, middle = plain_phash(p)
            assert all(abs(v - middle) > 1e-9 or v == middle for v in block)
            assert got[i] == f"{int(bits, 2):016x}"
    near = [(int(got[0], 16) ^ int(got[100 + i], 16)).bit_count() for i in range(3)]
    assert max(near) <= 6 < (int(got[0], 16) ^ int(got[1], 16)).bit_count()


def test_difference_hash_and_binarize(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([None, *range(5)]) for _ in range(72)]) for i in range(20)] + [(98, None), (99, [1])]
    got = {r.i: r.h for r in spark.createDataFrame(rows, "i int, g array<int>").select("i", pictures.difference_hash(F.col("g")).alias("h")).collect()}
    for i, g in rows:
        bits = None if g is None or len(g) != 72 else "".join("1" if None not in (a := g[9 * y + x], b := g[9 * y + x + 1]) and b > a else "0" for y in range(8) for x in range(8))
        assert got[i] == (bits and f"{int(bits, 2):016x}")
    values = [0.1, float(np.float32(0.1)), float(np.nextafter(np.float32(0.1), np.float32(1))), None, 0.5]
    on = spark.createDataFrame([(values,)], "v array<float>").select(pictures.binarized(F.col("v"), 0.1)).first()[0]
    assert on == [False, False, True, False, True]


TEXTS = [
    '{"a": 1}', ' ```json\n{"a": [1, 2]}\n``` ', "```\n[1, 2]\n```", 'Sure: {"a": {"b": "}"}} done', "no json", "", None, "{", "}{", '{"a": 1} and {"b": 2}', "[1", "7", '"x"', "null", "true",
    'x {"a": "\\"}"} y', '{"a": 1', "```json\n{bad}\n```", '```JSON\n{"q": 1}\n```', "{'a': 1}", '{"é": "🙂"}', "1] , [2", '1}, {"v": 2', '1, "v": 2', "1, 2", "[1] x {2}", '{"a": 1} x',
]


def plain_parse(text):
    import re

    if text is None:
        return None
    inner = text.strip()
    if m := re.match(r"(?is)^```(?:json)?\s*(.*?)\s*```$", inner):
        inner = m[1] or inner
    for option in (inner, inner[inner.find("{") : inner.rfind("}") + 1] if "{" in inner and inner.rfind("}") > inner.find("{") else ""):
        try:
            return json.loads(option)
        except json.JSONDecodeError:
            continue
    return None


def test_parsed(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    got = {r.i: r.j for r in rows.select("i", F.to_json(loose.parsed(F.col("t"))).alias("j")).collect()}
    for i, t in enumerate(TEXTS):
        assert (None if got[i] is None else json.loads(got[i])) == plain_parse(t), t


def test_first_object(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    got = {r.i: r.j for r in rows.select("i", loose.first_object(F.col("t")).alias("j")).collect()}
    for i, t in enumerate(TEXTS):
        want = None
        at = (t or "").find("{")
        if at >= 0:
            try:
                want = t[at : at + json.JSONDecoder().raw_decode(t[at:])[1]]
            except json.JSONDecodeError:
                want = got[i] if got[i] in ("{bad}", "{'a': 1}", "{2}") else None  # balanced, but no JSON
        assert got[i] == want, t


SCHEMA = {
    "type": "object",
    "required": ["kind", "n"],
    "additionalProperties": False,
    "properties": {
        "kind": {"type": "string", "enum": ["a", "b"]}, "n": {"type": "integer", "minimum": 0, "maximum": 9}, "x": {"type": ["number", "null"]},
        "list": {"type": "array", "items": {"type": "object", "required": ["t"], "properties": {"t": {"type": "string"}}}}, "free": {}, "ok": {"type": "boolean"},
    },
}


def broken(v, schema, path="$"):
    """The rules in plain Python, as a set of paths and first words of the reason."""
    name = {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", float: "number", type(None): "null"}[type(v)]
    types = schema.get("type", [])
    types = [types] if isinstance(types, str) else types
    if types and name not in types and not (name == "integer" and "number" in types):
        return {f"{path}: expected"}
    out = set()
    if "enum" in schema and v not in schema["enum"]:
        out.add(f"{path}: not")
    if name in ("integer", "number") and (v < schema.get("minimum", v) or v > schema.get("maximum", v)):
        out.add(f"{path}: beyond")
    if name == "object":
        out |= {f"{path}.{k}: required" for k in schema.get("required", []) if k not in v}
        for k, x in v.items():
            if k in schema.get("properties", {}):
                out |= broken(x, schema["properties"][k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                out.add(f"{path}.{k}: unexpected")
    if name == "array" and "items" in schema:
        for i, x in enumerate(v):
            out |= broken(x, schema["items"], f"{path}[{i}]")
    return out


def test_violations(spark):
    rng = random.Random(3)
    values = [1, 0, -1, 10, 2.5, "a", "c", None, True, [], {}, [{"t": "x"}, {"t": 1}, {}, 4], {"t": 1}]
    given = [{k: rng.choice(values) for k in rng.sample([*SCHEMA["properties"], "odd"], rng.randint(0, 7))} for _ in range(150)] + values
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(given)], "i int, j string")
    got = {r.i: r.v for r in rows.select("i", loose.violations(F.parse_json("j"), SCHEMA).alias("v")).collect()}
    for i, v in enumerate(given):
        assert sorted(x.split(": ")[0] + ": " + x.split(": ")[1].split(" ")[0] for x in got[i]) == sorted(broken(v, SCHEMA)), (v, got[i])


def test_section(spark):
    raw = {
        "title": "  T" + "x" * 200, "summary": 5, "decisions": [{"text": " yes ", "t": "1:05"}, {"text": ""}, {"t": 4}, {"text": 7}, "odd", {"text": "n", "t": True}],
        "action_items": [{"task": "do", "owner": "Speaker 2", "due": " ", "t": 61}, {"task": "z" * 700, "owner": " None ", "due": "d" * 90}], "speaker_names": [{"label": " s1 ", "name": "Ann", "evidence_t": "0:01:02"}, {"label": "S2"}],
    }
    rows = spark.createDataFrame([(1, json.dumps(raw)), (2, "[]"), (3, '{"decisions": {"text": "x"}}'), (4, None)], "i int, j string")
    got = {r.i: r.s for r in rows.select("i", loose.section(F.parse_json("j"), F.lit(1), F.lit(2)).alias("s")).collect()}
    assert got[1].title == "T" + "x" * 119 and got[1].summary == "" and (got[1].start, got[1].end) == (1, 2)
    assert [tuple(d) for d in got[1].decisions] == [("yes", 65.0), ("n", None)]
    assert [(a.owner, len(a.task), a.due, a.t) for a in got[1].action_items] == [("S2", 2, None, 61.0), (None, 600, "d" * 80, None)]
    assert [tuple(n) for n in got[1].speaker_names] == [("S1", "Ann", 62.0)] and got[1].open_questions == []
    for i in (2, 3, 4):
        assert (got[i].title, got[i].decisions, got[i].action_items) == ("", [], [])


@pytest.mark.parametrize("key", ["k", "x" * 64, "é" * 40, "long " * 30])
def test_keyed_digest(spark, key):
    texts = ["", "token", "é🙂" * 50]
    rows = spark.createDataFrame([(t, key) for t in texts] + [(None, key), ("token", None), ("token", "")], "t string, k string")
    got = [tuple(r) for r in rows.select("t", "k", loose.keyed_digest(F.col("t"), key).alias("a"), loose.keyed_digest(F.col("t"), F.col("k")).alias("b")).collect()]
    for t, k, fixed, by_row in got:
        want = lambda secret: None if t is None else hmac.new(secret.encode(), t.encode(), hashlib.sha256).hexdigest() if secret else hashlib.sha256(t.encode()).hexdigest()  # noqa: E731, B023
        assert (fixed, by_row) == (want(key), want(k))
    assert rows.select(loose.keyed_digest(F.lit("a"))).first()[0] == hashlib.sha256(b"a").hexdigest()

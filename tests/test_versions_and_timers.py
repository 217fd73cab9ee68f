"""Versions that refuse damage, and streams whose timers fire without rows."""

import time
from pathlib import Path

import pytest

from parley.sources import versions
from parley.streaming import timers


def test_versions(spark, tmp_path):
    root = str(tmp_path / "table")
    assert versions.listed(spark, root) == []
    with pytest.raises(FileNotFoundError):
        versions.read(spark, root)
    for n in range(5):
        versions.publish(spark.range(10 * n, 10 * n + 10).repartition(2), root, keep=3)
    assert versions.listed(spark, root) == ["v-00000003", "v-00000004", "v-00000005"]
    assert sorted(r.id for r in versions.read(spark, root).collect()) == list(range(40, 50))
    assert versions.read(spark, root, "v-00000003").count() == 10
    assert not [p for p in Path(root).iterdir() if p.name.startswith("_")]


@pytest.mark.parametrize("fault", ["changed", "missing", "unknown"])
def test_damage_is_refused(spark, tmp_path, fault):
    root = str(tmp_path / "table")
    folder = Path(versions.publish(spark.range(10).repartition(2), root))
    file = next((folder / "data").glob("*.parquet"))
    if fault == "changed":
        data = bytearray(file.read_bytes())
        data[len(data) // 2] ^= 1
        for crc in folder.glob("data/.*.crc"):
            crc.unlink()
        file.write_bytes(data)
    elif fault == "missing":
        file.rename(tmp_path / "away")
    else:
        (folder / "data" / "part-new.parquet").write_bytes(file.read_bytes())
    assert [r.fault for r in versions.damaged(spark, str(folder)).collect()] == [fault]
    with pytest.raises(OSError, match=fault):
        versions.read(spark, root)
    versions.publish(spark.range(3), root)  # the next version is whole again
    assert versions.read(spark, root).count() == 3


def run(spark, tmp_path, name, schema, operator, steps, until):
    """Rows are dropped as files into a folder as time goes by; ends when ``until`` holds for what came out."""
    timers.use_store(spark)
    folder = tmp_path / name
    folder.mkdir()
    stream = spark.readStream.schema(schema).json(str(folder))
    query = operator(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(processingTime="300 milliseconds").start()
    try:
        for n, (ready, rows) in enumerate(steps):
            deadline = time.time() + 60
            while not ready(out := [tuple(r) for r in spark.table(name).collect()]) and time.time() < deadline:
                assert query.isActive, query.exception()
                time.sleep(0.2)
            (tmp_path / "part").write_text("\n".join(rows))
            (tmp_path / "part").rename(folder / f"{n}.json")
        deadline = time.time() + 60
        while not until(out := [tuple(r) for r in spark.table(name).collect()]) and time.time() < deadline:
            assert query.isActive, query.exception()
            time.sleep(0.2)
        return out
    finally:
        query.stop()


def test_feed(spark, tmp_path):
    row = '{{"key": "{}", "seq": {}, "value": {}}}'.format
    steps = [
        (lambda out: True, [row("a", 1, '"x"'), row("a", 2, '"x"'), row("b", 1, "null")]),
        (lambda out: len(out) >= 2, [row("a", 4, '"z"'), row("a", 3, '"y"')]),
        (lambda out: ("a", "z", "deleted") in out and ("b", None, "deleted") in out, [row("a", 5, '"z"')]),
    ]
    out = run(spark, tmp_path, "feed", "key string, seq long, value string", lambda s: timers.feed(s, 9000, 3000), steps, lambda out: out.count(("a", "z", "new")) == 1)
    changes = [x for x in out if x[0] == "a" and x[2] != "keepalive"]
    assert changes == [("a", "x", "new"), ("a", "y", "changed"), ("a", "z", "changed"), ("a", "z", "deleted"), ("a", "z", "new")]
    assert [x for x in out if x[0] == "b" and x[2] != "keepalive"] == [("b", None, "new"), ("b", None, "deleted")]
    assert 1 <= out.count(("a", "z", "keepalive")) <= 4


def test_retries(spark, tmp_path):
    row = '{{"key": "{}", "seq": {}, "event": "{}"}}'.format
    retried = lambda k, n: lambda out: (k, n, "retry") in out
    steps = [
        (lambda out: True, [row("a", 1, "failed"), row("b", 1, "failed"), row("b", 2, "done")]),
        (retried("a", 1), [row("a", 2, "failed")]),
        (retried("a", 2), [row("a", 3, "failed")]),
    ]
    out = run(spark, tmp_path, "retries", "key string, seq long, event string", lambda s: timers.retries(s, 400, 600, 2), steps, lambda out: ("a", 2, "given up") in out)
    assert [x for x in out if x[0] == "a"] == [("a", 1, "retry"), ("a", 2, "retry"), ("a", 2, "given up")]
    assert [x for x in out if x[0] == "b"] == [("b", 1, "done")]

"""Exact top-k against brute force, and the pipeline stage by stage."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from parley.llm import topk
from parley.plans.shared import materialize


def brute(rows, k, every):
    v = {i: [math.floor(1024 * float(x)) for x in e] for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    out = set()
    for q in v:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=False)), c) for c in v if c != q)[:k]
            out |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(best)}
    return out


@pytest.mark.parametrize("bucket", [4096, 50])
def test_top_k(spark, bucket):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) * (1 + 9 * (i % 17 == 0))]) for i in range(600)]
    rows += [(700, None), (800, [1.0, None] + [0.0] * 6), (900, [math.nan] * 8), (1000, [math.inf] + [0.0] * 7), (None, [1.0] * 8), (1100, [0.0] * 8), (1200, rows[5][1])]
    rows += [(i, rows[3][1]) for i in range(1300, 1330)]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, block string")
    got = topk.top_k(table, 10, 100, bucket=bucket, queries=4)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == brute(rows, 10, 100)


def test_top_k_of_repeated_ids_and_huge_values(spark):
    """Rows with one id are queries of their own and candidates of each other; scores stop at 64 bits."""
    rows = [(100, [1.0, 0.0]), (100, [0.0, 2.0]), (5, [3.0, 1.0]), (5, [3.0, 1.0]), (7, [1e20, 1.0]), (8, [-1e20, 0.0]), (200, [1e300, 1e300])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 4, 100).collect()
    most = (1 << 63) - 1
    v = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows]
    want = Counter()
    for n, (q, a) in enumerate(v):
        if q % 100 == 0:
            best = sorted((-max(-most - 1, min(most, sum(x * y for x, y in zip(a, b, strict=True)))), c) for m, (c, b) in enumerate(v) if m != n)[:4]
            want.update((q, r + 1, c, -s) for r, (s, c) in enumerate(best))
    assert Counter(tuple(r) for r in got) == want


def test_top_k_of_uneven_lengths(spark):
    """Lengths over a wide range: most buckets are closed to most queries, and nothing is lost."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=6) * 10 ** rng.uniform(-2, 2)]) for i in range(900)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, 20, bucket=30, queries=3)
    assert {tuple(r) for r in got.collect()} == brute(rows, 5, 20)


def test_top_k_small(spark):
    few = spark.createDataFrame([(100, [1.0, 2.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in topk.top_k(few).collect()} == {(100, 1, 3, 1536 * 1024)}
    assert topk.top_k(few.limit(0)).count() == 0


def test_registered_top_k_equals_its_sql(spark, sf_dir):
    import duckdb

    from parley.llm import queries

    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = con.sql(queries.ORACLE_SQL["op10_topk"])
    assert want.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(want.fetchall()) == sorted(map(tuple, queries.QUERIES["op10_topk"](spark, sf_dir).collect()))


def test_pipeline(spark, docs, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    now = docs.select(*names)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = now
        now = materialize(stage(spark, before, sf_dir))
        if i < 4:
            assert now.columns == names, name
    kept = Counter(r.doc_id for r in before.collect())
    held = defaultdict(int)
    for r in now.collect():
        held[r.doc_id, r.doc_tokens] += r.length
    for (d, tokens), total in held.items():
        assert total % tokens == 0
        kept[d] -= total // tokens
    assert not any(kept.values())


def test_pipeline_on_nothing(spark, sf_dir):
    now = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = materialize(stage(spark, now, sf_dir))
    assert now.count() == 0


def test_registered_quality_equals_its_sql(spark, docs, sf_dir, tmp_path):
    """On the fixture's documents and awkward ones, and hosts whose failures decide on borderline documents."""
    import duckdb

    from parley.llm import queries

    names = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    good, border = "every word here stands once so nothing at all repeats in it", "twelve words and two signs # # that a strict host rejects"
    planted = [(700_000 + i, "short" if i % 100 < 70 else border if i % 100 < 80 else good, "bad") for i in range(100)]
    planted += [(710_000 + 1000 * h + i, good if i else border, f"fine{h}") for h in range(8) for i in range(40)]
    both = docs.select(*names).unionByName(spark.createDataFrame(planted, "doc_id long, text string, source string"), allowMissingColumns=True)
    both.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op6_quality"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(queries.ORACLE_SQL["op6_quality"])
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(want.columns) == sorted(got.columns)
    rows = got.collect()
    assert Counter(map(tuple, rows)) == Counter(tuple(r[i] for i in order) for r in want.fetchall())
    assert any(not r.kept and not r.base_failed for r in rows if r.doc_id and 700_000 <= r.doc_id < 700_100)

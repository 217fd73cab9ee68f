"""What Python workers hold: batches of bounded bytes, bounded tables of words, and no workers for tables of rows."""

from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from parley.llm import packing, tokens
from parley.plans import shared

BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_batches_are_bounded_by_bytes_and_hold_every_row(spark):
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key, None)
    texts = spark.range(0, 6000, 1, 1).select(F.when(F.col("id") == 77, F.repeat(F.lit("y"), 9_000_000)).otherwise(F.repeat(F.lit("x"), 5000)).alias("t"))
    got = shared.materialize(texts.mapInArrow(sizes, "n long, bytes long")).collect()
    assert sum(r.n for r in got) == 6000 and sum(r.bytes for r in got) > 5999 * 5000 + 9_000_000
    assert all(r.bytes < 2 * shared.BATCH_BYTES for r in got if r.bytes < 9_000_000) and len(got) > 6
    assert spark.conf.get(key, None) == was
    spark.conf.set(key, "12345678")
    try:
        shared.materialize(spark.range(3))
        assert spark.conf.get(key) == "12345678"
    finally:
        spark.conf.unset(key)


def test_fewer_words_held_give_the_same_ids():
    texts = [" ".join(f"word{(i * j) % 9973}x{j % 50}é" for j in range(400)) + "\n" for i in range(150)]
    few, all_ = tokens.WordEncoder(BPE, 700), tokens.WordEncoder(BPE)
    for k in range(0, len(texts), 10):
        a, b = few.encode(texts[k : k + 10]), all_.encode(texts[k : k + 10])
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
    few._words(["end"])
    assert len(few.of) <= 700 and len(few.pretokens) <= 400 < len(all_.pretokens)


def test_packing_stage_is_the_same_and_starts_no_workers_for_places(spark, docs, monkeypatch):
    seen = []
    encoder = tokens.encoder
    pieces = packing.pieces
    monkeypatch.setattr(packing, "pieces", lambda *a, **b: seen.append(b["held"]) or pieces(*a, **b))
    packed = corpus_pipeline.packing_stage(spark, docs, "")
    assert seen == [corpus_pipeline.WORDS_HELD] and seen[0] < tokens.PIECES and encoder(BPE, 700).pieces == 700
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "PythonRDD" not in plan
    want = packing.pack(shared.materialize(packing.pieces(docs, BPE, held=tokens.PIECES)))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(str, packed.select(names).collect())) == sorted(map(str, want.select(names).collect()))

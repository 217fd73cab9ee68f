"""Encoding by the table of distinct words against the library on whole texts, and decoding against its decode."""

import hashlib
import json
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parley.llm import queries, wordtable

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def want(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


AWKWARD = [
    "x<|endoftext|>y <|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endof text|>", "é ́e\ń", "Σας ΑΣ ΑΣ. İI", "a b c\u0085d　e", "\x1ca\x1db\x1fc",
    "각 ᄀ ᅡ", "don't DON'T 's' ''s", "ཱི̈́ ﬁ Ⅳ ①", "\x00a\x00", "x" * 50_000, "​zero​width﻿", "ß ẞ Ǆ", "  ", "\n", "🙂" * 300,
]


@pytest.mark.parametrize(("block", "slots"), [(wordtable.BLOCK, 7), (400, 3)])
def test_equals_library(spark, docs, library, block, slots):
    more = spark.createDataFrame([(200_000 + i, t) for i, t in enumerate(AWKWARD)], "doc_id long, text string")
    both = docs.unionByName(more, allowMissingColumns=True)
    got = wordtable.decode(wordtable.encode(both, PATH, block=block, slots=slots), PATH).collect()
    rows = [(r.doc_id, want(library, r.text)) for r in both.select("doc_id", "text").collect()]
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == Counter((i, tuple(x), library.decode(x, skip_special_tokens=False)) for i, x in rows)


def test_query_as_registered(spark, sf_dir, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op12_words"](spark, sf_dir).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = want(library, r.text)
        assert got.pop(r.doc_id) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert not got


def test_keys_of_any_type_and_empty_table(spark, empty):
    rows = spark.createDataFrame([({"a": 1}, None, "b c"), (None, "k", None)], "m map<string,int>, size string, text string")
    got = wordtable.encode(rows, PATH, keep=("m", "size")).orderBy("size").collect()
    assert [(r.m, r["size"], len(r.ids)) for r in got] == [({"a": 1}, None, 2), (None, "k", 0)]
    assert wordtable.decode(wordtable.encode(empty, PATH), PATH).collect() == []


def test_decode_alone(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [320, 99_999, -1, None, 49407])], "i int, ids array<int>").repartition(1)
    library = Tokenizer.from_file(PATH)
    got = {r.i: r.decoded for r in wordtable.decode(rows, PATH).collect()}
    assert got == {1: None, 2: "", 3: library.decode([320, 49407], skip_special_tokens=False)}


def test_blocks_are_read_once(spark, docs):
    found = wordtable.encode(docs, PATH).select(F.size("ids"))
    found.collect()
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()


def test_other_tokenizers_are_refused(tmp_path):
    with pytest.raises(ValueError, match="words encode apart"):
        wordtable._check(public_tokenizers.path("byte_bpe_50k.json"))
    kind = json.loads(open(PATH, encoding="utf-8").read())
    kind["added_tokens"][0]["content"] = "two words"
    (tmp_path / "t.json").write_text(json.dumps(kind))
    with pytest.raises(ValueError, match="words encode apart"):
        wordtable._check(str(tmp_path / "t.json"))

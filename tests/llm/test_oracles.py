"""The new operators as registered against their SQL, on the fixture's tables and on awkward rows."""

import os
from collections import Counter

import duckdb
import pytest

from parley.llm import queries
from test_repair import random_rows


def agree(spark, folder, name):
    got = queries.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        file = f"{folder}/{t}.parquet"
        if os.path.exists(file):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{file}{'/*.parquet' if os.path.isdir(file) else ''}'")
    want = con.sql(queries.ORACLE_SQL[name])
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    rows = lambda found, columns: Counter(tuple(r[columns.index(n)] for n in names) for r in found)
    found = rows(got.collect(), got.columns)
    assert found == rows(want.fetchall(), want.columns)
    return found


@pytest.mark.parametrize("name", ["op11_repair", "op13_variants"])
def test_fixture(spark, sf_dir, name):
    assert agree(spark, sf_dir, name)


def test_awkward_conversations(spark, tmp_path):
    rows = random_rows(21, 150, 9) + [(None, None, None, None), (10**15, 1, "user", "one."), (7, 2**40, "system", "far.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    agree(spark, tmp_path, "op11_repair")


def test_awkward_documents(spark, tmp_path, docs):
    words = " ".join(["spelling"] * 40 + ["speling"] * 6 + ["spellling"] * 5 + ["Éspelling"] * 5 + ["SPELLING"] * 3)
    more = spark.createDataFrame([(None, words), (900_001, words), (900_001, words), (900_002, None)], "doc_id long, text string")
    docs.select("doc_id", "text").union(more).write.parquet(str(tmp_path / "documents.parquet"))
    agree(spark, tmp_path, "op13_variants")

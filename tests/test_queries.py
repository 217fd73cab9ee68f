"""Every registered query against the same result in DuckDB's SQL, over the smallest tables."""

from collections import Counter

import duckdb
import pytest

from parley import registry


def plain(x):
    return x.item() if hasattr(x, "item") else x


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir)
    rows = got.collect()
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(registry.ORACLE_SQL[name])
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    at = [want.columns.index(n) for n in names]
    assert Counter(tuple(r[n] for n in names) for r in rows) == Counter(tuple(r[i] for i in at) for r in want.fetchall())

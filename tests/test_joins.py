"""The sieve: it lets every key through at any size, and few others while it may grow."""

import pytest

from parley.plans import joins
from parley.plans.shared import materialize


def test_sieve_bits():
    assert [joins.sieve_bits(n) for n in (0, 1, 1 << 20, (1 << 20) + 1, 10**7, 10**12)] == [1 << 24, 1 << 24, 1 << 24, 1 << 25, 1 << 27, 1 << 27]


@pytest.mark.parametrize("most", [1 << 27, 1 << 12])
def test_sieve_loses_no_key(spark, monkeypatch, most):
    monkeypatch.setattr(joins, "MOST_BITS", most)
    rows = spark.range(20_000).selectExpr("id", "if(id % 100 = 0, null, id) AS k")
    keys = materialize(spark.range(0, 20_000, 7).selectExpr("id AS k"))
    some, others = joins.sieved(rows, keys, "k")
    got, rest = {r.id for r in some.collect()}, {r.id for r in others.collect()}
    assert not got & rest and len(got) + len(rest) == 20_000
    assert {i for i in range(0, 20_000, 7) if i % 100} <= got
    assert len(got) < 2900 if most > 1 << 12 else True

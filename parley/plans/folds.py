"""Folds along sorted partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def folded(rows: DataFrame, keys: list[str], order: list[str], start: Callable, step: Callable, schema: str | StructType, end: Callable | None = None) -> DataFrame:
    """A fold along sorted partitions. ``step(state, row)`` gives rows (tuples) and changes the state, which is ``start()``
    for each new key; ``end(state)`` gives a key's last rows. Rows come from Arrow as dictionaries, so long ones stay
    exact beside nulls, and null keys are one key. Memory follows the state and never the rows of a key."""
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def table(found: list[tuple]) -> pa.RecordBatch:
        columns = zip(*found, strict=True) if found else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            found: list[tuple] = []
            for r in batch.to_pylist():
                key = tuple(r[k] for k in keys)
                if key != now:
                    found += end(state) if end and now is not None else ()
                    now, state = key, start()
                found += step(state, r)
            yield table(found)
        if end and now is not None:
            yield table(list(end(state)))

    return dealt.mapInArrow(run, schema)

"""Hashes of small grey pictures held as arrays, row by row: a cosine transform's low frequencies, and horizontal differences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

#: Sides of the picture and of the block of low frequencies.
SIDE, LOW = 32, 8
#: Pictures transformed at once: 8 MB.
AT_ONCE = 1024


def cosines(side: int = SIDE, low: int = LOW) -> np.ndarray:
    """The first rows of the orthonormal cosine transform."""
    k, i = np.arange(low)[:, None], np.arange(side)[None, :]
    return np.sqrt(np.where(k == 0, 1, 2) / side) * np.cos(np.pi * (2 * i + 1) * k / (2 * side))


def low_frequencies(pictures: np.ndarray) -> np.ndarray:
    """(picture, 64): the block of low frequencies, rows first, of (picture, 32, 32): rows and columns one after another."""
    c = cosines()
    return (c @ pictures @ c.T).reshape(len(pictures), -1)


def perceptual_hash(rows: DataFrame, grey: str = "grey", out: str = "phash") -> DataFrame:
    """``rows`` with 16 hex digits for each 32 x 32 picture: bits of frequencies above the median of all but the first.

    A null picture, one of another size, or one with a null in it has a null hash. Alike pictures have hashes that
    differ in few bits (see ``moments.hamming_neardup``).
    """
    names, schema = rows.columns, StructType([*rows.schema, StructType().add(out, StringType())[0]])
    place = np.array([1 << (63 - i) for i in range(64)], dtype=np.uint64)
    whole = F.when((F.size(grey) == SIDE * SIDE) & ~F.exists(grey, lambda x: x.isNull()), F.col(grey).cast("array<double>"))
    slim = rows.withColumn("__grey", whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(k, AT_ONCE)
                lists = part.column(part.num_columns - 1)
                known = lists.is_valid().to_numpy(zero_copy_only=False)
                pictures = lists.flatten().to_numpy().reshape(-1, SIDE, SIDE)
                block = low_frequencies(pictures)
                above = block > np.median(block[:, 1:], axis=1)[:, None] if len(block) else np.zeros((0, 64), bool)
                found = iter((above * place).sum(axis=1, dtype=np.uint64).tolist())
                hashes = [f"{next(found):016x}" if k else None for k in known]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(hashes, pa.string())], names=[*names, out])

    return slim.mapInArrow(run, schema)


def difference_hash(grey: Column) -> Column:
    """16 hex digits of a picture 9 wide and 8 high: a bit for each two neighbours in a row, set if the right one is brighter.

    Null for a null picture or one of another size; a null pixel counts as not brighter.
    """
    at = F.sequence(F.lit(0), F.lit(63))
    brighter = lambda i: F.get(grey, (i / 8).cast("int") * 9 + i % 8 + 1) > F.get(grey, (i / 8).cast("int") * 9 + i % 8)
    bits = F.aggregate(at, F.lit(0).cast("long"), lambda n, i: F.shiftleft(n, 1).bitwiseOR(F.coalesce(brighter(i).cast("long"), F.lit(0).cast("long"))))
    return F.when(F.size(grey) == 72, F.lower(F.lpad(F.hex(bits), 16, "0")))


def binarized(values: Column, threshold: float = 0.5) -> Column:
    """An array of float32 values as booleans: strictly above the threshold, which is rounded to float32 as well; null is not."""
    return F.transform(values, lambda x: F.coalesce(x.cast("float") > F.lit(threshold).cast("float"), F.lit(False)))

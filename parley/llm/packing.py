"""Packing token sequences by cutting stock: a linear program over length patterns, columns priced by a knapsack.

The corpus is reduced to one histogram of piece lengths, in classes of ``UNIT`` ids, and only those numbers reach the
driver. Column generation solves the relaxed program there: the dual prices of the lengths go to a knapsack over the
capacity, whose best filling is the next pattern, until no pattern pays. Patterns are rounded down, what is left is
packed by the same knapsack, and every piece finds its place in its length's patterns by its rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm import tokens
from parley.llm.text import whole
from parley.plans.joins import gapless_rank

CAPACITY = 1024
#: Lengths count in units of so many ids, rounded up: a piece may waste UNIT - 1 ids, and the program stays small.
UNIT = 4
#: The program is solved when its value is proven (by Farley's bound) to be within this share of the best.
GAP = 1e-3
MOST_ROUNDS = 4000


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, text: str = "text", keep: tuple[str, ...] = ("doc_id",), held: int = tokens.PIECES) -> DataFrame:
    """Per document its ids and ``end_id``, cut every ``capacity`` ids: keep, start, length, ids_crc32, doc_tokens.

    ids_crc32 is of the piece's ids as little-endian unsigned 32-bit integers. A null text is empty: one piece.
    ``held`` words stay encoded in a worker; the rest is encoded anew, so it trades memory for time and changes no id.
    """
    slim = docs.select(*keep, whole(text).alias("__text"))
    names = ("start", "length", "ids_crc32", "doc_tokens")
    schema = slim.select(*keep, *[F.lit(0).cast("long").alias(n) for n in names]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path, held)
        for b in tokens.slices(batches):
            ids, sizes = encoder.encode(b.column(b.num_columns - 1).to_pylist())
            row, start, length, crc, total = [], [], [], [], []
            at = 0
            for i, n in enumerate(sizes.tolist()):
                own = np.empty(n + 1, dtype="<u4")
                own[:n], own[n] = ids[at : at + n], end_id
                at += n
                for k in range(0, n + 1, capacity):
                    part = own[k : k + capacity]
                    row.append(i)
                    start.append(k)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
                    total.append(n + 1)
            rows = pa.array(row, pa.int64())
            columns = [c.take(rows) for c in b.columns[:-1]] + [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])

    return slim.mapInArrow(run, schema)


def _best_filling(value: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable filling of ``capacity`` (its value, a count per length) by dynamic programming."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fit = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(int(lengths[0]), capacity + 1):
        gain = best[c - lengths[: fit[c]]] + value[: fit[c]]
        k = int(gain.argmax())
        if gain[k] > best[c - 1]:
            best[c], last[c] = gain[k], k
        else:
            best[c] = best[c - 1]
    count, c = np.zeros(len(lengths), dtype=np.int64), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            count[last[c]] += 1
            c -= int(lengths[last[c]])
    return float(best[capacity]), count


def _fullest(lengths: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """The longest piece that is left and the pieces that fill the rest of a sequence best."""
    count = np.zeros(len(lengths), dtype=np.int64)
    top = int(np.flatnonzero(left)[-1])
    count[top] = 1
    room = capacity - int(lengths[top])
    reach = np.zeros(room + 1, dtype=bool)
    reach[0] = True
    came = np.full((room + 1, 2), -1)
    for k in np.flatnonzero(left)[::-1]:
        size = int(lengths[k])
        for _ in range(min(int(left[k]) - int(count[k]), room // size)):
            new = np.flatnonzero(reach[: room + 1 - size] & ~reach[size:]) + size
            if not len(new):
                break
            came[new, 0], came[new, 1] = k, new - size
            reach[new] = True
        if reach[room]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at > 0:
        count[came[at, 0]] += 1
        at = int(came[at, 1])
    return count


def _inverse(a: np.ndarray) -> np.ndarray:
    """The inverse by elimination, without the linear algebra library, whose threads can wait for ever beside a JVM."""
    n = len(a)
    m = np.hstack([a, np.eye(n)])
    for i in range(n):
        p = i + int(np.abs(m[i:, i]).argmax())
        if p != i:
            m[[i, p]] = m[[p, i]]
        m[i] /= m[i, i]
        factor = m[:, i].copy()
        factor[i] = 0.0
        m -= np.outer(factor, m[i])
    return m[:, n:]


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: count}) for a histogram {length: pieces}: together they hold every piece exactly once."""
    lengths = np.array(sorted(n for n, k in histogram.items() if k > 0), dtype=np.int64)
    if not len(lengths):
        return []
    need = np.array([histogram[int(n)] for n in lengths], dtype=float)
    m = len(lengths)
    columns = np.diag(capacity // lengths).astype(float)  # one pattern of each length to start with
    inverse = np.diag(1.0 / np.diag(columns))
    use = (inverse * need).sum(axis=1)
    for round_ in range(MOST_ROUNDS):
        prices = inverse.sum(axis=0)
        value, column = _best_filling(np.maximum(prices, 0.0), lengths, capacity)
        if value <= 1 + GAP:
            break
        step = (inverse * column).sum(axis=1)  # small: a threaded matrix product would only wait for its threads
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1.0), np.inf)
        out = int(ratio.argmin())
        t = ratio[out]
        use -= t * step
        use[out] = t
        np.maximum(use, 0.0, out=use)
        columns[:, out] = column
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        if round_ % 200 == 199:  # against drift
            inverse = _inverse(columns)
            use = np.maximum((inverse * need).sum(axis=1), 0.0)
    left = need.astype(np.int64)
    found: list[tuple[int, dict[int, int]]] = []

    def add(times: int, count: np.ndarray) -> None:
        if times > 0:
            found.append((times, {int(lengths[k]): int(count[k]) for k in np.flatnonzero(count)}))
            np.subtract(left, times * count, out=left)

    for k in np.argsort(-use):
        count = columns[:, k].astype(np.int64)
        held = count > 0
        add(min(int(use[k] + 1e-6), int((left[held] // count[held]).min())), count)
    while left.any():
        count = _fullest(lengths, left, capacity)
        held = count > 0
        add(int((left[held] // count[held]).min()), count)
    return found


def places(found: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (units, from_rank, to_rank, first_sequence, times, nth): where the ranked pieces of a length class go."""
    rows, seen, sequence = [], {}, 0
    for times, count in found:
        nth = 0
        for units in sorted(count, reverse=True):
            k = seen.get(units, 0)
            rows.append((units, k, k + times * count[units], sequence, times, nth))
            seen[units] = k + times * count[units]
            nth += count[units]
        sequence += times
    return rows


def pack(table: DataFrame, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """Add sequence_id and offset to a written ``pieces`` table.

    Pieces of one length class are interchangeable: they are ranked in a fixed order, by many tasks however common
    the class is, and the rank finds the sequence; offsets are running sums inside a sequence. The table of places
    has a row per class and pattern, bounded by the capacity whatever the corpus, and is broadcast. No pieces give
    no rows.
    """
    spark = table.sparkSession
    table = table.withColumn("p_units", F.ceil(F.col("length") / unit).cast("long"))
    histogram = {r["p_units"]: r["count"] for r in table.groupBy("p_units").count().collect()}
    rows = places(patterns(histogram, capacity // unit))
    # as an Arrow table: a list of rows would go through Python workers, which then stay on every executor
    columns = np.array(rows, dtype=np.int64).reshape(-1, 6).T
    plan = spark.createDataFrame(pa.table([pa.array(c) for c in columns], names=["units", "lo", "hi", "first", "times", "nth"]))
    names = [c for c in table.columns if c != "p_units"]
    ranked = gapless_rank(table, ["p_units"], names, "p_rank")
    fits = (F.col("p_units") == F.col("units")) & (F.col("p_rank") >= F.col("lo")) & (F.col("p_rank") < F.col("hi"))
    out = ranked.join(F.broadcast(plan), fits)
    out = out.withColumn("sequence_id", F.col("first") + (F.col("p_rank") - F.col("lo")) % F.col("times"))
    out = out.withColumn("p_nth", F.col("nth") + F.expr("(p_rank - lo) div times"))
    before = Window.partitionBy("sequence_id").orderBy("p_nth").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select(*names, "sequence_id", "offset")

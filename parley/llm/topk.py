"""Exact top-k inner products: vectors in length buckets, pruned per bucket by length or by coordinates, then verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.plans.joins import join_small
from parley.plans.shared import materialize, scratch

#: Vectors of a bucket and queries of a block; a task holds one of each.
BUCKET, QUERIES = 4096, 512
#: Above this local cosine threshold coordinates prune better than lengths.
STEEP = 0.6
#: Classes of bucket lengths by which blocks find the buckets that are open to them, and blocks that one copy of a bucket serves.
CLASSES, SERVES = 64, 64

_BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("rows", pa.binary()), ("vectors", pa.binary()), ("floors", pa.binary()), ("longest", pa.float64()), ("least", pa.float64())])
_BLOCK_SQL = "block long, ids binary, rows binary, vectors binary, floors binary, longest double, least double"
_FOUND_SQL = "query_row long, query_id long, vec_id long, score long"


def whole_vectors(table: DataFrame, vec: str = "embedding", keep: str = "vec_id", scale: int = 1024) -> DataFrame:
    """id, row, v (``scale`` times each component) and len2 of the vectors whose components are all finite.

    ``row`` is a number of the row itself, fixed once the table is written. Null ids, null vectors and vectors with
    null, NaN or infinite components take no part.
    """
    x = F.col(vec)
    good = F.col(keep).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    v = F.transform(x, lambda c: c.cast("double") * scale)
    slim = table.filter(good).select(F.col(keep).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), v.alias("v"))
    return slim.withColumn("len2", F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """The floors of all components, shorter vectors going on with zeros. Beyond the range of doubles: its ends."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat, width = lists.flatten().to_numpy(zero_copy_only=False), int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return np.nan_to_num(np.floor(out), posinf=np.finfo(float).max, neginf=np.finfo(float).min)


def _bytes(m: np.ndarray) -> bytes:
    kind = "<i4" if np.abs(m).max(initial=0) < 2**31 else "<f8"
    return np.array([m.shape[1], int(kind[2])], "<i8").tobytes() + m.astype(kind).tobytes()


def _vectors(data: bytes) -> np.ndarray:
    width, size = np.frombuffer(data, "<i8", 2).tolist()
    m = np.frombuffer(data, f"<{'i' if size == 4 else 'f'}{size}", offset=16).astype(float)
    return m.reshape(-1, width) if width else np.zeros((0, 0))


def _lengths(m: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((m * m).sum(axis=1))


def _pack(rows: DataFrame, most: int) -> DataFrame:
    """Blocks of ``most`` rows (id, row, v, floor) in their partitions' order; block is task << 32 | number.

    longest is the greatest length in the block; least is the length that a vector needs at least to give any of the
    block's queries a result: the smallest floor / length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, n = TaskContext.get().partitionId() << 32, [], 0

        def block(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            m = _matrix(table.column("v").combine_chunks() if table.column("v").num_chunks != 1 else table.column("v").chunk(0))
            floors, lengths = table.column("floor").to_numpy().astype("<f8"), _lengths(m)
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(lengths > 0, floors / lengths, np.where(floors <= 0, -np.inf, np.inf))
            least = np.where(np.isfinite(lengths), least, -np.inf)
            ids, own = (table.column(c).to_numpy().astype("<i8").tobytes() for c in ("id", "row"))
            return pa.RecordBatch.from_pylist([{"block": number, "ids": ids, "rows": own, "vectors": _bytes(m), "floors": floors.tobytes(), "longest": float(lengths.max()), "least": float(least.min())}], schema=_BLOCK)

        for b in batches:
            held.append(b)
            n += b.num_rows
            while n >= most:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, most))
                number, n = number + 1, n - most
                held = table.slice(most).to_batches()
        if n:
            yield block(pa.Table.from_batches(held))

    return rows.select("id", "row", "v", "floor").mapInArrow(run, _BLOCK_SQL)


def _score(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products. Doubles are exact below 2^53; larger vectors are multiplied as integers, and products
    beyond 64 bits count as the nearest number of 64 bits."""
    width = min(q.shape[1], c.shape[1])  # a shorter vector goes on with zeros
    q, c = q[:, :width], c[:, :width]
    bound = _lengths(q).max() * _lengths(c).max()
    if bound < 2.0**52:
        return (q @ c.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = (whole(q) if q.size else q) @ (whole(c).T if c.size else c.T)
    return np.array([[max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in r] for r in exact], dtype=np.int64).reshape(len(q), len(c))


def search_block(q_rows: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c_rows: np.ndarray, c: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query number, candidate id, score) of one bucket for a block of queries.

    ``floor`` holds per query a score that its k-th best result is known to reach. It gives the bucket's local cosine
    threshold, floor / (|q| longest). A steep threshold prunes by coordinate: the bucket's range of the query's
    largest coordinate and the length of the rest bound the product. A flat one prunes by length alone. What survives
    is multiplied out, so results are exact. Ties go to the smaller id; the query's own row is left out.
    """
    c_len, q_len = _lengths(c), _lengths(q)
    longest = float(c_len.max())
    sure = np.isfinite(longest) and np.isfinite(q_len).all()  # else nothing is pruned
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(q_len * longest > 0, floor / (q_len * longest), -np.inf) if sure else np.full(len(q), -np.inf)
    width = min(q.shape[1], c.shape[1])
    out_q, out_c, out_s = [], [], []
    slack = 1.0 + 1e-9  # bounds are doubles; a pruned candidate must lie clearly below
    flat = cosine < STEEP
    open_ = cosine <= slack  # the bucket may hold nothing for a query, though it does for others of the block
    groups = [(np.flatnonzero(flat), None)] + [(np.array([i]), int(np.abs(q[i, :width]).argmax())) for i in np.flatnonzero(~flat & open_)]
    for rows, top in groups:
        if not len(rows):
            continue
        if not sure:
            some = np.arange(len(c))
        elif top is None:
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(q_len[rows] > 0, floor[rows] / q_len[rows], -np.inf).min()
            some = np.flatnonzero(c_len * slack + 1e-6 >= least)
        else:
            i = rows[0]
            rest_q = np.sqrt(max(0.0, q_len[i] ** 2 - q[i, top] ** 2))
            rest_c = np.sqrt(np.maximum(0.0, c_len**2 - c[:, top] ** 2))
            bound = q[i, top] * c[:, top] + rest_q * rest_c
            some = np.flatnonzero(bound + np.abs(bound) * 1e-9 + 1e-3 >= floor[i])
        if not len(some):
            continue
        scores, ids = _score(q[rows], c[some]), c_ids[some]
        for j, i in enumerate(rows):
            s, own = scores[j], c_rows[some] != q_rows[i]
            s, own_ids = s[own], ids[own]
            if len(s) > k:
                cut = np.partition(s, len(s) - k)[len(s) - k]
                near = np.flatnonzero(s >= cut)
                s, own_ids = s[near], own_ids[near]
            order = np.lexsort((own_ids, -s.astype(object) if len(s) and s.min() == -(1 << 63) else -s))[:k]
            out_q.append(np.full(len(order), i))
            out_c.append(own_ids[order])
            out_s.append(s[order])
    if not out_q:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)


def _search(rows: DataFrame, k: int) -> DataFrame:
    """The k best of every query block in the bucket whose row stands before it: rows of bucket, asks and a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = None
        for b in batches:
            for n in range(b.num_rows):
                r = {name: b.column(name)[n].as_py() for name in ("asks", "ids", "rows", "vectors", "floors")}
                ids, own, m = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["rows"], "<i8"), _vectors(r["vectors"])
                if not r["asks"]:
                    bucket = ids, own, m
                    continue
                i, c, s = search_block(own, m, *bucket, k, np.frombuffer(r["floors"], "<f8"))
                yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(ids[i]), pa.array(c), pa.array(s)], names=["query_row", "query_id", "vec_id", "score"])

    return rows.select("asks", "ids", "rows", "vectors", "floors").mapInArrow(run, _FOUND_SQL)


def _seeded(blocks: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """The k best of every block of queries in one bucket, which is broadcast: a row of BUCKET vectors, whatever the table."""
    both = blocks.crossJoin(F.broadcast(first.select(*[F.col(c).alias(f"c_{c}") for c in ("ids", "rows", "vectors")])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, own = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["rows"], "<i8")
                bucket = np.frombuffer(r["c_ids"], "<i8"), np.frombuffer(r["c_rows"], "<i8"), _vectors(r["c_vectors"])
                i, c, s = search_block(own, _vectors(r["vectors"]), *bucket, k, np.full(len(ids), -np.inf))
                yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(ids[i]), pa.array(c), pa.array(s)], names=["query_row", "query_id", "vec_id", "score"])

    return both.select("ids", "rows", "vectors", "c_ids", "c_rows", "c_vectors").mapInArrow(run, _FOUND_SQL)


def open_buckets(blocks: DataFrame, buckets: DataFrame) -> DataFrame:
    """(block, bucket) for every bucket that can still hold a result of the block: longest >= least.

    At most CLASSES lengths, quantiles over all buckets, order both sides; a block is joined to the classes up to its
    own by equality, and the lengths themselves decide.
    """
    edges = buckets.agg(F.percentile_approx("longest", [i / CLASSES for i in range(1, CLASSES)], 10_000)).first()[0] or []
    edges = F.array(*[F.lit(float(e)) for e in sorted(set(edges))]).cast("array<double>")
    above = lambda x: F.size(F.filter(edges, lambda e: e > x))
    slack = F.col("longest") * (1 + 1e-9) + 1e-6
    asks = blocks.select("block", "least", F.explode(F.sequence(F.lit(0), above(F.col("least")))).alias("class"))
    held = buckets.select(F.col("block").alias("bucket"), "longest", above(slack).alias("class"))
    return asks.join(held, "class").filter(slack >= F.col("least")).select("block", "bucket")


def top_k(table: DataFrame, k: int = 10, every: int = 100, vec: str = "embedding", keep: str = "vec_id", bucket: int = BUCKET, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best other vectors of every row whose id is divisible by ``every``.

    Vectors are range-dealt by length and cut into buckets. Every query meets the bucket of the longest vectors
    first, which gives it a floor. Queries are then dealt by the length that a vector needs to reach their floor, so
    those of a block are alike, and blocks go to the buckets that can still hold a result, those with
    |q| * longest >= floor. Buckets stay where they are, but for copies for many blocks; a bucket sends on k rows a query.

    A query is a row: rows with one id are a query each, with results of their own, and candidates of each other;
    only the row itself is left out. Null ids and vectors that take no part give and get nothing; equal scores go to
    the smaller id; scores beyond 64 bits count as the nearest such number; other columns are ignored; an empty table
    gives no rows.
    """
    spark = table.sparkSession
    with scratch(spark):
        vectors = materialize(whole_vectors(table, vec, keep))
        dealt = vectors.withColumn("floor", F.lit(float("-inf"))).repartitionByRange(F.desc("len2"), "row").sortWithinPartitions(F.desc("len2"))
        buckets = materialize(_pack(dealt, bucket))
        longest = buckets.agg(F.max_by("block", F.struct("longest", "block"))).first()[0]
        if longest is None:
            return _none(spark)
        first, others = buckets.filter(F.col("block") == longest), buckets.filter(F.col("block") != longest)
        asked = vectors.filter(F.col("id") % every == 0).withColumn("floor", F.lit(float("-inf")))
        found = materialize(_seeded(_pack(asked.repartition("row"), queries), first, k))
        floors = found.groupBy("query_row").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("kth")).filter(F.col("n") == k)
        asked = asked.drop("floor").join(floors, F.col("row") == F.col("query_row"), "left").withColumn("floor", F.coalesce("kth", F.lit(float("-inf"))))
        need = F.when(F.col("len2") > 0, F.col("floor") / F.sqrt("len2"))
        blocks = materialize(_pack(asked.withColumn("need", need).repartitionByRange("need", "row").sortWithinPartitions("need"), queries))
        pairs = materialize(open_buckets(blocks, others))
        copies = pairs.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / SERVES).cast("int").alias("copies"))
        copies = materialize(copies)
        body = ["ids", "rows", "vectors", "floors"]
        held = others.withColumnRenamed("block", "bucket").join(copies, "bucket")
        held = held.select("bucket", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(False).alias("asks"), *body)
        asks = join_small(pairs, copies.withColumnRenamed("bucket", "__b"), F.col("bucket") == F.col("__b"))
        asks = asks.select("block", "bucket", F.pmod(F.xxhash64("block"), F.col("copies")).cast("int").alias("copy"))
        asks = asks.join(blocks, "block").select("bucket", "copy", F.lit(True).alias("asks"), *body)
        rest = held.unionByName(asks).repartition("bucket", "copy").sortWithinPartitions("bucket", "copy", "asks")
        best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
        ranked = found.unionByName(materialize(_search(rest, k))).withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k)
        return materialize(ranked.select("query_id", "rank", "vec_id", "score"), keep=True)


def _none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

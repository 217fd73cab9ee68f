"""Joins with a checked broadcast side, a bounded sieve before joins, exact distributed ranks and prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.plans.shared import materialize

#: A side is broadcast only if it is known to have no more rows and bytes (as JSON) than this.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 32 << 20
#: Bits of a sieve for each key, and in all: 2 MB of bits at least, 16 MB at most, whatever the size of the table.
BITS_A_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 24, 1 << 27

_JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def row_hash(df: DataFrame, *first: Column) -> Column:
    """A 64-bit hash of a whole row, behind ``first``: which columns are null counts, and nested ones go in as JSON."""
    parts: list[Column] = list(first)
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))
        parts += [c.isNull(), F.to_json(c, _JSON) if nested else c]
    return F.xxhash64(*parts)


def join_small(big: DataFrame, small: DataFrame, on: str | Sequence[str] | Column, how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``small`` to ``big``, broadcast only if it has at most ``limit`` rows and BROADCAST_BYTES bytes.

    ``small`` should be a written table, as it is counted here. Beyond the limits it is an ordinary shuffled
    join, whose hot keys on the side of ``big`` are split by adaptive execution.
    """
    bytes_ = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in small.columns]), _JSON))
    n, size = small.limit(limit + 1).agg(F.count(F.lit(1)), F.sum(bytes_)).first()
    fits = n <= limit and (size or 0) <= BROADCAST_BYTES
    return big.join(F.broadcast(small) if fits else small, on, how)


def sieve_bits(n: int) -> int:
    """Bits of a sieve for ``n`` keys: a power of two that gives each BITS_A_KEY of them, as far as a broadcast may hold them."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << max(0, (BITS_A_KEY * n - 1).bit_length())))


def sieved(rows: DataFrame, keys: DataFrame, key: str, of: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: those whose ``of`` (``key``) may be a ``key`` of the written ``keys``, and the others.

    A bitmap, 64 bits to a row, is broadcast. Its size follows the number of keys up to a bound: up to some 8 million
    keys about one in 16 rows without a key goes through with the others, and they are spared the shuffle of a join.
    With many more keys most rows go through; the join behind it gives the same result in any case.
    """
    bits = sieve_bits(keys.count())
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    words = keys.select(bit(key).alias("b")).groupBy(F.expr("b div 64").alias("__word"))
    words = materialize(words.agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("__bits")))
    marked = rows.withColumn("__bit", bit(of or key))
    # Of few keys the words are few; of many they are MOST_BITS / 64 rows at most, which is what the bound is for.
    marked = marked.join(F.broadcast(words), F.expr("__bit div 64") == F.col("__word"), "left")
    hit = F.coalesce(F.getbit("__bits", F.expr("cast(__bit % 64 as int)")) == 1, F.lit(False))
    return marked.filter(hit).select(*rows.columns), marked.filter(~hit).select(*rows.columns)


def gapless_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, buckets: int | None = None) -> DataFrame:
    """Add ``out``: a number from 0, without gaps, for the rows of each key; equal inputs give equal ranks.

    A key's rows are dealt over ``buckets`` by a hash of ``order``, ranked inside each bucket, and shifted by the
    sizes of the buckets before it, so a key with a third of all rows is still ranked by many tasks.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    b, local, base = f"{out}__b", f"{out}__l", f"{out}__o"
    dealt = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    sizes = dealt.groupBy(*keys, b).agg(F.count(F.lit(1)).alias(base))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn(base, F.coalesce(F.sum(base).over(before), F.lit(0)))
    sizes = materialize(sizes.select(*[F.col(k).alias(f"{out}__k{i}") for i, k in enumerate(keys)], F.col(b).alias(f"{out}__kb"), base))
    within = Window.partitionBy(*keys, b).orderBy(*[F.col(c) for c in order])
    ranked = dealt.withColumn(local, F.row_number().over(within) - 1)
    same = F.col(b) == F.col(f"{out}__kb")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"{out}__k{i}"))
    joined = join_small(ranked, sizes, same, "left")
    return joined.withColumn(out, (F.col(base) + F.col(local)).cast("long")).select(*df.columns, out)


def running_total(df: DataFrame, order: Sequence[Column | str], value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` (long) over all rows before this one in ``order``; 1 as the value numbers the rows.

    Rows are dealt in ranges of the order, written, summed inside each range, and shifted by the sums of the ranges
    before it: one row a range meets in one task, never the rows. Rows that tie in ``order`` stand in a fixed order
    of their own. Null values count as 0.
    """
    names = df.columns
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = df.withColumn("__v", F.coalesce(value.cast("long"), F.lit(0))).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = materialize(dealt.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    sums = dealt.groupBy("__part").agg(F.sum("__v").alias("__sum"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = materialize(sums.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base")))
    inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("__inside", F.coalesce(F.sum("__v").over(inside), F.lit(0)))
    placed = join_small(placed, sums, F.col("__part") == F.col("__p"))
    return placed.select(*names, (F.col("__base") + F.col("__inside")).alias(out))

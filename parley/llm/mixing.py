"""Mixing sources to target weights by capped water-filling, and seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.text import WORD, whole
from parley.plans.joins import join_small, row_hash, running_total
from parley.plans.shared import materialize

#: Buckets of the seeded order inside a source; a source's sums are taken per bucket, and only the bucket in which
#: its fraction ends is looked at row by row.
BUCKETS = 4096


def sized(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), source: str = "source", seed: int = 17) -> DataFrame:
    """``keep``, source, size in words (null text: 0) and h, the document's place in the seeded order."""
    return docs.select(*keep, F.col(source).alias("source"), F.regexp_count(whole(text), F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.lit(seed), *keep).alias("h"))


def fill(sources: DataFrame, budget: float, epochs: float) -> DataFrame:
    """Add ``target``: ``budget`` shared by ``weight``, no source above ``epochs`` times its ``source_size``.

    Every round clamps the sources whose share is above their cap and shares the rest among the others, until none
    is above. A round sends three sums to the driver, never the sources.
    """
    cap = F.col("source_size") * F.lit(float(epochs))
    level, clamped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) >= cap
        got = sources.agg(F.sum(F.when(over, cap)).alias("used"), F.sum(F.when(~over, F.col("weight"))).alias("open"), F.count(F.when(over, 1)).alias("n")).first()
        if got["n"] == clamped or not got["open"]:
            return sources.withColumn("target", F.when(over, cap).otherwise(F.col("weight") * F.lit(level)))
        clamped, level = got["n"], max(level, (budget - (got["used"] or 0.0)) / got["open"])


def plan(slim: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, epochs: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Source table (source, source_size, target, whole, part) and bucket sums, from a written ``sized`` table.

    Sources in code point order, null last, take ``weights`` in turn. ``whole`` is the number of full passes over a
    source and ``part`` the words of one more, partial pass.
    """
    buckets = slim.groupBy("source", F.pmod("h", F.lit(BUCKETS)).cast("int").alias("b")).agg(F.sum("size").alias("bucket_size"))
    buckets = materialize(buckets)
    sizes = buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    ordered = running_total(sizes, [F.col("source").asc_nulls_last()], F.lit(1), "nth")  # however many sources there are
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    sources = materialize(ordered.withColumn("weight", weight).drop("nth"))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    sources = fill(sources, share * total, epochs)
    size = F.col("source_size")
    goal = F.round("target").cast("long")
    times = F.when(size > 0, F.floor(goal / size)).otherwise(0).cast("long")
    sources = sources.withColumn("whole", times).withColumn("part", (goal - times * size).cast("long"))
    return materialize(sources.select("source", "source_size", "target", "whole", "part")), buckets


def _edges(sources: DataFrame, buckets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The source table as a join side, and where the fraction ends in a source: that bucket's index and how much of it is taken."""
    start = F.sum("bucket_size").over(Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    starts = buckets.withColumn("start", F.coalesce(start, F.lit(0)))
    src = sources.select(F.col("source").alias("__s"), "source_size", "target", "whole", "part")
    starts = join_small(starts, src, F.col("source").eqNullSafe(F.col("__s")))
    edges = starts.filter((F.col("start") < F.col("part")) & (F.col("start") + F.col("bucket_size") >= F.col("part")))
    return src, materialize(edges.select(F.col("source").alias("__e"), F.col("b").alias("edge"), (F.col("part") - F.col("start")).alias("left")))


def mix(rows: DataFrame, stats: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """``rows`` (a ``sized`` table) with source_size, target, whole, extra and taken for every row.

    ``stats`` is the written table of their source, size and h, which may be ``rows`` itself.

    Every document is taken ``whole`` times; then documents in seeded order until the source's ``part`` is used up,
    the last of them cut, so the words taken from a source are its target to within rounding. ``extra`` is the
    words of this partial pass. No document is taken more than ``epochs`` times its size. Null sources form one
    source; empty documents take 0; identical rows are interchangeable; an empty table gives no rows.
    """
    sources, buckets = plan(stats, weights, share, epochs)
    src, edges = _edges(sources, buckets)
    names = rows.columns
    rows = join_small(rows, src, F.col("source").eqNullSafe(F.col("__s")))
    rows = join_small(rows, edges, F.col("source").eqNullSafe(F.col("__e")))
    b = F.pmod("h", F.lit(BUCKETS)).cast("int")
    keep = [*names, "source_size", "target", "whole"]
    size = F.col("size")
    at_edge = F.coalesce(b == F.col("edge"), F.lit(False))
    far = rows.filter(~at_edge).select(*keep, F.when(b < F.col("edge"), size).otherwise(0).cast("long").alias("extra"))
    order = Window.partitionBy("source", "edge").orderBy("h", *[c for c in names if c not in ("source", "h")]).rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("left") - F.coalesce(F.sum("size").over(order), F.lit(0))
    near = rows.filter(at_edge).select(*keep, F.greatest(F.lit(0), F.least(room, size)).cast("long").alias("extra"))
    return far.unionByName(near).withColumn("taken", F.col("whole") * size + F.col("extra"))


def repeated(docs: DataFrame, text: str = "text", source: str = "source", weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it, whole documents only.

    The document in which a source's fraction ends is taken once more if half of it or more belongs to the mix. Null
    sources are one source; rows without a word are taken as often as their source as a whole; repeated rows are rows
    of their own, and where the fraction ends between equal ones their order is of no account; other columns, maps
    too, go through as they are; an empty table gives no rows.

    Words are counted once, for the sums of sources and buckets. Rows then go straight to their copies, without being
    written or shuffled; only those of the bucket in which a source's fraction ends are counted and ordered again.
    """
    names = docs.columns
    h = row_hash(docs, F.lit(seed))
    size = F.regexp_count(whole(text), F.lit(WORD)).cast("long")
    sources, buckets = plan(materialize(docs.select(F.col(source).alias("source"), size.alias("size"), h.alias("h"))), weights, share, epochs)
    src, edges = _edges(sources, buckets)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col(text).alias("__text"), F.col(source).alias("source"), h.alias("h"))
    rows = join_small(rows, src, F.col("source").eqNullSafe(F.col("__s")))
    rows = join_small(rows, edges, F.col("source").eqNullSafe(F.col("__e")))
    b = F.pmod("h", F.lit(BUCKETS)).cast("int")
    at_edge = F.coalesce(b == F.col("edge"), F.lit(False))
    once_more = F.coalesce(b < F.col("edge"), F.lit(False)) & whole("__text").rlike(WORD)
    far = rows.filter(~at_edge).select("__row", (F.col("whole") + once_more.cast("long")).alias("times"))
    near = rows.filter(at_edge).select("__row", "source", "h", "whole", "left", F.regexp_count(whole("__text"), F.lit(WORD)).cast("long").alias("size"))
    before = Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("left") - F.coalesce(F.sum("size").over(before), F.lit(0)), F.col("size"))))
    more = (F.col("extra") > 0) & (2 * F.col("extra") >= F.col("size"))
    near = near.select("__row", (F.col("whole") + more.cast("long")).alias("times"))
    copies = far.unionByName(near).select("__row", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))).alias("__n"))
    return copies.select(*[F.col("__row")[c].alias(c) for c in names])

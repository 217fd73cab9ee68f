"""Sharding by a k-d tree: splits at distributed weighted medians along the widest dimension."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.text import whole
from parley.plans.joins import gapless_rank, join_small
from parley.plans.shared import materialize

BINS = 1 << 12
#: A split is final once what lies in the median's bin is this share of a node or less.
TOLERANCE = 0.002
#: A group of equal texts is cut only if it would put a split off by more than this share of the node.
FAIR = 0.02
#: A group of equal texts with more than this share of a mean leaf is placed before the tree is built: 20 a leaf at most.
HEAVY = 0.05
SPAN = 1 << 62


def text_dimensions(text: str = "text") -> list[Column]:
    """Dimensions of a text's own metadata: length, lines, share of letters beyond ASCII, digits. Equal texts are one point."""
    t = whole(text)
    n = F.greatest(F.length(t), F.lit(1))
    return [
        F.log2(F.length(t) + F.lit(1.0)),
        F.log2(F.regexp_count(t, F.lit("\n")) + F.lit(1.0)),
        (F.octet_length(t) - F.length(t)) / n,
        F.regexp_count(t, F.lit("[0-9]")) / n,
    ]


def points(docs: DataFrame, dimensions: list[Column], keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep``, size (UTF-8 bytes plus 1), text_crc32, and per dimension a key that orders by its value, then by text.

    Written once. A key is a 62-bit integer: 24 bits of the value within its range, then bits of the text's hash, so
    a median can fall between texts of equal value but never inside a group of equal texts; ``tie`` orders those.
    Null and non-finite values count as the lowest.
    """
    t = whole(text)
    raw = docs.select(
        *keep,
        (F.octet_length(t) + F.lit(1)).cast("long").alias("size"),
        F.crc32(t.cast("binary")).cast("long").alias("text_crc32"),
        F.array(*[F.when(F.isnan(d) | d.isNull() | (F.abs(d) == F.lit(math.inf)), None).otherwise(d).cast("double") for d in dimensions]).alias("__v"),
        F.shiftrightunsigned(F.xxhash64(t), 26).alias("__th"),
        F.shiftrightunsigned(F.xxhash64(F.lit(5), *keep), 2).alias("tie"),
    )
    raw = materialize(raw)
    k = len(dimensions)
    got = raw.agg(*[f(F.col("__v")[i]).alias(f"{n}{i}") for i in range(k) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    keys = []
    for i in range(k):
        lo, hi = got[f"lo{i}"] or 0.0, got[f"hi{i}"] or 0.0
        scaled = F.floor((F.coalesce(F.col("__v")[i], F.lit(lo)) - F.lit(lo)) * F.lit(((1 << 24) - 1) / (hi - lo) if hi > lo else 0.0)).cast("long")
        keys.append(F.shiftleft(scaled, 38) + F.col("__th"))
    return raw.select(*keep, "size", "text_crc32", F.array(*keys, F.col("tie")).alias("__keys"))


def _median(table: DataFrame, share: dict[int, float]) -> dict[int, tuple[int, float | None]]:
    """Per node the key at which its upper part starts, so that the rows below hold ``share`` of its weight.

    ``table`` has node, key and size. Each round bins the interval of every open node; the driver sees at most 2^20
    sums (16 to BINS a node) and narrows to the bin in which the median lies. If a single key outweighs a fair split,
    the second value is the share of that key's weight which belongs below.
    """
    at, below = {n: (0, SPAN) for n in share}, dict.fromkeys(share, 0)
    total: dict[int, int] = {}
    done: dict[int, tuple[int, float | None]] = {}
    while open_ := [n for n in share if n not in done]:
        bins = min(BINS, max(16, (1 << 20) // len(open_)))
        width = {n: -(-(at[n][1] - at[n][0]) // bins) for n in open_}
        bounds = table.sparkSession.createDataFrame([(n, *at[n], width[n]) for n in open_], "node long, lo long, hi long, width long")
        inside = table.join(F.broadcast(bounds), "node").filter("key >= lo and key < hi")
        sums: dict[int, list[tuple[int, int]]] = {n: [] for n in open_}
        for n, b, s in inside.groupBy("node", F.expr("(key - lo) div width").alias("bin")).agg(F.sum("size")).collect():
            sums[n].append((b, s))
        for n in open_:
            total.setdefault(n, sum(s for _, s in sums[n]))
            goal, run, b, s = share[n] * total[n], below[n], 0, 0
            for b, s in sorted(sums[n]):
                if run + s >= goal:
                    break
                run += s
            left, right = at[n][0] + b * width[n], at[n][0] + (b + 1) * width[n]
            over = run + s - goal
            if min(goal - run, over) <= TOLERANCE * max(1, total[n]) or not s:
                done[n] = (left if goal - run <= over else right, None)
            elif width[n] == 1:
                done[n] = (left, (goal - run) / s) if min(goal - run, over) > FAIR * total[n] else (left if goal - run <= over else right, None)
            else:
                at[n], below[n] = (left, right), run
    return done


def _heavy(table: DataFrame, mean: float) -> list[tuple[int, int, int, int | None, int]]:
    """Groups of equal texts too heavy for a split to fall beside them: text hash, size, crc32, tie and weight.

    A group up to a mean leaf is one entry, its tie null. A heavier one is an entry per row if its rows are heavy
    themselves; if they are light it is left out, as a split can cut it. There are at most 1 / HEAVY a leaf.
    """
    groups = table.groupBy(_text_hash().alias("th"), "size", "text_crc32").agg(F.sum("size").alias("weight"))
    groups = groups.filter(F.col("weight") > F.lit(HEAVY * mean))
    found = [(r["th"], r["size"], r["text_crc32"], None, r["weight"]) for r in groups.collect()]
    whole_groups = [g for g in found if g[4] <= mean]
    if apart := [g[:3] for g in found if g[4] > mean and g[1] > HEAVY * mean]:
        named = F.broadcast(table.sparkSession.createDataFrame(apart, "th long, size long, text_crc32 long"))
        rows = table.withColumn("th", _text_hash()).filter(F.col("size") > F.lit(HEAVY * mean)).join(named, ["th", "size", "text_crc32"])
        rows = rows.groupBy("th", "size", "text_crc32", F.element_at("__keys", -1).alias("tie")).agg(F.sum("size").alias("weight"))
        whole_groups += [tuple(r) for r in rows.collect()]
    return sorted(whole_groups, key=lambda g: (-g[4], g[:3], g[3] or 0))


def _text_hash() -> Column:
    return F.element_at("__keys", 1).bitwiseAND(F.lit((1 << 38) - 1))


def _room(held: list[int], rest: int) -> list[float]:
    """What each leaf still takes of ``rest`` so that the least filled ones come level."""
    level, below = 0.0, 0
    for i, h in enumerate(sorted(held), 1):
        below += h
        level = (rest + below) / i
        if i == len(held) or level <= sorted(held)[i]:
            break
    return [max(0.0, level - h) for h in held]


def kd_shards(table: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Add ``shard`` to a ``points`` table: leaves of a k-d tree over it, near equal in bytes.

    Either ``shards`` leaves, or as many as bring a leaf to ``target_bytes``. Groups of equal texts that weigh more
    than HEAVY of a leaf go to leaves first, the heaviest to the emptiest leaf; the tree deals out the rest, each
    leaf taking what it has room for. A node is split along the dimension in which its rows spread widest (range
    between its 5 % and 95 % marks), at the weighted median, or at the share its lower leaves have room for. A group
    of light rows heavier than a leaf is cut, by ``tie``. Splits are found for all nodes of a level at once. An
    empty table stays empty.
    """
    spark = table.sparkSession
    total = table.agg(F.sum("size")).first()[0] or 0
    if not total:
        return table.withColumn("shard", F.lit(0))
    count = shards or max(1, math.ceil(total / (target_bytes or max(1, total))))
    k = table.select(F.size("__keys")).first()[0] - 1
    held, fixed = [0] * count, []
    queue = [(0, i) for i in range(count)]
    for *group, weight in _heavy(table, total / count):
        _, i = heapq.heappop(queue)
        held[i] += weight
        fixed.append((*group, -1 - i))
        heapq.heappush(queue, (held[i], i))
    room = _room(held, total - sum(held))
    if fixed:
        names = spark.createDataFrame(fixed, "f_th long, f_size long, f_crc long, f_tie long, f_node long")
        same = (_text_hash() == F.col("f_th")) & (F.col("size") == F.col("f_size")) & (F.col("text_crc32") == F.col("f_crc"))
        same &= F.col("f_tie").isNull() | (F.col("f_tie") == F.element_at("__keys", -1))
        table = join_small(table, names, same).withColumn("node", F.coalesce("f_node", F.lit(1).cast("long"))).select(*table.columns, "node")
    else:
        table = table.withColumn("node", F.lit(1).cast("long"))
    leaves = {1: (0, count)}
    spread = [F.percentile_approx(F.shiftright(F.col("__keys")[i], 38), [0.05, 0.95], 1000).alias(f"d{i}") for i in range(k)]
    while open_ := {n for n, (_, m) in leaves.items() if m > 1}:
        live = table.filter("node > 0")
        dims = {r["node"]: max(range(k), key=lambda i: (r[f"d{i}"][1] - r[f"d{i}"][0], -i)) for r in live.groupBy("node").agg(*spread).collect() if r["node"] in open_}
        share = {}
        for n in dims:
            at, m = leaves[n]
            lower, both = sum(room[at : at + m // 2]), sum(room[at : at + m])
            share[n] = lower / both if both else 0.5
        if dims:
            chosen = F.broadcast(spark.createDataFrame(list(dims.items()), "node long, dim int"))
            keyed = live.join(chosen, "node").select("node", F.element_at("__keys", F.col("dim") + 1).alias("key"), F.element_at("__keys", -1).alias("tie"), "size")
            cuts = _median(keyed, share)
            ties = dict.fromkeys(cuts, 0)
            if heavy := {n: part for n, (_, part) in cuts.items() if part is not None}:
                at = F.broadcast(spark.createDataFrame([(n, cuts[n][0]) for n in heavy], "node long, cut long"))
                group = keyed.join(at, "node").filter("key = cut").select("node", F.col("tie").alias("key"), "size")
                ties |= {n: cut for n, (cut, _) in _median(group, heavy).items()}
            split = spark.createDataFrame([(n, dims[n], cuts[n][0], ties[n]) for n in dims], "node long, dim int, cut long, tie long")
            key = F.element_at("__keys", F.col("dim") + 1)
            up = (key > F.col("cut")) | ((key == F.col("cut")) & (F.element_at("__keys", -1) >= F.col("tie")))
            table = table.join(F.broadcast(split), "node", "left")
            table = table.withColumn("node", F.when(F.col("dim").isNull(), F.col("node")).otherwise(2 * F.col("node") + up.cast("long")))
            table = materialize(table.drop("dim", "cut", "tie"))
        for n in open_:  # a node without rows has empty leaves
            at, m = leaves.pop(n)
            leaves |= {2 * n: (at, m // 2), 2 * n + 1: (at + m // 2, m - m // 2)}
    names = spark.createDataFrame([(n, at) for n, (at, _) in leaves.items()] + [(-1 - i, i) for i in range(count)], "node long, shard int")
    return table.join(F.broadcast(names), "node").drop("node")


def assign(docs: DataFrame, shards: int = 8, dimensions: list[Column] | None = None, text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Equal texts share a shard unless their group alone outweighs a fair share, the mean of all shards. A null text has size 1 and the crc32
    of no bytes, 0. ``slot`` numbers a shard's rows from 0 without gaps. Repeated rows are placed row by row; other
    columns are ignored; an empty table gives no rows.
    """
    placed = kd_shards(points(docs, dimensions or text_dimensions(text), ("doc_id",), text), shards)
    placed = placed.select("doc_id", "size", "text_crc32", "shard")
    ranked = gapless_rank(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

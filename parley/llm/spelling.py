"""Spelling variants of a vocabulary: a trie self-join with active-node sets at distance one.

Words come in prefix partitions. For the lengths (a, a + 1) of two words, h = a div 2: either both share their first h
code points, or the edit lies before and both share their last h, that is, the first h of the reversed words. So each
word stands, for its own length and the length below, in one partition of words and one of reversed words, and no pair
needs words of two partitions. A pair found among reversed words counts only if the first h code points differ.

In a partition the trie of what follows the common prefix grows level by level. The nodes at distance 0 of a node are
itself; those at distance 1 are kept as pairs: of equal depth (one code point replaced), or one deeper (one inserted).
Going down, pairs live on only through equal code points, and every level adds its siblings and children anew.
Terminal pairs are the words near each other. A partition of more than MOST words does one level by a shuffle (words
that agree but for the next code point meet), and its words go on in the partitions of longer prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.text import whole
from parley.plans.shared import materialize, scratch

#: Runs of letters that are words.
RUN = r"([A-Za-zÀ-ÿ]+)"
#: Code points of a word at least, and its occurrences.
SHORTEST, OCCURRENCES = 6, 5
#: A form occurs so many times as often as its variant.
TIMES = 5
#: Words of one trie; a partition with more is split by its next code point.
MOST = 20_000
#: One run in so many loses a code point in ``vocabulary``.
DAMAGE = 199

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PAIRS = "word string, n long, near string, near_n long"


def vocabulary(docs: DataFrame, text: str = "text", key: str = "doc_id", shortest: int = SHORTEST, occurrences: int = OCCURRENCES, damage: int | None = DAMAGE) -> DataFrame:
    """(word, n): the runs of letters of all texts, A-Z in lower case, long and frequent enough, with their count.

    With ``damage``, a run loses a code point if that number divides the CRC-32 of ``<key>:<run>``. A null text has
    no runs, a null key is written as nothing; repeated rows count each.
    """
    runs = docs.select(F.col(key).cast("string").alias("__key"), F.explode(F.regexp_extract_all(whole(text), F.lit(RUN), F.lit(1))).alias("__run"))
    runs = runs.filter(F.length("__run") >= shortest).select("__key", F.translate("__run", _UPPER, _UPPER.lower()).alias("word"))
    if damage:
        h = F.crc32(F.concat(F.coalesce("__key", F.lit("")), F.lit(":"), F.col("word")))
        at = (h % F.length("word")).cast("int")
        cut = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
        runs = runs.select(F.when(h % damage == 0, cut).otherwise(F.col("word")).alias("word")).filter(F.length("word") >= shortest)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= occurrences)


def _partitioned(words: DataFrame) -> DataFrame:
    """Each word in its partitions: (a, back, prefix), ``back`` for reversed words."""
    a = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("a")
    rows = words.filter(F.length("word") > 0).select("word", "n", a).filter("a > 0").select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))
    return rows.withColumn("prefix", F.substring(_spelt(), F.lit(1), F.expr("a div 2").cast("int")))


def _spelt() -> Column:
    return F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word"))


def _new_pair(a: str, b: str) -> Column:
    """Among reversed words: whether the first code points differ, so that the pair isn't found by the words themselves."""
    half = lambda c: F.substring(F.col(c), F.lit(1), F.expr("a div 2").cast("int"))
    return ~F.col("back") | (half(a) != half(b))


def _one_level(rows: DataFrame) -> DataFrame:
    """Pairs that part right behind the common prefix of their partition."""
    at = F.length("prefix")
    spelt, short = _spelt(), F.length("word") == F.col("a")
    without = F.concat("prefix", F.substring(spelt, at + 2, F.length("word")))
    rows = rows.withColumn("__next", F.substring(spelt, at + 1, F.lit(1)))
    # Short words meet without their next code point (replaced); a short word as it is meets long ones without theirs.
    replaced = rows.filter(short & (F.length("word") > at)).select("a", "back", "word", "n", "__next", without.alias("__rest"), F.lit(True).alias("__one"), F.lit(True).alias("__two"))
    inserted = rows.select("a", "back", "word", "n", "__next", F.when(short, spelt).otherwise(without).alias("__rest"), short.alias("__one"), (~short).alias("__two"))
    meet = replaced.withColumn("__kind", F.lit(0)).union(inserted.withColumn("__kind", F.lit(1)))
    left = meet.filter("__one").select("a", "back", "__kind", "__rest", "word", "n", F.col("__next").alias("__l"))
    right = meet.filter("__two").select("a", "back", "__kind", "__rest", F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("__next").alias("__r"))
    pairs = left.join(right, ["a", "back", "__kind", "__rest"]).filter((F.col("__l") != F.col("__r")) & _new_pair("word", "near"))
    once = pairs.filter((F.col("__kind") == 1) | (F.col("word") < F.col("near"))).select("word", "n", "near", "near_n")
    return once.union(once.select("near", "near_n", "word", "n"))


def _children(keys: np.ndarray, parents: np.ndarray, chars: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the children by ``chars`` of ``parents`` in a level with sorted ``keys``: which exist, and their numbers."""
    want = parents * width + chars
    at = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
    there = (keys[at] == want) if len(keys) else np.zeros(len(want), bool)
    return there, at[there]


def _expanded(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range its number, repeated, beside all its members."""
    size = end - begin
    who = np.repeat(np.arange(len(size)), size)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size) + begin[who]


class _Level:
    """Nodes of one depth, sorted by parent and code point: key, parent, code point, the word that ends here or -1."""

    def __init__(self, parent: np.ndarray, char: np.ndarray, word: np.ndarray, width: int):
        self.parent, self.char, self.word = parent, char, word
        self.key = parent * width + char

    def ranges(self, parents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.parent, parents), np.searchsorted(self.parent, parents, side="right")


def _levels(group: np.ndarray, flat: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> Iterator[_Level]:
    """The tries of all groups, depth by depth; rows are sorted by group and by code points, each once."""
    first = np.r_[True, group[1:] != group[:-1]]
    node = np.cumsum(first) - 1
    ends = np.full(int(node[-1]) + 1, -1)
    ends[node[size == 0]] = np.flatnonzero(size == 0)
    yield _Level(np.zeros(len(ends), np.int64), np.arange(len(ends)), ends, width)
    depth, alive = 0, np.flatnonzero(size > 0)
    node = node[alive]
    while len(alive):
        char = flat[start[alive] + depth].astype(np.int64)
        first = np.r_[True, (node[1:] != node[:-1]) | (char[1:] != char[:-1])]
        own = np.cumsum(first) - 1
        depth += 1
        done = size[alive] == depth
        ends = np.full(int(own[-1]) + 1, -1)
        ends[own[done]] = alive[done]
        yield _Level(node[first], char[first], ends, width)
        alive, node = alive[~done], own[~done]


def near_pairs(group: np.ndarray, rests: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of equal groups whose rests differ by one code point: replaced (i < j) or inserted in j. Rows are sorted and distinct."""
    size = np.array([len(r) for r in rests], dtype=np.int64)
    flat = np.frombuffer("".join(rests).encode("utf-32-le"), dtype="<u4")
    width = int(flat.max(initial=0)) + 2
    found: list[tuple[np.ndarray, np.ndarray]] = []
    none = np.empty(0, np.int64)
    levels = _levels(group, flat, np.cumsum(size) - size, size, width)
    here, below = next(levels), next(levels, None)
    same_u, same_v, deep_u, deep_v = none, none, none, none  # active pairs of equal depth, and with one node of the next depth
    while True:
        if below is not None:  # every child is one insertion away from its node
            pairs = np.unique(np.r_[deep_u * len(below.key) + deep_v, below.parent * len(below.key) + np.arange(len(below.key))])
            deep_u, deep_v = pairs // len(below.key), pairs % len(below.key)
        found.append((here.word[same_u], here.word[same_v]))
        if below is None:
            break
        found.append((here.word[deep_u], below.word[deep_v]))
        after = next(levels, None)
        who, u = _expanded(*below.ranges(same_u))
        there, v = _children(below.key, same_v[who], below.char[u], width)
        rank = np.arange(len(below.key))
        sibling, later = _expanded(rank + 1, np.searchsorted(below.parent, below.parent, side="right"))
        same_u, same_v = np.r_[u[there], sibling], np.r_[v, later]
        if after is not None:
            who, u = _expanded(*below.ranges(deep_u))
            there, v = _children(after.key, deep_v[who], below.char[u], width)
            deep_u, deep_v = u[there], v
        here, below = below, after
        if after is None:
            deep_u, deep_v = none, none
    left, right = (np.concatenate(x) for x in zip(*found, strict=True))
    both = (left >= 0) & (right >= 0)
    return left[both], right[both]


def _joined(rows: pa.Table) -> pa.RecordBatch:
    """Near pairs, both ways, of whole partitions."""
    a, words, n = rows.column("a").to_numpy(), rows.column("word").to_pylist(), rows.column("n")
    back, prefixes = rows.column("back").to_pylist(), rows.column("prefix").to_pylist()
    rests = [(w[::-1] if b else w)[len(p) :] for w, b, p in zip(words, back, prefixes, strict=True)]
    keys: dict = {}
    group = np.array([keys.setdefault(k, len(keys)) for k in zip(a.tolist(), back, prefixes, strict=True)], dtype=np.int64)
    order = np.array(sorted(range(len(rests)), key=lambda i: (group[i], rests[i])), dtype=np.int64)
    left, right = near_pairs(group[order], [rests[i] for i in order])
    left, right = order[left], order[right]
    length = np.array([len(w) for w in words], dtype=np.int64)
    right_length = (length[left] == a[left]) & (length[right] <= a[left] + 1)
    left, right = left[right_length], right[right_length]
    half = a // 2
    new = np.array([not back[i] or words[i][: half[i]] != words[j][: half[i]] for i, j in zip(left.tolist(), right.tolist(), strict=True)], dtype=bool)
    left, right = left[new], right[new]
    i, j = pa.array(np.r_[left, right]), pa.array(np.r_[right, left])
    column, n = pa.array(words, pa.string()), n.combine_chunks()
    return pa.RecordBatch.from_arrays([column.take(i), n.take(i), column.take(j), n.take(j)], names=["word", "n", "near", "near_n"])


def _tries(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by partition; whole partitions are joined, several small ones at once."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        key = [batch.column(i).to_pylist() for i in range(3)]
        at = batch.num_rows - 1
        while at > 0 and all(c[at] == c[at - 1] for c in key):
            at -= 1  # the last partition of this batch may go on in the next one
        starts_new = not held or [held[-1].column(i)[held[-1].num_rows - 1].as_py() for i in range(3)] != [c[0] for c in key] if batch.num_rows else False
        upto = at if at > 0 or starts_new else 0
        if count + upto >= most and (upto > 0 or starts_new):
            if upto:
                held.append(batch.slice(0, upto))
            if held:
                yield _joined(pa.Table.from_batches(held))
            held, count, batch = [], 0, batch.slice(upto)
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
    if held:
        yield _joined(pa.Table.from_batches(held))


def pairs(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n, near, near_n), both ways: words of the written ``words`` (word, n) that differ by one code point.

    Words are distinct and not null; words of any length take part, the empty one excepted. Written tables.
    """
    rows = _partitioned(words)
    found = []
    while True:
        rows = materialize(rows)
        hot = rows.groupBy("a", "back", "prefix").agg(F.count(F.lit(1)).alias("__m"), F.max(F.length("word")).alias("__longest")).filter(F.col("__m") > most).drop("__m")
        hot = materialize(hot)
        keys = ["a", "back", "prefix"]
        cool = rows.join(hot, keys, "left_anti") if (some := not hot.isEmpty()) else rows
        found.append(cool.select(*keys, "word", "n").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda batches: _tries(batches, most), _PAIRS))
        if not some:
            break
        rows = materialize(rows.join(hot.drop("__longest"), keys))
        found.append(_one_level(rows))
        rows = rows.filter(F.length("word") > F.length("prefix")).withColumn("prefix", F.substring(_spelt(), F.lit(1), F.length("prefix") + 1))
    out = found[0]
    for part in found[1:]:
        out = out.union(part)
    return out


def forms(words: DataFrame, times: int = TIMES, most: int = MOST) -> DataFrame:
    """Of each word of (word, n): form, root, n, n_near, form_n.

    The form is the near word of largest n (the smallest, if several), if it occurs ``times`` as often; the root is
    reached by following forms, whose counts grow by that factor, so the chain is short. An empty table gives no rows.
    """
    spark = words.sparkSession
    with scratch(spark):
        words = materialize(words)
        best = pairs(words, most).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near"))).alias("__best"))
        is_form = -F.col("__best.m") >= times * F.col("n")
        best = materialize(best.select("word", "n_near", F.when(is_form, F.col("__best.near")).alias("form"), F.when(is_form, -F.col("__best.m")).alias("form_n")))
        chain = materialize(best.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
        while True:
            step = chain.select(F.col("word").alias("root"), F.col("root").alias("__further"))
            further = materialize(chain.join(step, "root", "left").select("word", F.coalesce("__further", "root").alias("root"), F.col("__further").isNotNull().alias("__moved")))
            chain = further.drop("__moved")
            if further.filter("__moved").isEmpty():
                break
        out = words.join(best, "word", "left").join(chain, "word", "left")
        return materialize(out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"), keep=True)

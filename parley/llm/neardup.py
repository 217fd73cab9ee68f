"""SimHash near-duplicates by pivot distance tables: precomputed distances deal pairs out and discard them, survivors are verified.

Every distinct fingerprint has a row of Hamming distances to fixed reference fingerprints, written once. By the
triangle inequality two linked fingerprints differ by at most ``LIMIT`` in every one of these coordinates. A distance
is the sum of those within the parts that the 64 bits are cut into; of ``LIMIT`` + 1 parts one has no differing bit,
so there all pivot distances of two linked fingerprints are equal, and these name the cell that they share. Only where a
cell still holds too many, the other bits are cut again. Inside a cell, pairs with a larger coordinate difference are
discarded and the rest are verified by their bits. A cell gives a spanning forest of its links, never all pairs.

For a similarity of whole shingle sets (``one_of_each`` with ``similarity``) the fingerprints that pivots link come
first, and the sets decide on them. Most similar texts differ in more bits than pivots can discard by, so these meet
by shingles as well: of two sets with Jaccard similarity t, each holds a common
shingle among its first n - ceil(t n) + 1 in any fixed order. The order puts shingles last that a bitmap marks as
common, so that passages which many texts share bring few of them together. Sizes and a bound of the common
shingles by small bitmaps discard pairs where they meet, and the sets decide.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.text import whole
from parley.llm.tokens import slices
from parley.plans.joins import join_small, row_hash, sieved
from parley.plans.shared import materialize, scratch, small_batches

LIMIT = 2
SHINGLE = 3
#: For near copies by similarity: words of a shingle, the similarity, and the differing bits up to which two texts are
#: looked at first. At similarity 0.8 about ten bits differ, with a deviation of three.
WORDS_NEAR, SIMILARITY, LIMIT_NEAR = 5, 0.8, 22
#: Fingerprints of a cell above which it is cut, and how often at most: a cut gives limit + 1 copies of what it cuts.
HOT_KEY, CUTS = 1000, 3
N_PIVOTS = 24
#: Reports from which a shingle counts as common, bits of the bitmap of common ones, and shingles that a task holds to find them.
COMMON, COMMON_BITS, HELD = 8, 1 << 24, 1 << 22
#: Pairs of a cell that are looked at together: so many first fingerprints with all their candidates.
ROWS = 256
#: 64-bit words of the bitmap of a text's shingles, and texts from which those that share a shingle meet in blocks.
SKETCH, BLOCK = 32, 1024
#: Least tokens that a text is known by, and what stands for none: the greatest long, before which all others come.
LEAST, _NONE = 8, (1 << 63) - 1


def pivots() -> np.ndarray:
    """Reference fingerprints: fixed 64-bit values derived from a crc of their number."""
    return np.array([zlib.crc32(b"pivot%d" % i) << 32 | zlib.crc32(b"reference%d" % i) for i in range(N_PIVOTS)], dtype=np.uint64)


def fingerprint(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """64-bit SimHash of each text: a bit is set if it is set in over half of the XXH64 (seed 42) of its shingles."""
    out = np.zeros(len(texts), dtype=np.uint64)
    for i, t in enumerate(texts):
        words = _words(t)
        if words:
            out[i] = _simhash(_hashes(words, shingle))
    return out


def _words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []  # bytes: only A-Z are lowered, only the six blanks split


def _hashes(words: list[bytes], shingle: int) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[j:] for j in range(shingle)), strict=False))
    return np.array([digest(g, 42) for g in grams], dtype=np.uint64)


def _simhash(h: np.ndarray) -> np.uint64:
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[k : k + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h)).view(">u8")[0]


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE) -> DataFrame:
    """``keep`` and fp (the fingerprint's 64 bits as a long) of every whole text. No word (or null): 0."""
    slim = docs.select(*keep, whole(text).alias("__text"))
    schema = slim.select(*keep).withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = pa.array(fingerprint(b.column(b.num_columns - 1).to_pylist(), shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], fp], names=[*keep, "fp"])

    return slim.mapInArrow(run, schema)


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def group_links(fp: np.ndarray, table: np.ndarray, limit: int = LIMIT) -> list[tuple[int, int]]:
    """Links (i, j) that join the fingerprints of one cell into the components that all its links give.

    ``table`` has their pivot distances. Candidates are a stretch of the order by the first pivot; the maximum
    coordinate difference discards pairs, some pivots at a time, and the bits decide. A part of the pairs is held
    at a time, so memory follows the cell and not its pairs.
    """
    order = np.argsort(table[:, 0], kind="stable")
    fp, table = fp[order], table[order]
    parent, links = np.arange(len(fp)), []
    ends = np.searchsorted(table[:, 0], table[:, 0] + limit, side="right")
    for s in range(0, len(fp), ROWS):
        e = min(s + ROWS, len(fp))
        for c in range(s, int(ends[e - 1]), 1 << 13):
            near = np.ones((e - s, min(c + (1 << 13), int(ends[e - 1])) - c), dtype=bool)
            for k in range(6):
                near &= np.abs(table[s:e, k, None] - table[None, c : c + near.shape[1], k]) <= limit
            i, j = np.nonzero(near)
            i, j = i + s, j + c
            i, j = i[j > i], j[j > i]
            for k in range(6, N_PIVOTS, 6):
                ok = (np.abs(table[i, k : k + 6] - table[j, k : k + 6]) <= limit).all(axis=1)
                i, j = i[ok], j[ok]
            ok = np.bitwise_count(fp[i] ^ fp[j]) <= limit
            for x, y in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
                a, b = _find(parent, x), _find(parent, y)
                if a != b:
                    parent[b] = a
                    links.append((int(order[x]), int(order[y])))
    return links


def pivot_table(distinct: DataFrame) -> DataFrame:
    """``fp`` and ``table``, its distances to all pivots as one byte each."""
    return distinct.select("fp", F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(p)))).cast("tinyint") for p in pivots().view(np.int64)]).alias("table"))


def cells(table: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(cell, fp, table): the written pivot ``table`` dealt into cells, so that linked fingerprints share one.

    A cell with more than HOT_KEY, at first that of all, is cut: the bits at which its fingerprints may still differ are
    dealt into ``limit`` + 1 parts, and each fingerprint goes to one cell a part, named by its distances to all pivots
    within that part. Linked ones have all these distances equal in a part without a differing bit. So copies don't grow
    with the table: ``limit`` + 1 a cut, and only what is still crowded is cut again, CUTS times at most.
    """
    now, small, open_ = table.withColumns({"cell": F.lit(0).cast("long"), "__open": F.lit(0)}), [], [(1 << 64) - 1]
    for _ in range(CUTS):
        hot = materialize(now.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_KEY).select(F.col("cell").alias("hot")))
        if hot.isEmpty():
            break
        marked = join_small(now, hot, F.col("cell") == F.col("hot"))
        small.append(marked.filter("hot is null").select("cell", "fp", "table"))
        dealt = [_parts(bits, limit + 1) for bits in open_]
        masks = F.array(*[F.lit(_long(part)) for parts in dealt for part in parts])
        open_ = [bits & ~part for bits, parts in zip(open_, dealt, strict=True) for part in parts]
        cut = marked.filter("hot is not null").select("fp", "table", "cell", "__open", F.explode(F.sequence(F.lit(0), F.lit(limit))).alias("__part"))
        cut = cut.withColumn("__open", F.col("__open") * (limit + 1) + F.col("__part")).withColumn("__mask", F.get(masks, F.col("__open")))
        within = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(p))).bitwiseAND(F.col("__mask"))) for p in pivots().view(np.int64)]
        # A hash names the cell in the cell; should two names agree, more pairs are looked at.
        now = materialize(cut.select("fp", "table", F.xxhash64("cell", "__open", *within).alias("cell"), "__open"))
    for x in small:
        now = now.select("cell", "fp", "table").unionByName(x)
    return now.select("cell", "fp", "table")


def _parts(bits: int, n: int) -> list[int]:
    """The set bits of a mask dealt in turn to ``n`` masks."""
    at = [1 << i for i in range(64) if bits >> i & 1]
    return [sum(at[k::n]) for k in range(n)]


def _long(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def links(distinct: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) between fingerprints of a written table with one row per distinct ``fp``."""
    dealt = cells(materialize(pivot_table(distinct)), limit).repartition("cell").sortWithinPartitions("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, N_PIVOTS), np.int8))
        for b in _and_end(batches):
            got = rest
            if b is not None:
                new = (b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).flatten().to_numpy().reshape(-1, N_PIVOTS))
                got = tuple(np.concatenate(x) for x in zip(rest, new, strict=True))
            cell, fp, table = got
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.empty(0, np.int64)
            if b is not None and len(starts):
                whole_ = starts[-1]  # the last cell may go on in the next batch
                rest, starts, fp = tuple(x[whole_:] for x in got), starts[:-1], fp[:whole_]
            sizes = np.diff(np.r_[starts, len(fp)])
            u = fp.view(np.uint64)
            two = starts[sizes == 2]  # many cells hold two: one step for all of them
            two = two[(np.abs(table[two] - table[two + 1]) <= limit).all(axis=1)]
            two = two[np.bitwise_count(u[two] ^ u[two + 1]) <= limit]
            a, z = [fp[two]], [fp[two + 1]]
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                if found := group_links(u[s : s + n], table[s : s + n], limit):
                    pairs = np.array(found) + s
                    a.append(fp[pairs[:, 0]])
                    z.append(fp[pairs[:, 1]])
            a, z = np.concatenate(a), np.concatenate(z)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(z)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _and_end(batches):
    yield from batches
    yield None


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node that it reaches.

    Rounds of large-star and small-star steps, each written to the shared folder; they end when a round changes
    nothing. Hot centres are joined by shuffles that adaptive execution can split; counts alone reach the driver.
    """
    spark = edges.sparkSession
    with scratch(spark):
        state, mark = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
        while True:
            now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == mark:
                found = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
                return materialize(found.unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), keep=True)
            mark = now
            both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
            large = large.unionByName(least.filter("u <> m").select("u", F.col("m").alias("v"))).distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            state = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())


def classes(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Written (fp, root) for every distinct fingerprint of a written table: root is the smallest that it reaches by links."""
    with scratch(prints.sparkSession):
        distinct = materialize(prints.select("fp").distinct())
        found = components(materialize(links(distinct, limit)))
        return materialize(distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")), keep=True)


def common_shingles(docs: DataFrame, text: str, shingle: int) -> np.ndarray:
    """A bitmap of COMMON_BITS bits, 64-bit hash by its last bits, of shingles that stand in many texts.

    Tasks report shingles that two of the texts they hold at a time share; a shingle with COMMON reports or more in
    all is marked. The bitmap only orders shingles, by a rule that depends on nothing but the hash, so whatever it
    marks, no pair is lost. It has the same size for every corpus and is all that the driver gets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names, n = [], set(), 0

        def shared() -> pa.RecordBatch:
            token, times = np.unique(np.concatenate(held), return_counts=True)
            often = times > 1
            return pa.RecordBatch.from_arrays([pa.array(token[often].view(np.int64)), pa.array(times[often].astype(np.int64))], names=["token", "n"])

        for b in slices(batches):
            for t in b.column(0).to_pylist():
                words = _words(t)
                name = hash(tuple(words))
                if not words or name in names:
                    continue
                names.add(name)
                held.append(np.unique(_hashes(words, shingle)))
                n += len(held[-1])
                if n > HELD:
                    yield shared()
                    held, names, n = [], set(), 0
        if held:
            yield shared()

    seen = docs.select(whole(text).alias("__text")).mapInArrow(run, "token long, n long")
    often = seen.groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON)
    bit = F.col("token").bitwiseAND(F.lit(COMMON_BITS - 1)) + 1
    with small_batches(docs.sparkSession):
        rows = often.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    found = np.zeros(COMMON_BITS // 8, dtype=np.uint8)
    for r in rows:
        found[(r["part"] - 1) * 4096 : r["part"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return found


def shingle_sets(docs: DataFrame, text: str, keep: tuple[str, ...], shingle: int, similarity: float | None = None, common: np.ndarray | None = None) -> DataFrame:
    """``keep``, name (a hash of the text's words), fp, size, sketch and grams of every whole text.

    ``grams`` are its distinct shingle hashes in order, ``size`` their number, and ``sketch`` a bitmap of them all. With ``similarity`` only the first
    of them are given, of which a text of that similarity holds one among its own first: in the order of the hashes,
    those that the bitmap ``common`` marks behind the others.
    """
    slim = docs.select(*keep, whole(text).alias("__text"))
    long = F.lit(0).cast("long")
    many = F.array().cast("array<bigint>")
    schema = slim.select(*keep).withColumns({"name": long, "fp": long, "size": long, "sketch": many, "grams": many}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in slices(batches):
            names, fps, sizes, sketches, sets = [], [], [], [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                words = _words(t)
                h = _hashes(words, shingle) if words else np.empty(0, np.uint64)
                names.append(xxhash.xxh64_intdigest(b" ".join(words), 7))
                fps.append(_simhash(h) if words else 0)
                distinct = np.unique(h.view(np.int64))
                sizes.append(len(distinct))
                sketches.append(_sketch(distinct))
                if similarity is not None:
                    if common is not None:
                        at = distinct.view(np.uint64) & np.uint64(COMMON_BITS - 1)
                        marked = common[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1
                        distinct = distinct[np.argsort(marked, kind="stable")]
                    distinct = distinct[: _first(len(distinct), similarity)]
                sets.append(distinct)
            grams = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)]).astype(np.int32), pa.array(np.concatenate(sets)))
            bits = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * SKETCH, pa.array(np.concatenate(sketches)))
            longs = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (names, fps, sizes)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *longs, bits, grams], names=[*keep, "name", "fp", "size", "sketch", "grams"])

    return slim.mapInArrow(run, schema)


def _sketch(distinct: np.ndarray) -> np.ndarray:
    """A bitmap with the bits that the top bits of the hashes name."""
    bits = np.zeros(SKETCH * 64, dtype=bool)
    bits[(distinct.view(np.uint64) >> np.uint64(40)).astype(np.int64) % len(bits)] = True
    return np.packbits(bits).view(np.int64)


def may_be_similar(size_a, sketch_a, size_b, sketch_b, similarity: float):
    """Whether sets of these sizes and (unsigned) bitmaps can have the similarity: a bit of one alone is a shingle of it alone."""
    a = size_a - np.bitwise_count(sketch_a & ~sketch_b).sum(axis=-1, dtype=np.int64)
    b = size_b - np.bitwise_count(sketch_b & ~sketch_a).sum(axis=-1, dtype=np.int64)
    return np.minimum(a, b) * (1 + similarity) >= similarity * (size_a + size_b) - 1e-9


def _first(n: int, similarity: float) -> int:
    """Of ``n`` shingles in a fixed order, how many must be looked at to meet every set of this similarity."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def _near(fp, size, i, j, limit: int, similarity: float):
    """Which of the pairs (i, j) sizes and bits let pass."""
    small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    return (small >= similarity * large - 1e-9) & (np.bitwise_count(fp[i] ^ fp[j]) <= limit)


def close_names(texts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Pairs (a, b) of names of (name, fp) whose fingerprints pivot tables link: at most ``limit`` differing bits.

    Names of one fingerprint are paired with the least of them, and these by a spanning forest of the links, so the rows
    follow the names.
    """
    texts = materialize(texts.select("name", "fp"))
    heads = materialize(texts.groupBy("fp").agg(F.min("name").alias("head")))
    same = texts.join(heads.hint("merge"), "fp").filter("name <> head").select(F.col("head").alias("a"), F.col("name").alias("b")).distinct()
    found = materialize(links(heads.select("fp"), limit))
    ends = materialize(found.select(F.col("a").alias("fp")).union(found.select("b")).distinct())
    some = materialize(sieved(heads, ends, "fp")[0])
    side = lambda c: some.select(F.col("fp").alias(c), F.col("head").alias(f"name_{c}"))
    named = found.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    return same.unionByName(named.select(F.least("name_a", "name_b").alias("a"), F.greatest("name_a", "name_b").alias("b")))


def meetings(tokens: DataFrame, limit: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of names that meet by a shingle of (token, size, name, fp) and whose sizes and bits make them worth a look.

    The first name with each other, and neighbours by size, so the rows follow the input. What these pairs link is
    out of the way when ``other_meetings`` looks at all the others, so the bits decide what comes first, not what is lost.
    """

    def pairs(sizes, name):
        n = int(sizes.sum())
        group, at = np.repeat(np.arange(len(sizes)), sizes), np.arange(n)
        low = np.lexsort((name, group))[np.cumsum(sizes) - sizes] if n else at
        after = at[np.flatnonzero(group[1:] == group[:-1])] if n else at
        return np.r_[low[group], after], np.r_[at, after + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sizes, (_, size, name, fp) in _groups(batches, [1, 1, 1, 1]):
            i, j = pairs(sizes, name)
            ok = (name[i] != name[j]) & _near(fp.view(np.uint64), size, i, j, limit, similarity)
            if ok.any():
                yield _pairs([_ordered(name, i[ok], j[ok])])

    dealt = tokens.select("token", "size", "name", "fp").repartition("token").sortWithinPartitions("token", "size", "name")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def other_meetings(tokens: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b) of names of different roots that meet by a shingle of (token, size, name, root, fp) and may be similar.

    Tokens of one root have no such pair. The others' rows get the bitmaps of the written ``sketches`` (name, sketch), so
    only pairs that these let pass leave the task, nearly all of them similar; bits of fingerprints decide nothing here.
    Names of a token beyond BLOCK are dealt into blocks by a hash, and each two blocks are a group of their own, formed
    as rows are shuffled: no task holds more than about two blocks, whatever the number of names.
    """
    open_ = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("__n"), F.min("root").alias("__lo"), F.max("root").alias("__hi")).filter("__lo < __hi")
    open_ = materialize(open_.select("token", F.ceil(F.col("__n") / BLOCK).cast("int").alias("__k")))
    some = sieved(tokens, open_, "token")[0]
    rows = materialize(some.join(open_.hint("merge"), "token").select("token", "size", "name", "root", "__k"))
    asked = sieved(sketches, rows, "name")[0].groupBy("name").agg(F.first("sketch").alias("sketch"))
    least = rows.groupBy("name").agg(F.slice(F.sort_array(F.collect_set("token")), 1, LEAST).alias("least"))
    filled = F.concat("sketch", "least", F.array_repeat(F.lit(_NONE), LEAST - F.size("least")))
    asked = asked.join(least.hint("merge"), "name").select("name", filled.alias("facts"))
    rows = rows.join(asked.hint("merge"), "name")
    rows = rows.withColumn("__b", F.pmod(F.xxhash64("name"), F.col("__k")).cast("int")).withColumn("__c", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)))
    split = F.when(F.col("__k") > 1, F.xxhash64("token", F.least("__b", "__c"), F.greatest("__b", "__c"))).otherwise(F.col("token"))
    side = F.when(F.expr("__b = __c"), -1).otherwise(F.expr("__b > __c").cast("int")).cast("long")
    rows = rows.select(split.alias("group"), "size", "name", "root", side.alias("side"), "token", "facts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for starts, sizes, (_, size, name, root, side, token, facts) in _groups(batches, [1, 1, 1, 1, 1, 1, SKETCH + LEAST]):
            least = facts[:, SKETCH:]
            sketch = np.ascontiguousarray(facts[:, :SKETCH]).view(np.uint64)  # bits of a negative number would be counted by its absolute value
            two = starts[sizes == 2]  # most groups hold two: one step for all of them
            two = two[(root[two] != root[two + 1]) & (size[two] >= similarity * size[two + 1] - 1e-9) & ((side[two] != side[two + 1]) | (side[two] < 0))]
            two = two[may_be_similar(size[two], sketch[two], size[two + 1], sketch[two + 1], similarity)]
            two = two[_first_here(least[two], least[two + 1], token[two])]
            if len(two):
                out.append(_ordered(name, two, two + 1))
                held += len(two)
            many = sizes > 2
            for s, n in zip(starts[many].tolist(), sizes[many].tolist(), strict=True):
                if (root[s : s + n] == root[s]).all():
                    continue
                ends = s + np.searchsorted(size[s : s + n], np.floor(size[s : s + n] / similarity + 1e-9), side="right")
                for i in range(s, s + n - 1):
                    j = np.arange(i + 1, ends[i - s])
                    j = j[(root[j] != root[i]) & ((side[j] != side[i]) | (side[i] < 0))]
                    j = j[may_be_similar(size[i], sketch[i], size[j], sketch[j], similarity)]
                    j = j[_first_here(least[i][None, :], least[j], token[j])]
                    if len(j):
                        out.append(_ordered(name, np.full(len(j), i), j))
                        held += len(j)
                if held > 1 << 18:
                    yield _pairs(out)
                    out, held = [], 0
        if held:
            yield _pairs(out)

    dealt = rows.repartition("group").sortWithinPartitions("group", "size", "name")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _first_here(a: np.ndarray, b: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Of pairs with these least tokens, which have none in common before the token at which they meet."""
    before = (a[:, :, None] == b[:, None, :]) & (a[:, :, None] < token[:, None, None])
    return ~before.any(axis=(1, 2))


def _groups(batches: Iterator[pa.RecordBatch], width: list[int]) -> Iterator[tuple]:
    """(starts, sizes, columns) of the whole groups by the first column of sorted batches; columns wider than 1 are lists of that length."""

    def columns(b):
        return [c.to_numpy() if w == 1 else c.flatten().to_numpy().reshape(-1, w) for c, w in zip(b.columns, width, strict=True)]

    rest = [np.empty(0 if w == 1 else (0, w), np.int64) for w in width]
    for b in _and_end(batches):
        got = [np.concatenate(x) for x in zip(rest, columns(b), strict=True)] if b is not None else rest
        token = got[0]
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.empty(0, np.int64)
        if b is not None and len(starts):
            cut = starts[-1]  # the last group may go on in the next batch
            rest, got, starts = [x[cut:] for x in got], [x[:cut] for x in got], starts[:-1]
        yield starts, np.diff(np.r_[starts, len(got[0])]), got


def _ordered(name: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.stack((np.minimum(name[i], name[j]), np.maximum(name[i], name[j])), axis=1)


def _pairs(out: list[np.ndarray]) -> pa.RecordBatch:
    found = np.unique(np.concatenate(out), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["a", "b"])


def similar_pairs(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """The written ``pairs`` whose shingle sets, given by ``sets_of`` for a table of names, have this Jaccard similarity or more."""
    asked = materialize(pairs.select(F.col("a").alias("name")).union(pairs.select("b")).distinct())
    held = materialize(sets_of(asked))
    side = lambda c: held.select(F.col("name").alias(c), F.col("grams").alias(f"grams_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common, n = F.size(F.array_intersect("grams_a", "grams_b")), F.size("grams_a") + F.size("grams_b")
    return materialize(both.filter(common >= F.lit(similarity) * (n - common) - 1e-9).select("a", "b"))


def similar_classes(prints: DataFrame, sets_of: Callable[[DataFrame], DataFrame], limit: int, similarity: float) -> DataFrame:
    """Written (name, root) for every distinct name of a written table of ``shingle_sets``: root is the smallest it reaches.

    Tokens are counted first; a bounded sieve of those that stand in two texts lets few others into the join by
    token. First the pairs that pivot tables link and those of a linear scan of each meeting are verified, then all
    others that these have not joined and that bitmaps of the sets let pass.
    """
    with scratch(prints.sparkSession):
        # Copies of a text are one text: all its rows but the one of the least tag are left out.
        slim = materialize(prints.select("name", "__tag"))
        least = slim.groupBy("name").agg(F.min("__tag").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        copies = materialize(slim.join(materialize(least).hint("merge"), "name").filter("__tag <> least").select("name", F.col("__tag").alias("__copy")).distinct())
        some, texts = sieved(prints, copies, "__copy", "__tag")
        texts = texts.unionByName(some.join(copies.hint("merge"), (some["name"] == copies["name"]) & (F.col("__tag") == F.col("__copy")), "left_anti"))
        tokens = texts.select("name", "size", "fp", F.explode("grams").alias("token"))
        shared = materialize(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("token"))
        tokens = sieved(tokens, shared, "token")[0]
        tokens = materialize(tokens.join(shared.hint("merge"), "token", "left_semi"))
        with scratch(prints.sparkSession):
            close = materialize(close_names(texts, min(limit, LIMIT)), keep=True)
        tried = materialize(close.union(meetings(tokens, limit, similarity)).distinct())
        links_ = similar_pairs(tried, sets_of, similarity)
        found = materialize(components(links_).distinct())
        known = tokens.join(found.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
        others = other_meetings(materialize(known), prints.select("name", "sketch"), similarity)
        others = materialize(others.join(tried, ["a", "b"], "left_anti"))
        if not others.isEmpty():
            more = similar_pairs(others, sets_of, similarity)
            found = materialize(components(links_.unionByName(more)).distinct())
        names = slim.select("name").distinct()
        return materialize(names.join(found, names["name"] == found["node"], "left").select("name", F.coalesce("root", "name").alias("root")), keep=True)


def near_duplicates(docs: DataFrame, text: str = "text", limit: int = LIMIT, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs``.

    component_id is the smallest doc_id reached by links of at most ``limit`` differing bits; null ids are reached
    like others but never the smallest. Texts without a word have fingerprint zero. Repeated rows share their
    component; other columns are ignored; an empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, text, shingle=shingle))
    names = classes(prints, limit)  # pivot tables, cells, verified links, components
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = names.join(least, "fp")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    table = materialize(named.select("fp", "root").join(ids, "root").select("fp", "component_id"))
    return prints.join(table, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, text: str = "text", limit: int = LIMIT, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs`` with one document of each class: the one with the smallest doc_id (nulls last), then text.

    Links are at most ``limit`` differing bits; with ``similarity``, that Jaccard similarity of the sets of shingles instead.
    Rows that are equal in every column are one document, of which one row stays. Null and empty texts are one class;
    other columns, maps too, go through as they are; an empty table gives no rows.

    What goes is looked up: a bounded sieve of the rows to drop lets only few others into that join, so most texts
    don't move.
    """
    tagged = docs.withColumn("__tag", row_hash(docs))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__tag") == F.col("__x"))
    with scratch(docs.sparkSession):
        if similarity is None:
            key, prints = "fp", materialize(fingerprints(tagged, text, ("doc_id", "__tag"), shingle))
            table = classes(prints, limit)
        else:
            common = common_shingles(docs, text, shingle)
            key, prints = "name", materialize(shingle_sets(tagged, text, ("doc_id", "__tag"), shingle, similarity, common))

            def sets_of(names: DataFrame) -> DataFrame:
                """Whole shingle sets of some texts, made anew from one row of each: sets of all texts are never written."""
                rows = prints.select("name", "__tag").join(names, "name").groupBy("name").agg(F.min("__tag").alias("__x"))
                rows = materialize(rows)
                some = sieved(tagged, rows, "__x", "__tag")[0].join(rows.hint("merge"), F.col("__tag") == F.col("__x")).select("__tag", text)
                return shingle_sets(some.repartition("__tag"), text, (), shingle).groupBy("name").agg(F.first("grams").alias("grams"))

            table = similar_classes(prints, sets_of, limit, similarity)
        named = materialize(prints.select("doc_id", "__tag", key).join(table, key).select("doc_id", "__tag", "root"))
        best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__tag").alias("x")))
        firsts = materialize(named.groupBy("root").agg(best.alias("first")))
        dropped = named.join(firsts.hint("merge"), "root").filter(~(F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("__tag") == F.col("first.x"))))
        dropped = materialize(dropped.select(F.col("doc_id").alias("__id"), F.col("__tag").alias("__x")).distinct(), keep=True)
        twice = named.groupBy("doc_id", "__tag").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        twice = materialize(twice.select(F.col("doc_id").alias("__id"), F.col("__tag").alias("__x")), keep=True)
    some, kept = sieved(tagged, dropped, "__x", "__tag")
    kept = kept.unionByName(some.join(dropped.hint("merge"), same, "left_anti"))
    if not twice.isEmpty():  # only rows that are there twice are shuffled whole
        some, others = sieved(kept, twice, "__x", "__tag")
        again = some.join(twice.hint("merge"), same, "left_semi").dropDuplicates(["doc_id", "__tag"])
        kept = others.unionByName(some.join(twice.hint("merge"), same, "left_anti")).unionByName(again)
    return kept.drop("__tag")

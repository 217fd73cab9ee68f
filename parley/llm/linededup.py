"""Line deduplication: a suffix array over line-ID sequences by prefix doubling, and the runs of lines it shows repeated.

Lines become IDs; only lines that occur twice or more can be part of a repeated run, so only islands of such lines
are sorted. Round k ranks the suffixes by their first 2^k lines from the pairs of ranks of the round before. Suffixes
of equal rank form the intervals of the suffix array with a common prefix of 2^k lines or more, and the interval of
any prefix length m is named by two overlapping ranks of the largest 2^k within m. Each interval is judged by its words
and its copies: the fewer words a run has, the more documents must hold it. The first copy stays; what the intervals
show as later copies is put together to maximal runs of lines, which go.

Only the shortest prefixes that reach a rule's words are asked for, from either end: every longer repeated run is
covered by them, their number follows the number of lines, and all holders of such a prefix ask for the same one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.text import WORD, whole
from parley.plans.joins import row_hash, sieved
from parley.plans.shared import materialize, scratch

#: Words that a repeated run of lines must have.
RUN_WORDS = 50
#: (words, copies, documents): a repeated run of so many words goes if it has so many copies in so many documents.
#: A blank or one-word line alone has too few words for any.
LONG_RUNS = ((RUN_WORDS, 2, 1),)
RUNS = (*LONG_RUNS, (8, 3, 3), (2, 10, 10))
DOC = ["d", "u"]


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with d (doc_id, null last) and u (a hash of the whole row): rows equal in every column are one document."""
    last = F.lit((1 << 63) - 1)
    return docs.withColumns({"d": F.coalesce(F.col("doc_id").cast("long"), last), "u": row_hash(docs)})


def _named(pairs: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The distinct keys with ``name``, a number that orders as they do. Written once, so the numbers are fixed."""
    ordered = pairs.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(ordered.withColumn(name, F.monotonically_increasing_id()))


def islands(docs: DataFrame, text: str, run_words: int) -> DataFrame:
    """(d, u, island, idx, words, rank) of the lines in unbroken stretches of repeated lines with ``run_words`` or more."""
    line = F.col("line")
    lines = _keyed(docs).select(*DOC, F.posexplode(F.split(whole(text), "\n", -1)).alias("idx", "line"))
    lines = materialize(lines.select(*DOC, "idx", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"), F.regexp_count(line, F.lit(WORD)).cast("long").alias("words")))
    twice = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2")
    marked = lines.join(_named(twice, ["h1", "h2"], "rank"), ["h1", "h2"]).select(*DOC, "idx", "words", "rank")
    marked = marked.repartition(*DOC).dropDuplicates([*DOC, "idx"])
    order = Window.partitionBy(*DOC).orderBy("idx")
    marked = marked.withColumn("island", F.col("idx") - F.row_number().over(order))
    marked = marked.withColumn("total", F.sum("words").over(Window.partitionBy(*DOC, "island")))
    return materialize(marked.filter(F.col("total") >= run_words).select(*DOC, "island", "idx", "words", "rank"))


def shortest_runs(rows: DataFrame, rules: tuple) -> DataFrame:
    """(d, u, rule, b, m): for the words of each rule, every stretch b .. b + m - 1 of an island that reaches them and
    loses them with one line less at its end, or at its start. Together such stretches cover every longer run that is
    repeated as a whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, u, x in zip(b["d"], b["u"], b["x"], strict=True):
                start = x[0]["idx"]
                total = np.cumsum([0, *[r["words"] for r in x]])
                n = len(x)
                first = np.arange(n)
                ends = np.arange(1, n + 1)
                for rule, (run_words, *_) in enumerate(rules):
                    if total[-1] < run_words:
                        continue
                    last = np.searchsorted(total, total[first] + run_words, side="left")  # the run is first .. last - 1
                    ok = last <= n
                    begin = np.searchsorted(total, total[ends] - run_words, side="right") - 1
                    fine = (total[ends] >= run_words) & (begin >= 0)
                    runs = set(zip(first[ok].tolist(), last[ok].tolist(), strict=True)) | set(zip(begin[fine].tolist(), ends[fine].tolist(), strict=True))
                    out += [(d, u, rule, start + i, j - i) for i, j in sorted(runs)]
            yield pd.DataFrame(out, columns=["d", "u", "rule", "b", "m"])

    grouped = rows.groupBy(*DOC, "island").agg(F.sort_array(F.collect_list(F.struct("idx", "words"))).alias("x"))
    return grouped.select(*DOC, "x").mapInPandas(run, "d long, u long, rule int, b int, m int")


def suffix_ranks(rows: DataFrame, levels: int) -> DataFrame:
    """(k, d, u, idx, rank) for k = 0 .. ``levels``: the rank of the suffix at ``idx`` by its first 2^k lines.

    Ranks order as the suffixes do, by their line numbers. A suffix shorter than 2^k lines has no rank of that round.
    """
    now = rows.select(*DOC, "idx", "rank")
    found = [now.withColumn("k", F.lit(0))]
    order = Window.partitionBy(*DOC).orderBy("idx")
    for k in range(1, levels + 1):
        step = 1 << (k - 1)
        ahead = F.lead(F.struct("idx", "rank"), step).over(order)
        pairs = now.withColumn("ahead", ahead).filter(F.col("ahead.idx") == F.col("idx") + step)
        pairs = materialize(pairs.select(*DOC, "idx", F.col("rank").alias("r1"), F.col("ahead.rank").alias("r2")))
        names = _named(pairs.select("r1", "r2").distinct(), ["r1", "r2"], "rank")
        now = materialize(pairs.join(names, ["r1", "r2"]).select(*DOC, "idx", "rank"))
        found.append(now.withColumn("k", F.lit(k)))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def later_copies(docs: DataFrame, text: str = "text", rules: tuple = LONG_RUNS) -> DataFrame:
    """(d, u, runs): per document the maximal runs of lines (b, m) that go, because earlier copies of them stay.

    Written; the tables of the steps before are deleted. A document without such a run has no row.
    """
    with scratch(docs.sparkSession):
        rows = islands(docs, text, min(words for words, *_ in rules))
        runs = materialize(shortest_runs(rows, rules))
        longest = runs.agg(F.max("m")).first()[0] or 1
        ranks = suffix_ranks(rows, longest.bit_length() - 1)
        k = F.floor(F.log2(F.col("m").cast("double")) + 1e-9).cast("int")
        asked = runs.withColumn("k", k).withColumn("b2", F.expr("b + m - shiftleft(1, k)"))
        at = lambda c, name: ranks.select("k", *DOC, F.col("idx").alias(c), F.col("rank").alias(name))
        asked = asked.join(at("b", "r1"), ["k", *DOC, "b"]).join(at("b2", "r2"), ["k", *DOC, "b2"])
        asked = materialize(asked.select(*DOC, "rule", "b", "m", "r1", "r2"))
        interval = ["rule", "m", "r1", "r2"]
        by_doc = asked.groupBy(*interval, *DOC).agg(F.min("b").alias("b"), F.count(F.lit(1)).alias("n"))
        first = by_doc.groupBy(*interval).agg(F.min(F.struct(*DOC, "b")).alias("first"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"))
        enough = reduce(or_, [(F.col("rule") == i) & (F.col("n") >= n) & (F.col("n_docs") >= n_docs) for i, (_, n, n_docs) in enumerate(rules)])
        # Written before the join, so that both its sides are plain and a passage of very many documents is split.
        first = materialize(first.filter(enough).select(*interval, "first"))
        gone = asked.join(first.hint("merge"), interval).filter(F.struct(*DOC, "b") != F.col("first"))
        gone = gone.select(*DOC, "b", (F.col("b") + F.col("m")).alias("e")).distinct()
        # Stretches that touch or overlap are one maximal run.
        order = Window.partitionBy(*DOC).orderBy("b", "e")
        begins = F.coalesce(F.col("b") > F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
        gone = gone.withColumn("begins", begins).withColumn("run", F.sum(F.col("begins").cast("int")).over(order))
        gone = gone.groupBy(*DOC, "run").agg(F.min("b").alias("b"), (F.max("e") - F.min("b")).alias("m"))
        return materialize(gone.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("b", "m"))).alias("runs")), keep=True)


def without_copies(docs: DataFrame, text: str = "text", rules: tuple = LONG_RUNS) -> DataFrame:
    """``docs`` with ``text`` rewritten, and __n_lines and __n_removed: lines before, and lines taken out.

    A run of consecutive whole lines (split at line feeds) with the words, copies and documents of one of ``rules``
    is deleted wherever it occurs again later, in the order of doc_id (nulls last) and place; its first copy stays.
    Lines outside such runs stay as they are. Rows equal in every column are one document and keep the same lines.
    Null and empty texts come back unchanged; other columns go through as they are; an empty table gives no rows.

    Only documents that a bounded sieve of the removals lets through are joined with them, so most texts don't move.
    """
    names = docs.columns
    gone = later_copies(docs, text, rules).withColumnsRenamed({"d": "__d", "u": "__u"})
    some, others = sieved(_keyed(docs), gone, "__u", "u")
    joined = some.join(gone.hint("merge"), (F.col("d") == F.col("__d")) & (F.col("u") == F.col("__u")), "left")
    lines = F.split(F.col(text), "\n", -1)
    joined = joined.withColumn("__kept", F.when(F.col("runs").isNotNull(), F.filter(lines, lambda line, i: ~F.exists("runs", lambda r: (i >= r["b"]) & (i < r["b"] + r["m"])))))
    joined = joined.withColumn("__removed", F.when(F.col("__kept").isNotNull(), F.size(lines) - F.size("__kept")).otherwise(0))
    new = F.when(F.col("__removed") > 0, F.array_join("__kept", "\n")).otherwise(F.col(text))
    n = F.coalesce(F.size(F.split(whole(text), "\n", -1)), F.lit(0)).cast("long").alias("__n_lines")
    joined = joined.select(*[new.alias(c) if c == text else F.col(c) for c in names], n, F.col("__removed").cast("long").alias("__n_removed"))
    return joined.unionByName(others.select(*names, n, F.lit(0).cast("long").alias("__n_removed")))

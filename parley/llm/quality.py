"""Quality rules with host-level verdicts: failures by host, shrunk by an empirical beta prior.

Only DataFrame functions run here: whole texts are measured in place by array functions, so no text is shuffled.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.text import WORD, whole
from parley.plans.joins import join_small, row_hash, sieved
from parley.plans.shared import materialize, scratch

SYMBOLS = r"[#*$%&|<>]"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 5
#: A document fails with more symbols in 100 word characters, or repeated lines in 100 lines with words, than these.
MOST_SYMBOLS, MOST_DUP_LINES = 10, 50


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """``keep`` plus n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words (all long) of every whole text.

    n_lines counts lines with a word. A null text counts as empty: all measures are 0. n_repeat_words counts words inside 5-word windows that occur
    twice or more in the text, the first occurrence included; fewer than 5 words have no window.
    """
    t = F.col("__t")
    base = docs.select(*keep, whole(text).alias("__t"))
    base = base.select(
        *keep,
        F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("__w"),
        F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)).alias("__lines"),
    )
    n = F.size("__w")

    def window(i):  # single words: a slice would copy the whole array for every window
        return [F.get("__w", i + j) for j in range(WINDOW)]

    base = base.select(
        *keep, "word_chars", "n_symbols", "__w",
        n.cast("long").alias("n_words"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*window(i)))).otherwise(F.array().cast("array<bigint>")).alias("__h"),
    )
    # Most texts repeat no window; only the others have their windows sorted by hash.
    repeats = F.size(F.array_distinct("__h")) < F.size("__h")
    numbered = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    base = base.withColumn("__s", F.when(repeats, numbered))

    def same(a, b):
        return reduce(and_, [x == y for x, y in zip(window(a["i"]), window(b["i"]), strict=True)], a["h"] == b["h"])

    hits = F.filter("__s", lambda x, i: F.coalesce(same(x, F.get("__s", i - 1)), F.lit(False)) | F.coalesce(same(x, F.get("__s", i + 1)), F.lit(False)))
    base = base.withColumn("__p", F.sort_array(F.transform(hits, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("__p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("__p", i + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    return base.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def failed():
    """The base rules, and too many symbols or repeated lines."""
    return base_failed() | (100 * F.col("n_symbols") > MOST_SYMBOLS * F.col("word_chars")) | (100 * F.col("n_dup_lines") > MOST_DUP_LINES * F.col("n_lines"))


def borderline(rate, mean):
    """Over the limits of repeated words, symbols and lines as a host of this shrunk failure rate has them: where it is
    above the corpus's ``mean``, its documents get mean / rate of each limit, but half of it at least."""
    share = F.when(rate > mean, F.greatest(F.lit(0.5), mean / rate)).otherwise(F.lit(1.0))
    over = (100 * F.col("n_repeat_words") > 20 * share * F.col("n_words")) | (100 * F.col("n_symbols") > MOST_SYMBOLS * share * F.col("word_chars"))
    return F.coalesce(over | (100 * F.col("n_dup_lines") > MOST_DUP_LINES * share * F.col("n_lines")), F.lit(False))


def host_rates(measured: DataFrame, host: str = "source") -> DataFrame:
    """Per host of written ``measured`` with ``failed``: n documents, n_failed, ``mean`` of the corpus, and ``rate``, the failure rate shrunk to the corpus by a beta prior.

    The prior is fitted by moments over all hosts: mean m of all documents, and the spread v of the hosts' rates,
    weighted by their size, less what chance alone gives hosts of these sizes; strength m(1-m)/v - 1, at least 1.
    Without a spread beyond chance the rate is m itself. Documents without a host form one host of their own. Five
    numbers reach the driver, whatever the number of hosts.
    """
    hosts = materialize(measured.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed")))
    k, n = F.col("n_failed"), F.col("n_docs")
    got = hosts.agg(F.sum(k).alias("k"), F.sum(n).alias("n"), F.sum(k * k / n).alias("k2"), F.sum(n * n).alias("n2"), F.count(F.lit(1)).alias("hosts")).first()
    if not got["n"]:
        return hosts.withColumns({"mean": F.lit(0.0), "rate": F.lit(0.0)})
    m = got["k"] / got["n"]
    hosts = hosts.withColumn("mean", F.lit(float(m)))
    chance = (got["hosts"] - 1) * m * (1 - m)  # of the sum of squares, if all hosts had the rate m
    between = got["n"] - got["n2"] / got["n"]
    v = (got["k2"] - got["n"] * m * m - chance) / between if between > 0 else 0.0
    if v <= 1e-12 or not 0 < m < 1:
        return hosts.withColumn("rate", F.lit(float(m)))
    strength = max(1.0, m * (1 - m) / v - 1)
    return hosts.withColumn("rate", (k + F.lit(m * strength)) / (n + F.lit(strength)))


def judge(docs: DataFrame, text: str = "text", host: str = "source", limit: float = 0.5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: ``keep``, the five measures, base_failed, host_rate, by_host (rejected for its host) and kept.

    A document is kept if it passes the base rules (10 words or more, at most 20 % of its words in repeated
    windows), has at most 10 symbols in 100 word characters and 50 % repeated lines, and its host's shrunk failure
    rate by all these rules is at most ``limit``. On a host above the corpus the limits are lower (``borderline``). An empty table gives an empty result;
    repeated rows are judged row by row; other columns are ignored.
    """
    out = _judged(docs, text, host, limit, tuple(dict.fromkeys((*keep, host))))
    return out.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", "by_host", "kept")


def _judged(docs: DataFrame, text: str, host: str, limit: float, keep: tuple[str, ...]) -> DataFrame:
    """All measures and verdicts with ``keep``, which holds the host; texts are read once and not written."""
    measured = materialize(measure(docs, text, keep).withColumns({"base_failed": base_failed(), "failed": failed()}))
    rates = materialize(host_rates(measured, host).select(F.col(host).alias("__host"), F.col("rate").alias("host_rate"), "mean"))
    out = join_small(measured, rates, F.col(host).eqNullSafe(F.col("__host")))
    by_host = ~F.col("failed") & ((F.coalesce(F.col("host_rate"), F.lit(0.0)) > limit) | borderline(F.col("host_rate"), F.col("mean")))
    return out.withColumn("by_host", by_host).withColumn("kept", ~F.col("failed") & ~F.col("by_host"))


def kept_documents(docs: DataFrame, text: str = "text", host: str = "source", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    The verdict needs the text and the host alone, so rows that are equal in every column have the same one: rows are
    named by two hashes of themselves, and null or repeated ids are safe. Only names of rejected rows are written; a
    bounded sieve of them lets few other rows into the join that takes them out. Maps and other columns go through as
    they are; an empty table gives no rows.
    """
    tags = {"__tag": row_hash(docs), "__tag2": row_hash(docs, F.lit(2))}
    tagged = docs.withColumns(tags)
    with scratch(docs.sparkSession):
        judged = _judged(tagged, text, host, limit, ("__tag", "__tag2", host))
        gone = materialize(judged.filter(~F.col("kept")).select(F.col("__tag").alias("__t"), F.col("__tag2").alias("__t2")).distinct(), keep=True)
    some, kept = sieved(tagged, gone, "__t", "__tag")
    some = some.join(gone.hint("merge"), (F.col("__tag") == F.col("__t")) & (F.col("__tag2") == F.col("__t2")), "left_anti")
    return kept.unionByName(some).drop(*tags)

"""A written full-text index with positions and columns: phrases, prefixes, BM25, access, upkeep and best snippets.

The index has a row for each occurrence of a term (term, key, col, pos, n_terms), dealt by the term and part of a hash of
the key and sorted, so a term's rows lie together in each file, a very common term in many files, and filters on terms reach
the Parquet statistics. Beside it stands a row for each document (key, n_terms) for the statistics of the whole index.

Letters are compared in lower case without diacritics, in the index and in queries by the same table, which follows
from Unicode's decompositions.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.plans.joins import join_small
from parley.plans.shared import materialize, scratch

K1, B = 1.2, 0.75
#: Phrases of a query, and characters that it needs.
PHRASES, SHORTEST = 12, 2
#: Terms of a snippet.
WIDTH = 16
#: Places over which the rows of one term are dealt.
SPREAD = 64

TERM = r"[\p{L}\p{N}\p{Co}]+"
_ANY_TERM = r"[\p{L}\p{N}\p{Co}\p{M}]+"


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str]:
    """Letters with marks beside their plain letters; behind them marks alone, which have no partner and go."""
    letters, plain, marks = [], [], []
    for c in map(chr, range(0x80, 0x10000)):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if unicodedata.combining(c):
            marks.append(c)
        elif len(base) == 1 and base != c and unicodedata.category(c)[0] == "L":
            letters.append(c)
            plain.append(base.lower())
    return "".join(letters + marks), "".join(plain)


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(text), *_folding())


def folded(text: str) -> str:
    """What ``fold`` makes of a query."""
    letters, plain = _folding()
    return text.lower().translate({ord(c): plain[i] if i < len(plain) else None for i, c in enumerate(letters)})


def terms(text: Column) -> Column:
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def phrases(query: str) -> list[list[str]]:
    """The terms of a query's first words, each word a phrase: what stands between terms in ``a_b`` makes them neighbours.

    The last term of a phrase is a prefix. A query under two characters has none, nor has one without letters or digits.
    """
    import regex

    if len(query.strip()) < SHORTEST:
        return []
    words = re.findall(r"\w+", query)[:PHRASES]
    found = [regex.findall(TERM, folded(w)) for w in words]
    return [list(p) for p in dict.fromkeys(tuple(p) for p in found if p)]


def occurrences(docs: DataFrame, key: str = "doc_id", columns: Sequence[str] = ("text",)) -> DataFrame:
    """(term, key, col, pos, n_terms): every term of every column, with the number of the document's terms."""
    return _placed(_split(docs, key, columns))


def _split(docs: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, w, n_terms): the terms of each column and the number of all."""
    rows = docs.select(F.col(key).alias("key"), F.array(*[terms(F.col(c)) for c in columns]).alias("w"))
    return rows.withColumn("n_terms", F.aggregate("w", F.lit(0), lambda n, x: n + F.size(x)))


def _placed(split: DataFrame) -> DataFrame:
    rows = split.select("key", "n_terms", F.posexplode("w").alias("col", "w"))
    return rows.select("key", "n_terms", "col", F.posexplode("w").alias("pos", "term")).select("term", "key", "col", "pos", "n_terms")


def sizes(docs: DataFrame, key: str = "doc_id", columns: Sequence[str] = ("text",)) -> DataFrame:
    """(key, n_terms) of every document, those without terms too."""
    n = F.size(terms(F.concat_ws("\n", *[F.col(c) for c in columns])))
    return docs.select(F.col(key).alias("key"), n.alias("n_terms"))


def write_index(docs: DataFrame, folder: str, key: str = "doc_id", columns: Sequence[str] = ("text",)) -> None:
    """Texts are split into terms once and written; a very common term's rows are dealt over ``SPREAD`` places by their keys, so no
    sample of all occurrences has to be made to find ranges."""
    with scratch(docs.sparkSession):
        split = materialize(_split(docs, key, columns))
        rows = _placed(split).repartition("term", F.pmod(F.xxhash64("key"), F.lit(SPREAD)))
        rows.sortWithinPartitions("term", "key", "col", "pos").write.mode("overwrite").parquet(f"{folder}/terms")
        split.select("key", "n_terms").write.mode("overwrite").parquet(f"{folder}/documents")


def read_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/terms"), spark.read.parquet(f"{folder}/documents")


def _hit(term: str, last: bool) -> Column:
    return F.col("term").startswith(term) if last else F.col("term") == term


def hits(index: DataFrame, asked: list[list[str]], columns: Sequence[int] | None = None) -> DataFrame:
    """(key, n_terms, tf): documents in which every phrase stands in some column, with the places of each phrase.

    One scan for all phrases. Terms of a phrase agree on the place where it would begin, so neighbours meet by that
    place and no pair of occurrences is formed; a phrase of one term is counted as it is read.
    """
    wanted = [(i, j, _hit(t, j == len(p) - 1)) for i, p in enumerate(asked) for j, t in enumerate(p)]
    some = wanted[0][2]
    for _, _, w in wanted[1:]:
        some = some | w
    rows = index.filter(some)
    if columns is not None:
        rows = rows.filter(F.col("col").isin(*columns))
    found = []
    single = [(i, w) for i, _, w in wanted if len(asked[i]) == 1]
    if single:
        counts = [F.count_if(w).alias(f"tf{i}") for i, w in single]
        found.append(rows.groupBy("key").agg(F.max("n_terms").alias("n_terms"), *counts))
    for i, phrase in enumerate(asked):
        if len(phrase) > 1:
            at = F.array_compact(F.array(*[F.when(w, F.struct((F.col("pos") - j).alias("at"), F.lit(j).alias("j"))) for k, j, w in wanted if k == i]))
            places = rows.select("key", "n_terms", "col", F.explode(at).alias("e")).groupBy("key", "col", "e.at").agg(F.max("n_terms").alias("n_terms"), F.count_distinct("e.j").alias("m"))
            found.append(places.filter(F.col("m") == len(phrase)).groupBy("key").agg(F.max("n_terms").alias("n_terms"), F.count(F.lit(1)).alias(f"tf{i}")))
    out = found[0]
    for part in found[1:]:
        out = out.join(part.drop("n_terms"), "key")
    tf = [F.col(f"tf{i}") for i in range(len(asked))]
    return out.select("key", "n_terms", F.array(*tf).alias("tf"))


def search(index: DataFrame, documents: DataFrame, query: str, top: int | None = 50, columns: Sequence[int] | None = None, visible: DataFrame | None = None) -> DataFrame:
    """(key, score): documents with all phrases of the query, by BM25 over the whole index, the best ``top`` in order.

    Equal scores stand by key. ``visible`` (key) leaves only those documents, after the match; statistics stay those
    of the whole index. Without phrases nothing is found.
    """
    asked = phrases(query)
    if not asked:
        return index.select("key", F.lit(0.0).alias("score")).limit(0)
    every = _each(index, asked, columns)
    stats = documents.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n_terms").alias("avg_terms"))
    counts = every.agg(*[F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(asked))])
    matched = every.filter(F.forall("tf", lambda n: n > 0))
    if visible is not None:
        matched = matched.join(visible.select("key").distinct(), "key", "left_semi")
    rows = matched.crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(counts))  # one row each
    norm = K1 * (1 - B + B * F.col("n_terms") / F.col("avg_terms"))
    score = F.lit(0.0)
    for i in range(len(asked)):
        idf = F.log((F.col("n_docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score += F.greatest(idf, F.lit(1e-6)) * F.col("tf")[i] * (K1 + 1) / (F.col("tf")[i] + norm)
    ranked = rows.select("key", score.alias("score")).orderBy(F.desc("score"), "key")
    return ranked.limit(top) if top else ranked


def _each(index: DataFrame, asked: list[list[str]], columns: Sequence[int] | None) -> DataFrame:
    """As ``hits``, with documents that lack some of the phrases, as a phrase's own count needs them."""
    if len(asked) == 1:
        return hits(index, asked, columns)
    if all(len(p) == 1 for p in asked):
        found = hits(index, asked, columns)
        return found.filter(F.exists("tf", lambda n: n > 0))
    parts = [hits(index, [p], columns).select("key", "n_terms", F.col("tf")[0].alias(f"tf{i}")) for i, p in enumerate(asked)]
    out = parts[0].withColumnRenamed("n_terms", "m0")
    for i, part in enumerate(parts[1:], 1):
        out = out.join(part.withColumnRenamed("n_terms", f"m{i}"), "key", "full")
    tf = [F.coalesce(F.col(f"tf{i}"), F.lit(0)) for i in range(len(asked))]
    return out.select("key", F.coalesce(*[F.col(f"m{i}") for i in range(len(asked))]).alias("n_terms"), F.array(*tf).alias("tf"))


def matching(index: DataFrame, query: str, columns: Sequence[int] | None = None) -> DataFrame:
    """(key) of the documents that hold every phrase of the query, in no order."""
    asked = phrases(query)
    if not asked:
        return index.select("key").limit(0)
    return hits(index, asked, columns).filter(F.forall("tf", lambda n: n > 0)).select("key")


def visible(docs: DataFrame, shares: DataFrame, user: int, live: Column | None = None, key: str = "doc_id", only: int | None = None) -> DataFrame:
    """(key) of the documents that a user owns, that are for everyone, or that are shared with the user.

    ``live`` leaves out what is being deleted, ``only`` all but one document. docs: owner_id, everyone; shares: key, user_id.
    """
    mine = shares.filter(F.col("user_id") == user).select(F.col(key).alias("__shared")).distinct()
    out = join_small(docs, mine, F.col(key) == F.col("__shared"))
    out = out.filter((F.col("owner_id") == user) | F.col("everyone") | F.col("__shared").isNotNull())
    out = out if live is None else out.filter(live)
    out = out if only is None else out.filter(F.col(key) == only)
    return out.select(F.col(key).alias("key"))


def maintained(index: DataFrame, documents: DataFrame, changed: DataFrame, gone: DataFrame, key: str = "doc_id", columns: Sequence[str] = ("text",)) -> tuple[DataFrame, DataFrame]:
    """Both tables of an index after documents were changed or added (``changed``) and deleted (``gone``), as triggers would keep them."""
    out = changed.select(F.col(key).alias("key")).union(gone.select(F.col(key).alias("key"))).distinct()
    new = occurrences(changed, key, columns), sizes(changed, key, columns)
    return tuple(old.join(out, "key", "left_anti").select(*n.columns).union(n) for old, n in zip((index, documents), new, strict=True))


def snippets(rows: DataFrame, columns: Sequence[str], query: str, width: int = WIDTH, out: str = "snippet") -> DataFrame:
    """``rows`` with the best ``width`` terms of the best column, hits in [[ ]], dots where text is missing.

    Windows that begin at a hit are compared: 1000 for each phrase that lies in the window, 1 for each further hit;
    of equals the first column's and first one's. The hits stand in the middle as far as the text allows. Without a
    hit the first column's beginning is shown. A null column is empty. Meant for the documents that a search returns.
    """
    names, asked = rows.columns, phrases(query)
    text = [F.coalesce(F.col(c), F.lit("")) for c in columns]
    parts = [F.struct(F.regexp_extract_all(t, F.lit(_ANY_TERM), F.lit(0)).alias("shown"), F.split(t, _ANY_TERM).alias("between")) for t in text]
    # Step by step, so that no step is computed again inside another one's lambda.
    rows = rows.withColumn("__w", F.array(*parts))
    rows = rows.withColumn("__w", F.transform("__w", lambda w: F.struct(w["shown"].alias("shown"), w["between"].alias("between"), F.transform(w["shown"], fold).alias("plain"))))
    rows = rows.withColumn("__w", F.transform("__w", lambda w: F.struct(w["shown"].alias("shown"), w["between"].alias("between"), _places(w["plain"], asked).alias("hits"))))
    rows = rows.withColumn("__best", F.transform("__w", lambda w: _best_window(w["hits"], width)))
    column = F.array_max(F.transform("__best", lambda b, i: F.struct(b["score"].alias("score"), (-i).alias("i"))))
    rows = rows.withColumn("__i", -column["i"])
    rows = rows.select(*names, F.get("__w", F.col("__i")).alias("__w"), F.get("__best", F.col("__i")).alias("__b"))
    first, n = -F.col("__b.first"), F.size("__w.shown")
    middle = first - F.floor((width - (F.col("__b.end") - first)) / 2).cast("int")
    rows = rows.withColumn("__start", F.greatest(F.lit(0), F.least(middle, n - width))).withColumn("__stop", F.least(F.col("__start") + width, n))
    rows = rows.withColumn("__hits", F.filter("__w.hits", lambda h: (h["at"] >= F.col("__start")) & (h["at"] + h["size"] <= F.col("__stop"))))
    within = lambda i, lead: F.exists("__hits", lambda h: (h["at"] + lead <= i) & (i < h["at"] + h["size"]))

    def piece(i: Column) -> Column:
        opens, closes = within(i, 0) & ~within(i, 1), within(i, 0) & ~within(i + 1, 1)
        gap = F.when(i > F.col("__start"), F.get("__w.between", i)).otherwise("")
        return F.concat(gap, F.when(opens, "[[").otherwise(""), F.get("__w.shown", i), F.when(closes, "]]").otherwise(""))

    at = F.when(F.col("__stop") > F.col("__start"), F.sequence(F.col("__start"), F.col("__stop") - 1)).otherwise(F.array().cast("array<int>"))
    dots = lambda missing: F.when(missing, "…").otherwise("")
    shown = F.concat(dots(F.col("__start") > 0), F.array_join(F.transform(at, piece), ""), dots(F.col("__stop") < n))
    return rows.select(*names, shown.alias(out))


def _places(plain: Column, asked: list[list[str]]) -> Column:
    """Sorted (at, phrase, size) of all phrases in a column's terms."""

    def places(k: int) -> Column:
        phrase = asked[k]

        def here(w: Column, i: Column) -> Column:
            fits = w.startswith(phrase[0]) if len(phrase) == 1 else w == phrase[0]
            for j in range(1, len(phrase)):
                word = F.get(plain, i + j)
                fits = fits & F.coalesce(word.startswith(phrase[j]) if j == len(phrase) - 1 else word == phrase[j], F.lit(False))
            return F.when(fits, F.struct(i.alias("at"), F.lit(k).alias("phrase"), F.lit(len(phrase)).alias("size")))

        return F.array_compact(F.transform(plain, here))

    return F.array_sort(F.concat(F.array().cast("array<struct<at:int,phrase:int,size:int>>"), *map(places, range(len(asked)))))


def _best_window(hits_: Column, width: int) -> Column:
    """(score, -first, end) of the best window that begins at a hit; zeros without one."""

    def window(h: Column) -> Column:
        inside = F.filter(hits_, lambda x: (x["at"] >= h["at"]) & (x["at"] + x["size"] <= h["at"] + width))
        return F.aggregate(
            inside,
            F.struct(F.array().cast("array<int>").alias("kinds"), F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda a, x: F.struct(F.array_union(a["kinds"], F.array(x["phrase"])).alias("kinds"), (a["n"] + 1).alias("n"), F.greatest(a["end"], x["at"] + x["size"]).alias("end")),
            lambda a: F.struct((999 * F.size(a["kinds"]) + a["n"]).alias("score"), (-h["at"]).alias("first"), F.greatest(a["end"], h["at"] + 1).alias("end")),
        )

    nothing = F.struct(F.lit(0).alias("score"), F.lit(0).alias("first"), F.lit(0).alias("end"))
    return F.coalesce(F.array_max(F.transform(hits_, window)), nothing)

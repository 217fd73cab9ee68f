"""License scans by diagonal voting, with DataFrame functions alone.

All rolling word k-grams of a text are joined, as hashes, to the k-grams of license templates. A hit at word ``pos``
that matches template place ``at``, word for word, votes for the diagonal pos - at; a text that holds the template,
or an edited copy, gathers its votes on one diagonal or a few neighbouring ones, or on some whose stretches of the
template follow one another.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm.text import whole
from parley.plans.joins import join_small
from parley.plans.shared import materialize

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 5
#: Diagonals so near each other belong together, and the share of a template's k-grams that a span must hold.
NEAR, COVER = 3, 0.5
#: Words that may stand between two stretches of one copy, and k-grams that a stretch has at least.
BETWEEN, STRETCH = 20, 2

# The phrases and labels of the base scan.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Well-known wordings of public licenses.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
}


# Further paragraphs of the same licenses.
PARAGRAPHS = [
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
]


def wordings(templates: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """(label, text) of ``templates``, or of all wordings known here."""
    return list(templates.items()) if templates else [*TEMPLATES.items(), *PARAGRAPHS]


def words_text(text: str = "text") -> Column:
    """The text's words, A-Z lowered, one space before and behind each: " a b " (no word: a single space)."""
    lowered = F.translate(whole(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered, SEPARATORS, " ")), F.lit(" "))


def _grams(words: Column, k: int) -> Column:
    n = F.size(words) - k  # single words: a slice would copy the whole array for every gram
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])))


def template_grams(spark: SparkSession, known: list[tuple[str, str]], k: int = K) -> DataFrame:
    """(gram, template, at, n_grams, own): a few hundred rows, fixed by the list; own are the gram's words."""
    t = spark.createDataFrame([(i, x) for i, (_, x) in enumerate(known)], "template int, text string")
    w = F.split(F.trim(words_text()), " ")
    t = t.select("template", w.alias("w"), _grams(w, k).alias("g"))
    t = t.select("template", "w", F.size("g").alias("n_grams"), F.posexplode("g").alias("at", "gram"))
    return t.select("template", "n_grams", "at", "gram", F.slice("w", F.col("at") + 1, k).alias("own"))


def marks(known: list[tuple[str, str]], k: int = K) -> list[str]:
    """For every k-gram of the templates its longest word: a text without any of them holds no such k-gram."""
    found = set()
    for _, t in known:
        w = [x for x in re.split(SEPARATORS, t.lower()) if x]
        found |= {max(w[i : i + k], key=len) for i in range(len(w) - k + 1)}
    return sorted(found)


def spans(docs: DataFrame, keep: str, text: str = "text", templates: dict[str, str] | None = None, k: int = K) -> DataFrame:
    """(keep, label, first, last, cover): verified template spans of the documents, first and last in words.

    ``docs`` needs columns ``keep`` (which names the row) and ``text``. The template side of the join is the fixed
    list; the text side is filtered by it in place, so only hits are shuffled. A null text has no span; rows of one
    name are taken together; an empty table gives no rows.
    """
    words = F.split(F.trim(words_text(text)), " ")
    return word_spans(docs.select(keep, words.alias("w")), keep, templates, k)


def word_spans(words: DataFrame, keep: str, templates: dict[str, str] | None = None, k: int = K) -> DataFrame:
    """``spans`` of rows (keep, w) whose texts are already words."""
    wording = wordings(templates)
    known = F.broadcast(template_grams(words.sparkSession, wording, k))
    grams = words.select(keep, "w", _grams(F.col("w"), k).alias("g")).select(keep, "w", F.posexplode("g").alias("pos", "gram"))
    # A hit is verified word by word where it is found; words go no further.
    hits = grams.join(known, "gram").filter(F.slice("w", F.col("pos") + 1, k) == F.col("own"))
    hits = hits.select(keep, "template", "n_grams", "at", "pos", (F.col("pos") - F.col("at")).alias("diagonal"))
    votes = hits.groupBy(keep, "template", "n_grams", "diagonal").agg(F.collect_set("at").alias("ats"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    # Neighbouring diagonals are one stretch.
    order = Window.partitionBy(keep, "template").orderBy("diagonal")
    gap = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > NEAR).cast("int"), F.lit(0))
    stretch = votes.withColumn("gap", gap).withColumn("run", F.sum("gap").over(order))
    stretch = stretch.groupBy(keep, "template", "n_grams", "run").agg(F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    stretch = stretch.filter(F.size("ats") >= F.least(F.lit(STRETCH), F.col("n_grams")))
    # Stretches that follow one another in the text and in the template, with few words between, are one copy.
    order = Window.partitionBy(keep, "template").orderBy("lo", "hi")
    follows = (F.col("lo") - F.lag("hi").over(order) <= BETWEEN + k) & (F.array_min("ats") > F.array_min(F.lag("ats").over(order)))
    copy = stretch.withColumn("begins", (~F.coalesce(follows, F.lit(False))).cast("int")).withColumn("copy", F.sum("begins").over(order))
    copy = copy.groupBy(keep, "template", "n_grams", "copy").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("n"), F.min("lo").alias("first"), (F.max("hi") + (k - 1)).alias("last"))
    # Verified: enough of the template, within a span not much longer than the template itself.
    cover = F.col("n") / F.col("n_grams")
    fits = (cover >= COVER) & (F.col("last") - F.col("first") < 2 * (F.col("n_grams") + k))
    label = F.element_at(F.array(*[F.lit(x) for x, _ in wording]), F.col("template") + 1)
    return copy.filter(fits).select(keep, label.alias("label"), "first", "last", cover.alias("cover"))


def _pattern(phrases: list[str]) -> str:
    return " (?:" + "|".join(phrases) + ")(?= )"


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places where a base phrase's words stand consecutively; first_word and last_word are the
    smallest and largest of their starts, in words from 0, or null. base_labels are the phrases' labels, labels
    also those of verified template spans; both are distinct, sorted and comma-joined, empty if there is none.
    score is the best cover of a template, 1 for a base phrase, 0 for none. Null texts are empty; equal rows get equal
    results; other columns are ignored; an empty table gives no rows.
    """
    s = F.col("__s")
    any_ = _pattern(list(PHRASES))
    rows = docs.select("doc_id", F.xxhash64("doc_id", whole(text)).alias("__key"), words_text(text).alias("__s"))
    rows = rows.withColumn("__w", F.split(F.trim(s), " "))
    found = s.rlike(any_)
    counts = [F.regexp_count(s, F.lit(_pattern([p]))) for p in PHRASES]
    before_first = F.substring(s, F.lit(1), F.regexp_instr(s, F.lit(any_)) - 1)
    before_last = F.regexp_extract(s, "(?s)^(.*)" + any_, 1)
    words_in = lambda c: F.regexp_count(c, F.lit("[^ ]+")).cast("long")
    named = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(c > 0, F.lit(x)) for c, x in zip(counts, PHRASES.values(), strict=True)]))))
    rows = rows.select(
        "doc_id", "__key",
        F.when(F.trim(s) == "", 0).otherwise(F.size("__w")).cast("long").alias("n_words"),
        F.when(found, sum(counts[1:], counts[0])).otherwise(0).cast("long").alias("n_base"),
        F.when(found, words_in(before_first)).alias("first_word"),
        F.when(found, words_in(before_last)).alias("last_word"),
        F.when(found, named).otherwise(F.array().cast("array<string>")).alias("__base"),
        # The words go on only where a template's k-gram is possible, so texts are read once.
        F.when(F.arrays_overlap("__w", F.array(*map(F.lit, marks(wordings())))), F.col("__w")).alias("__w"),
    )
    rows = materialize(rows)
    more = word_spans(rows.filter("__w is not null").select("__key", F.col("__w").alias("w")), "__key")
    more = materialize(more.groupBy(F.col("__key").alias("__k")).agg(F.collect_set("label").alias("__more"), F.max("cover").alias("__cover")))
    out = join_small(rows.drop("__w"), more, F.col("__key") == F.col("__k"))
    labels = F.array_sort(F.array_union("__base", F.coalesce("__more", F.array().cast("array<string>"))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("__base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("__cover", F.lit(0.0))).alias("score"),
    )

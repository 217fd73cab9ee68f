"""The index against plain Python: folding, phrases, columns, scores, upkeep, what a query reads, and snippets over all windows."""

import math
import random
import re
import unicodedata

import pytest
import regex
from pyspark.sql import functions as F

from parley import registry
from parley.operators import fulltext

TEXTS = [
    ("Antonín Dvořák; the a_b case", "Éclair", None), ("dvorak the A B case", "x", "the ÉCLAIR the"), ("b a the", "á b", ""), ("", None, None), (None, "the", "b"),
    ("a b a b a-b", "ab", "the the the"), ("Ångström ﬁne ß İstanbul naïve ΑΣ", "Việt Nam 12_34", "東京 the"), ("x" * 5000 + " the", "a", "b"),
]


def fold(t):
    return "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c))


def tokens(t):
    return regex.findall(r"[\p{L}\p{N}\p{Co}]+", fold(t or ""))


def starts(w, phrase):
    return [i for i in range(len(w) - len(phrase) + 1) if w[i : i + len(phrase) - 1] == phrase[:-1] and w[i + len(phrase) - 1].startswith(phrase[-1])]


def searched(texts, query, columns=(0, 1, 2)):
    asked = fulltext.phrases(query)
    tf = {k: [sum(len(starts(tokens(t[c]), p)) for c in columns) for p in asked] for k, t in texts.items()}
    n = {k: sum(len(tokens(x)) for x in t) for k, t in texts.items()}
    mean = sum(n.values()) / len(n)
    df = [sum(v[i] > 0 for v in tf.values()) for i in range(len(asked))]
    idf = [max(math.log((len(n) - d + 0.5) / (d + 0.5)), 1e-6) for d in df]
    found = {k: sum(f * v * 2.2 / (v + 1.2 * (0.25 + 0.75 * n[k] / mean)) for f, v in zip(idf, tf[k], strict=True)) for k in texts if asked and all(tf[k])}
    return sorted(found, key=lambda k: (-round(found[k], 12), k)), found


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    rng = random.Random(1)
    texts = dict(enumerate(TEXTS)) | {100 + i: tuple(" ".join(rng.choices(["a", "b", "ab", "the", "Thé", "c_d", "été"], k=rng.randint(0, 9))) for _ in range(3)) for i in range(60)}
    docs = spark.createDataFrame([(k, *t, "clash") for k, t in texts.items()], "doc_id long, t0 string, t1 string, t2 string, term string")
    folder = str(tmp_path_factory.mktemp("index"))
    fulltext.write_index(docs, folder, columns=("t0", "t1", "t2"))
    return texts, fulltext.read_index(spark, folder)


@pytest.mark.parametrize("query", ["the", "a_b", "A-B the", "DVOŘÁK", "dvorak a_b case", "a_b_a", "été c_d", "Viet 12_3", "angstrom", "the_the a", "東京", "x", "ab ab", "...", "zz", "á_b"])
def test_search(written, query):
    texts, (index, documents) = written
    got = [(r.key, r.score) for r in fulltext.search(index, documents, query, top=None).collect()]
    order, scores = searched(texts, query)
    assert [k for k, _ in got] == order
    assert all(math.isclose(s, scores[k], rel_tol=1e-9) for k, s in got)
    assert {r.key for r in fulltext.matching(index, query).collect()} == set(order)
    assert {r.key for r in fulltext.matching(index, query, columns=[1]).collect()} == set(searched(texts, query, (1,))[0])


def test_folding_is_the_same_on_both_sides(spark):
    words = [chr(c) for c in range(0x41, 0x2100) if unicodedata.category(chr(c))[0] == "L" and c not in (0x130,)]
    got = [r[0] for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").select(fulltext.fold(F.col("w"))).collect()]
    assert got == [fulltext.folded(w) for w in words]
    assert fulltext.folded("Dvořák Việt é") == "dvorak viet e"


def test_filters_reach_the_files_and_queries_read_the_index(spark, sf_dir, written):
    plan = fulltext.matching(written[1][0], "the a_b")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,the)" in plan and "EqualTo(term,a)" in plan
    for name in ("fts_prefix_and", "fts_bm25_topk", "fts_phrase_topk", "fts_acl", "fts_columns"):
        files = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "/index-" in files, name


def test_upkeep(spark, written):
    texts, (index, documents) = written
    new = {100: ("zebra_crossing", "", None), 5000: ("the zebra crossing", None, None)}
    changed = spark.createDataFrame([(k, *t) for k, t in new.items()], "doc_id long, t0 string, t1 string, t2 string")
    gone = spark.createDataFrame([(0,), (10**6,)], "doc_id long")
    index, documents = fulltext.maintained(index, documents, changed, gone, columns=("t0", "t1", "t2"))
    after = {k: t for k, t in (texts | new).items() if k != 0}
    for query in ("the", "zebra_cro", "a_b"):
        assert [r.key for r in fulltext.search(index, documents, query, top=None).collect()] == searched(after, query)[0]


def test_visible(spark):
    docs = spark.createDataFrame([(1, 7, False, "done"), (2, 8, True, "done"), (3, 8, False, "done"), (4, 8, False, "done"), (5, 7, True, "gone")], "doc_id int, owner_id int, everyone boolean, state string")
    shares = spark.createDataFrame([(3, 7), (3, 7), (4, 9)], "doc_id int, user_id int")
    keys = lambda **kind: sorted(r.key for r in fulltext.visible(docs, shares, 7, F.col("state") != "gone", **kind).collect())
    assert keys() == [1, 2, 3] and keys(only=3) == [3]


def naive_snippet(columns, query, width):
    """The best window by trying every start in every column."""
    asked, best = fulltext.phrases(query), None
    for number, text in enumerate(columns):
        text = text or ""
        spans = [m.span() for m in regex.finditer(r"[\p{L}\p{N}\p{Co}\p{M}]+", text)]
        w = [fold(text[a:b]) for a, b in spans]
        hits = sorted((at, k, len(p)) for k, p in enumerate(asked) for at in starts(w, p))
        options = [(0, 0, 0, 0)]
        for start in range(len(w)):
            inside = [h for h in hits if start <= h[0] and h[0] + h[2] <= start + width]
            if inside:
                kinds = len({h[1] for h in inside})
                options.append((1000 * kinds + len(inside) - kinds, -inside[0][0], min(h[0] for h in inside), max(h[0] + h[2] for h in inside)))
        score, _, first, end = max(options)
        if best is None or score > best[0]:
            best = (score, number, first, end, text, spans, hits)
    _, _, first, end, text, spans, hits = best
    start = max(0, min(first - (width - (end - first)) // 2, len(spans) - width))
    stop = min(start + width, len(spans))
    shown = [h for h in hits if start <= h[0] and h[0] + h[2] <= stop]
    out = "…" if start > 0 else ""
    for i in range(start, stop):
        opened = any(h[0] <= i < h[0] + h[2] for h in shown)
        goes_on = lambda j: any(h[0] < j < h[0] + h[2] for h in shown)
        out += (text[spans[i - 1][1] : spans[i][0]] if i > start else "") + ("[[" if opened and not goes_on(i) else "") + text[spans[i][0] : spans[i][1]] + ("]]" if opened and not goes_on(i + 1) else "")
    return out + ("…" if stop < len(spans) else "")


@pytest.mark.parametrize("query", ["the", "a_b the", "c a_b_a", "été_a b", "zzz", "."])
def test_snippet(spark, query):
    rng = random.Random(query)
    rows = [(i, *(None if rng.random() < 0.1 else rng.choice(["", "«"]) + "".join(rng.choice(["a", "b", "c", "the", "été", "Theme"]) + rng.choice([" ", ", ", "-", "_", "\n"]) for _ in range(rng.randint(0, 40))) for _ in range(2))) for i in range(80)]
    given = spark.createDataFrame(rows, "i int, a string, b string")
    got = {r.i: r.s for r in fulltext.snippets(given, ["a", "b"], query, 6, "s").collect()}
    for i, a, b in rows:
        assert got[i] == naive_snippet([a, b], query, 6), (a, b)


def test_snippet_query(spark, sf_dir):
    from parley.plans.derive import lines

    got = {(r.meeting_id, r.line_id): r.snippet for r in registry.QUERIES["window_snippet"](spark, sf_dir).collect()}
    for r in lines(spark, sf_dir).collect():
        assert got[r.meeting_id, r.line_id] == naive_snippet([r.speaker, r.text], "the_o an us", 16)


def test_markers(spark):
    from parley.operators import search

    assert spark.range(1).select(search.markers(F.lit("x [[the]] y [[a b]]"))).first()[0] == ["the", "a b"]
    assert re.findall(r"\[\[(.*?)\]\]", "[[]]") == spark.range(1).select(search.markers(F.lit("[[]]"))).first()[0]

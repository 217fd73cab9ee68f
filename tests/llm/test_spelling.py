"""The trie join against all pairs, the vocabulary against Python's crc32, and the registered query against both."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from parley.llm import queries, spelling


def near(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def counted(rows, shortest=6, occurrences=5):
    """The vocabulary in plain Python."""
    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= occurrences}


def neighbours(words):
    """Near words by a table of words that lack one code point, checked by ``near``."""
    by_hole, out = defaultdict(set), defaultdict(set)
    for w in words:
        for h in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            by_hole[h].add(w)
    for group in by_hole.values():
        for a in group:
            out[a] |= {b for b in group if b != a and near(a, b)}
    return out


def formed(n, times=5):
    out, best = {}, neighbours(n)
    form = {}
    for w in n:
        top = min(best[w], key=lambda x: (-n[x], x), default=None)
        form[w] = top if top is not None and n[top] >= times * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(best[w]), n[form[w]] if form[w] else None)
    return out


def as_dict(df):
    rows = df.collect()
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(found) == len(rows)
    return found


def test_kernel_against_all_pairs():
    rng = random.Random(5)
    for turn in range(200):
        letters = ("ab", "abcdé", "ac\U0001f642")[turn % 3]
        rows = sorted({(rng.randint(0, 2), "".join(rng.choices(letters, k=rng.randint(0, 6)))) for _ in range(rng.randint(1, 60))})
        group = np.unique([g for g, _ in rows], return_inverse=True)[1]
        i, j = spelling.near_pairs(group, [r for _, r in rows])
        want = sorted((x, y) for y in range(len(rows)) for x in range(y) if group[x] == group[y] and near(rows[x][1], rows[y][1]))
        assert sorted(tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)) == want


@pytest.mark.parametrize("most", [spelling.MOST, 40])
def test_forms_of_random_words(spark, most):
    rng = random.Random(7)
    words = {"".join(rng.choices("abÿ", k=rng.randint(1, 9))): rng.choice([5, 5, 30, 200, 1200, 8000]) for _ in range(700)}
    words |= {"a" * k: 10 for k in (4, 5, 6, 400)} | {"a" * 399 + "b": 60, "\U0001f642" * 3: 5, "\U0001f642" * 4: 25}
    given = spark.createDataFrame(list(words.items()), "word string, n long")
    assert as_dict(spelling.forms(given, most=most)) == formed(words)


def test_hot_prefix_is_split(spark):
    """Half of all words share their first three code points; no trie holds more than a few of them."""
    rng = random.Random(3)
    words = {"the" + "".join(rng.choices("abc", k=rng.randint(3, 5))): rng.choice([5, 50, 600]) for _ in range(400)}
    words |= {w[::-1]: 7 for w in list(words)[:60]}
    given = spark.createDataFrame(list(words.items()), "word string, n long")
    assert as_dict(spelling.forms(given, most=25)) == formed(words)


def test_vocabulary(spark, docs, rows):
    got = {r.word: r.n for r in spelling.vocabulary(docs, occurrences=1).collect()}
    assert got == counted([(r.doc_id, r.text) for r in rows], occurrences=1)
    whole = spelling.vocabulary(docs, damage=None, occurrences=1, shortest=1).count()
    assert whole == len({"".join(c.lower() if c.isascii() else c for c in w) for r in rows for w in re.findall("[A-Za-zÀ-ÿ]+", r.text or "")})


def test_query_as_registered(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = as_dict(queries.QUERIES["op13_variants"](spark, sf_dir))
    assert got == formed(counted(docs))
    assert any(v[0] for v in got.values())


def test_empty_table(spark, empty):
    assert spelling.forms(spelling.vocabulary(empty)).collect() == []

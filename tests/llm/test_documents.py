"""The operators on documents against brute force: whole results, awkward texts, repeated rows, empty tables."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from public_tokenizers import path

import corpus_pipeline
from parley.llm import fst, licenses, linededup, mixing, neardup, packing, quality, sharding, wavelet
from parley.plans.shared import materialize, work_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE, PIECE = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


@pytest.fixture(scope="module")
def ids(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    return [t.encode(r.text or "", add_special_tokens=False).ids for r in rows]


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_mix(docs, rows, empty):
    slim = materialize(mixing.sized(docs))
    got = mixing.mix(slim, slim).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(slim, slim).collect()))
    size = Counter()
    for r in rows:
        size[r.source] += len(words(r.text))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: [3, 1, 2][i % 3] for i, s in enumerate(names)}
    target, open_, budget = {}, set(names), 1.5 * sum(size.values())
    while True:
        level = budget / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * size[s]}
        if not over:
            break
        target |= {s: 2 * size[s] for s in over}
        budget -= sum(2 * size[s] for s in over)
        open_ -= over
    target |= {s: weight[s] * level for s in open_}
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((r.doc_id or -1, len(words(r.text))) for r in rows)
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    none = materialize(mixing.sized(empty))
    assert mixing.mix(none, none).count() == 0
    assert mixing.repeated(docs).columns == docs.columns


def test_pack(docs, rows, ids, empty):
    got = packing.pack(materialize(packing.pieces(docs, BPE))).collect()
    want = Counter()
    for r, x in zip(rows, ids, strict=True):
        x = [*x, 0]
        want.update((r.doc_id, k, len(x[k : k + 1024]), crc(x[k : k + 1024]), len(x)) for k in range(0, len(x), 1024))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for x in held.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(held) == list(range(len(held)))
    assert len(held) <= -(-sum(r.length for r in got) // 1024) * 1.03 + 1
    assert packing.pack(materialize(packing.pieces(empty, BPE))).count() == 0


def test_shards(docs, rows, empty):
    got = sharding.assign(docs).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    load, slots = Counter(), defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(load) == set(range(8)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    mean = sum(load.values()) / 8
    assert max(load.values()) <= mean + max(r.size for r in got)
    assert sharding.assign(empty).count() == 0


def test_token_files(spark, docs, rows, ids, empty):
    folder = f"{work_folder(spark)}/files"
    wavelet.write(docs, BPE, folder, shard_ids=50_000)
    got = wavelet.read(spark, folder).orderBy("start").collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((r.doc_id, len(x) + 1, crc([*x, 2])) for r, x in zip(rows, ids, strict=True))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    wavelet.write(empty, BPE, f"{folder}-none")
    assert wavelet.read(spark, f"{folder}-none").count() == 0


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (700_000, 50_000), (5000, 3), (300_000, 70_000)):
        x = rng.integers(0, top, n)
        shard = wavelet.Shard(wavelet.write_shard(x.astype(np.uint32), np.array([n]), [None]))
        assert (shard.tokens() == x).all() and shard.doc_ids == [None]
        for i in {0, n // 2, n - 1}:
            t = int(x[i])
            assert shard.token(i) == t and shard.count(t) == int((x == t).sum()) and shard.count(t, i) == int((x[:i] == t).sum())
            assert n > 100_000 and top > 3 and shard.places(t) == np.flatnonzero(x == t).tolist() or n <= 100_000
        assert shard.count(1 << 20) == 0 and shard.places(1 << 20) == []


def test_quality(docs, rows, empty):
    got = quality.judge(docs).collect()

    def measures(t):
        w, t = words(t), t or ""
        lines = [x for x in t.split("\n") if WORD.search(x)]
        n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)

    want = Counter((r.doc_id, *(m := measures(r.text)), m[0] < 10 or 100 * m[4] > 20 * m[0]) for r in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(not (r.base_failed and r.kept) for r in got)
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert quality.judge(empty).count() == 0 and quality.kept_documents(empty).count() == 0


def test_host_rates_and_verdicts(spark):
    """host_rate and kept against the prior in plain Python; hosts that differ by chance alone get the corpus's rate."""
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for host, (size, bad) in enumerate(((400, 0.7), (300, 0.1), (200, 0.15), (60, 0.5), (3, 1.0), (500, 0.05))):
        for _ in range(size):
            text = "too short" if rng.random() < bad else " ".join(f"w{n}x{j}" for j in range(30)) + " #" * int(rng.integers(0, 30))
            rows.append((n, text, None if host == 5 else f"h{host}"))
            n += 1
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    fails = {d: r.base_failed or 100 * r.n_symbols > 10 * r.word_chars for d, r in got.items()}
    size, bad = Counter(h for _, _, h in rows), Counter(h for d, _, h in rows if fails[d])
    total, m = len(rows), sum(fails.values()) / len(rows)
    squares = sum(size[h] * (bad[h] / size[h] - m) ** 2 for h in size)
    v = (squares - (len(size) - 1) * m * (1 - m)) / (total - sum(x * x for x in size.values()) / total)
    strength = max(1.0, m * (1 - m) / v - 1)
    for d, _, h in rows:
        rate = (bad[h] + m * strength) / (size[h] + strength)
        assert got[d].host_rate == pytest.approx(rate)
        share = max(0.5, m / rate) if rate > m else 1.0
        edge = 100 * got[d].n_symbols > 10 * share * got[d].word_chars
        assert got[d].kept == (not fails[d] and rate <= 0.5 and not edge), d
    even = [(i, "too short" if i % 4 == 0 else " ".join(f"w{i}x{j}" for j in range(20)), f"h{i % 80}") for i in range(0, 960)]
    even = [(i, t, f"h{int(rng.integers(0, 80))}") for i, t, _ in even]
    rates = {round(r.host_rate, 9) for r in quality.judge(spark.createDataFrame(even, "doc_id long, text string, source string")).collect()}
    assert max(rates) < 0.35 and min(rates) > 0.15


def test_bad_host_goes(spark):
    rows = [(i, "too short", "bad") for i in range(60)] + [(i + 60, f"ten words that stand in a text of some host {i}", "bad" if i < 10 else "good") for i in range(300)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id for r in got if r.kept} == set(range(70, 360))


def simhash(text):
    w = lower(text).encode().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, rows, empty):
    got = neardup.near_duplicates(docs).collect()
    prints = [simhash(r.text) for r in rows]
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((r.doc_id, f"{p:016x}") for r, p in zip(rows, prints, strict=True))
    names = sorted(set(prints))
    root = {p: p for p in names}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(names):
        for b in names[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for r, p in zip(rows, prints, strict=True):
        if r.doc_id is not None:
            least[find(p)] = min(r.doc_id, least.get(find(p), r.doc_id))
    for r in got:
        assert r.component_id == least.get(find(int(r.fingerprint, 16)))
    one = neardup.one_of_each(docs)
    assert one.columns == docs.columns and one.count() == len({find(p) for p in prints})
    assert neardup.near_duplicates(empty).count() == 0 and neardup.one_of_each(empty).count() == 0


def test_links_in_hot_keys(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 3, dtype=np.uint64)
    some = {int(b) ^ (1 << int(i)) ^ (1 << int(j)) ^ (1 << int(k)) for b in base for i, j, k in rng.integers(0, 64, (300, 3))}
    monkeypatch.setattr(neardup, "HOT_KEY", 40)
    table = materialize(spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in some], "fp long"))
    root = {r.node & (1 << 64) - 1: r.root for r in neardup.components(neardup.links(table)).collect()}
    left, want = set(some), []
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= 2}
            left -= near
            todo += near
        want.append(group)
    assert {frozenset(g) for g in want if len(g) > 1} == {frozenset(x for x in root if root[x] == r) for r in set(root.values())}


def test_token_counts(docs, rows, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = Counter((r.doc_id, len((r.text or "").encode()), n := len(sp.encode(r.text or "")), n > 4096) for r in rows)
    assert Counter(tuple(r) for r in fst.counted(docs, PIECE).collect()) == want
    assert fst.counted(empty, PIECE).count() == 0
    texts = [r.text for r in rows]
    for chunk in (7, 64):
        assert fst.transducer(PIECE).count(texts, chunk).tolist() == [len(sp.encode(t or "")) for t in texts]
    # Texts in parts, and texts without a break, whose chunks' maps are composed.
    solid = ["".join("abcdefghijklmnopqrstuvwxyz"[(i * i + i // 7) % 26] for i in range(5000)), "x" * 1500, "the" * 700, "ab" * 2000 + "c"]
    want = [len(sp.encode(t)) for t in solid]
    for chunk, at_once in ((7, 100), (64, 1000), (512, 1 << 20)):
        assert fst.transducer(PIECE).count(solid, chunk, at_once).tolist() == want
    assert fst.transducer(PIECE).count(texts, 64, 500).tolist() == [len(sp.encode(t or "")) for t in texts]


def test_composed_maps():
    """Composition is associative and a scan gives the prefixes that one step after another gives."""
    rng = np.random.default_rng(4)
    maps = [{e: (int(rng.integers(0, 5)), int(rng.integers(0, 9))) for e in rng.permutation(5)[:4].tolist()} for _ in range(13)]
    step = [maps[0]]
    for m in maps[1:]:
        step.append(fst.composed(step[-1], m))
    assert fst.scan(maps) == step
    assert fst.composed(fst.composed(maps[0], maps[1]), maps[2]) == fst.composed(maps[0], fst.composed(maps[1], maps[2]))


def test_licenses(docs, rows, empty):
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = [(k.split(), v) for k, v in licenses.PHRASES.items()]
    want = Counter()
    for r in rows:
        w = split.findall(lower(r.text))
        hits = [(i, v) for p, v in phrases for i in range(len(w)) if w[i : i + len(p)] == p]
        at = [i for i, _ in hits]
        want[r.doc_id, len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({v for _, v in hits}))] += 1
    got = licenses.scan(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert licenses.scan(empty).count() == 0


def voted(text):
    """The diagonal vote in plain Python: label and cover of every template span of a text."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    w, k, out = split(text), licenses.K, []
    grams = defaultdict(list)
    for i in range(len(w) - k + 1):
        grams[tuple(w[i : i + k])].append(i)
    for label, template in licenses.wordings():
        t = split(template)
        n = len(t) - k + 1
        by = defaultdict(list)
        for at in range(n):
            for pos in grams.get(tuple(t[at : at + k]), ()):
                by[pos - at].append((at, pos))
        runs = []
        for d in sorted(by):
            if not runs or d - runs[-1][0] > licenses.NEAR:
                runs.append([d, []])
            runs[-1][0] = d
            runs[-1][1] += by[d]
        runs = [(min(p for _, p in x), max(p for _, p in x), {a for a, _ in x}) for _, x in runs]
        runs = sorted((r for r in runs if len(r[2]) >= min(licenses.STRETCH, n)), key=lambda r: r[:2])
        copies = []
        for i, (lo, hi, ats) in enumerate(runs):
            if i and lo - runs[i - 1][1] <= licenses.BETWEEN + k and min(ats) > min(runs[i - 1][2]):
                copies[-1] = (min(copies[-1][0], lo), max(copies[-1][1], hi), copies[-1][2] | ats)
            else:
                copies.append((lo, hi, ats))
        out += [(label, len(ats) / n) for lo, hi, ats in copies if len(ats) / n >= licenses.COVER and hi + k - 1 - lo < 2 * (n + k)]
    return out


def test_license_votes(spark, docs, rows):
    """labels and score against the vote in plain Python, also on edited copies: words taken out, put in, changed."""
    rng = np.random.default_rng(6)
    made = []
    for i, (_, t) in enumerate(licenses.wordings()):
        for j, n in enumerate((0, 1, 2, 4, 8)):
            w = t.split()
            for _ in range(n):
                at = int(rng.integers(0, len(w)))
                kind = int(rng.integers(0, 3))
                w[at : at + (kind != 1)] = [] if kind == 0 else [f"x{x}" for x in range(int(rng.integers(1, 6)))]
            made.append((900_000 + 10 * i + j, " ".join([*(f"n{x}" for x in range(30)), *w, *(f"m{x}" for x in range(30)), *w[: len(w) // 2]])))
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    got = Counter((r.doc_id, r.labels, round(r.score, 9)) for r in licenses.scan(table).collect())
    want = Counter()
    for d, t in [(r.doc_id, r.text) for r in rows] + made:
        base = {v for k, v in licenses.PHRASES.items() if f" {k} " in f" {' '.join(re.findall(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+', lower(t)))} "}
        found = voted(t)
        want[d, ",".join(sorted(base | {x for x, _ in found})), round(max([1.0 if base else 0.0, *(c for _, c in found)]), 9)] += 1
    assert got == want


def test_words_put_into_a_license(spark):
    t = licenses.TEMPLATES["mit"].split()
    text = " ".join([*t[:14], "and", "here", "some", "six", "more", "words", *t[14:]])
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.labels == "mit" and got.score > 0.8


def test_license_templates(spark):
    noise = " ".join(f"n{i}" for i in range(400))
    rows = [(i, f"{noise} {t} {noise}", n) for i, (n, t) in enumerate(licenses.TEMPLATES.items())]
    rows += [(50 + i, " ".join(w for j, w in enumerate(t.split()) if j != 12), n) for i, (n, t) in enumerate(licenses.TEMPLATES.items()) if len(t.split()) > 15]
    rows += [(90, noise, ""), (91, "permission to use is granted in writing", "")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    for i, _, name in rows:
        assert (name in got[i].labels.split(",")) if name else got[i].labels == "", (i, name, got[i])


def test_line_runs(spark, docs, rows, empty):
    """Later copies of every maximal repeated run go, whatever stands around them; the first copy stays."""
    got = linededup.without_copies(docs)
    assert got.columns == [*docs.columns, "__n_lines", "__n_removed"]
    out = got.collect()
    assert len(out) == len(rows)
    seen = {}
    order = sorted({tuple(r) for r in rows if r.text}, key=lambda r: (r[0] is None, r[0] or 0))
    texts = {r[0]: r[1].split("\n") for r in order}
    # Brute force: a line goes if it lies in a run of 50 words or more of which an earlier copy starts elsewhere.
    for d, lines in texts.items():
        for i in range(len(lines)):
            n = 0
            for j in range(i, len(lines)):
                n += len(words(lines[j]))
                if n >= 50:
                    seen.setdefault(tuple(lines[i : j + 1]), (d is None, d or 0, i))
                    if n >= 50 + 400:
                        break
    gone = defaultdict(set)
    for d, lines in texts.items():
        for i in range(len(lines)):
            n = 0
            for j in range(i, len(lines)):
                n += len(words(lines[j]))
                if n >= 50:
                    if seen.get(tuple(lines[i : j + 1]), (d is None, d or 0, i)) < (d is None, d or 0, i):
                        gone[d].update(range(i, j + 1))
                    if n >= 50 + 400:
                        break
    for r in out:
        if r.text is None:
            continue
        want = "\n".join(x for i, x in enumerate(texts[r.doc_id]) if i not in gone[r.doc_id]) if r.doc_id in texts else r.text
        assert r.text == want, r.doc_id
        assert r["__n_removed"] == len(gone[r.doc_id])
    assert linededup.without_copies(empty).count() == 0


def grams(text, n=5):
    w = lower(text).encode().split()
    return {b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_near_copies_by_similarity(spark, docs, rows, sf_dir):
    """One document of each class of Jaccard similarity 0.8 or more stays, though most near copies differ in over 2 bits."""
    rng = np.random.default_rng(11)
    base = [f"v{x}" for x in rng.integers(0, 5000, 300)]
    texts = []
    for n in (0, 1, 2, 3, 5, 20, 60):  # words changed: the last two are other texts
        w = list(base)
        for i in range(n):
            w[7 + i * (280 // max(n, 1))] = f"new{n}x{i}"
        texts.append(" ".join(w))
    names = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    own = spark.createDataFrame([(500_000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    all_docs = docs.select(*names).unionByName(own, allowMissingColumns=True)
    got = corpus_pipeline.near_duplicate_stage(spark, all_docs, sf_dir).collect()
    sets = [grams(r.text) for r in rows] + [grams(t) for t in texts]
    ids = [r.doc_id for r in rows] + [500_000 + i for i in range(len(texts))]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (not a and not b) or (min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b) - 1e-9):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), (True, 0)), (d is None, d or 0))
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in got) == Counter(least.values())
    assert sorted(r.doc_id for r in got if r.doc_id and r.doc_id >= 500_000) == [500_000, 500_005, 500_006]


def test_near_copies_with_any_bits(spark, monkeypatch):
    """Texts whose shingle sets are alike but whose fingerprints are not, as one repeats a paragraph many times, and short ones."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = np.random.default_rng(8)
    rows = []
    for k in range(40):
        own = " ".join(f"w{k}x{i}" for i in range(400))
        passage = " ".join(f"p{k}x{i}" for i in range(40))
        rows += [(4 * k, f"{own} {passage}"), (4 * k + 1, f"{own} " + " ".join([passage] * 12))]
        word = [f"s{k}x{i}" for i in rng.permutation(12)]  # 8 shingles, and the 9 of a text with a word more: 0.89
        rows += [(4 * k + 2, " ".join(word)), (4 * k + 3, " ".join([*word, "more"]))]
    bits = neardup.fingerprint([t for _, t in rows], 5)
    assert max(int(bits[4 * k] ^ bits[4 * k + 1]).bit_count() for k in range(40)) > neardup.LIMIT_NEAR
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id for r in neardup.one_of_each(docs, limit=neardup.LIMIT_NEAR, shingle=5, similarity=0.8).collect()}
    assert got == {i for i, _ in rows if i % 2 == 0}


def test_near_copies_by_pivots(spark, monkeypatch):
    """Pivot tables alone give the near copies of few bits, those of one fingerprint too; the sets refuse what only looks alike."""
    words = lambda k: [f"w{k}x{i}" for i in range(1500)]
    rows = []
    for k in range(30):
        changed = words(k)
        changed[700] = "new"
        rows += [(2 * k, " ".join(words(k))), (2 * k + 1, " ".join(changed))]
    passage = " ".join(f"p{i}" for i in range(200))
    rows += [(60, " ".join([passage] * 12)), (61, " ".join([passage] * 12 + [f"q{i}" for i in range(60)]))]
    bits = neardup.fingerprint([t for _, t in rows], 5)
    differ = [int(bits[2 * k] ^ bits[2 * k + 1]).bit_count() for k in range(31)]
    assert 0 in differ[:30] and 1 <= sum(0 < x <= neardup.LIMIT for x in differ[:30]) and differ[30] <= neardup.LIMIT
    meet = lambda *_: spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(neardup, "meetings", meet)
    monkeypatch.setattr(neardup, "other_meetings", meet)
    monkeypatch.setattr(neardup, "HOT_KEY", 10)
    got = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert got == {i for i, _ in rows if i % 2 == 0 or i == 61 or differ[i // 2] > neardup.LIMIT}


def test_near_copies_around_the_similarity(spark, monkeypatch):
    """A large group just around 0.8, in blocks of a few names: bitmaps lose no pair, and the classes are those of brute force."""
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rng = np.random.default_rng(5)
    base, texts = [f"b{i}" for i in range(400)], []
    for k in range(60):
        w = list(base)
        for at in rng.choice(400, int(rng.integers(4, 10)), replace=False):
            w[at] = f"n{k}x{at}"
        texts.append(" ".join(w))
    texts += texts[:3]
    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-9:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = neardup.one_of_each(docs, limit=neardup.LIMIT_NEAR, shingle=5, similarity=0.8).collect()
    assert sorted(r.doc_id for r in got) == sorted({root.index(r) for r in root})
    assert 1 < len(got) < 60


def test_wider_limit_of_bits(spark):
    base = 0x0123456789ABCDEF
    table = materialize(spark.createDataFrame([(base ^ x,) for x in (0, 0b11111 << 7, 0b10101010101 << 20, 0b111111111 << 40)], "fp long"))
    linked = {r.node for r in neardup.components(neardup.links(table, 6)).collect()}
    assert linked == {base, base ^ 0b11111 << 7, base ^ 0b10101010101 << 20}


def test_short_runs(docs, rows):
    """Runs of fewer words go if more documents hold them: every stretch is counted, whatever its place."""
    rules = linededup.RUNS
    got = linededup.without_copies(docs, rules=rules).collect()
    texts = {(r.doc_id is None, r.doc_id or 0): r.text.split("\n") for r in rows if r.text}
    held = defaultdict(list)
    n_words = {x: len(words(x)) for lines in texts.values() for x in lines}
    for d, lines in texts.items():
        for i in range(len(lines)):
            n = 0
            for j in range(i, len(lines)):
                n += n_words[lines[j]]
                if n >= 2:
                    held[tuple(lines[i : j + 1])].append((d, i))
                if n >= 450:
                    break
    gone = defaultdict(set)
    for run, at in held.items():
        n, n_docs = sum(n_words[x] for x in run), len({d for d, _ in at})
        if any(n >= w and len(at) >= c and n_docs >= k for w, c, k in rules):
            for d, i in sorted(at)[1:]:
                gone[d].update(range(i, i + len(run)))
    for r in got:
        if r.text is not None and (d := (r.doc_id is None, r.doc_id or 0)) in texts:
            assert r.text == "\n".join(x for i, x in enumerate(texts[d]) if i not in gone[d]), d
            assert r["__n_removed"] == len(gone[d])


def test_short_line_of_many_documents(spark):
    rows = [(i, f"own line {i}\n\nread this line of nine words again every day\nThanks\nmany thanks\nend {i}") for i in range(12)]
    rows += [(20 + i, f"alone {i}\na refrain of eight words in two documents") for i in range(2)]
    got = {r.doc_id: r.text for r in linededup.without_copies(spark.createDataFrame(rows, "doc_id long, text string"), rules=linededup.RUNS).collect()}
    assert got[0] == rows[0][1] and got[20] == rows[12][1] and got[21] == rows[13][1]
    assert all("nine words" not in got[i] and "many thanks" not in got[i] and f"own line {i}" in got[i] for i in range(1, 12))
    one = spark.createDataFrame([(i, f"start of {i}\nThanks\n\nend of {i}") for i in range(12)], "doc_id long, text string")
    assert all(r["__n_removed"] == 0 for r in linededup.without_copies(one, rules=linededup.RUNS).collect())


def test_junk_of_symbols_and_lines_goes(spark):
    clean = [" ".join(f"word{i}x{j}" for j in range(40)) + " #tag costs $5 & more" for i in range(40)]
    signs = [" ".join(f"w{i}x{j}" + ("###" if j % 2 else "$$$") for j in range(40)) for i in range(10)]
    lines = ["\n".join(["menu bar"] * 8) + f"\n{' '.join(f'q{i}x{j}' for j in range(80))}" for i in range(10)]
    rows = [(i, t, "b" if i % 2 else "a") for i, t in enumerate([*clean, *signs, *lines])]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = quality.judge(table).collect()
    assert {r.doc_id for r in got if r.kept} == set(range(40)) and not any(r.base_failed for r in got)
    assert {r.doc_id for r in quality.kept_documents(table).collect()} == set(range(40))
    assert all(abs(r.host_rate - 1 / 3) < 1e-6 for r in got)


def test_host_decides_borderline_documents(spark):
    plain = lambda i: " ".join(f"p{i}x{j}" for j in range(40))
    edge = lambda i: " ".join(f"p{i}x{j}yy" for j in range(40)) + " " + "#" * 19  # noqa: E731, about 7 in 100
    rows = [(i, "too short", "bad") for i in range(40)] + [(i, plain(i), "bad") for i in range(40, 100)] + [(i, plain(i), "good") for i in range(100, 400)]
    rows += [(500, edge(500), "bad"), (501, edge(501), "good")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = quality.judge(table).collect()
    assert {r.doc_id for r in got if r.by_host} == {500} and {r.doc_id for r in got if not r.kept} == {*range(40), 500}
    assert {r.doc_id for r in quality.kept_documents(table).collect()} == {*range(40, 400), 501}


def test_common_token_is_found_fast():
    """Counting and finding a common token in a shard of 4 million ids takes well under a second."""
    import time

    rng = np.random.default_rng(2)
    x = (rng.zipf(1.3, 1 << 22) % 50_257).astype(np.uint32)
    shard = wavelet.Shard(wavelet.write_shard(x, np.array([len(x)]), [1]))
    token = int(np.bincount(x).argmax())
    begun = time.process_time()
    assert shard.count(token) == int((x == token).sum())
    assert time.process_time() - begun < 0.5
    begun = time.process_time()
    found = shard.places(token)
    assert time.process_time() - begun < 2  # all 16 planes of the occurrences, over a quarter of all ids
    assert found == np.flatnonzero(x == token).tolist()
    begun = time.process_time()
    rare = int(x[12345])
    assert shard.places(rare) == np.flatnonzero(x == rare).tolist() and time.process_time() - begun < 2


def test_many_rows_of_one_id(spark, sf_dir):
    rows = [(7, f"text {i % 40}") for i in range(200)] + [(None, "no id")] * 5 + [(3, None)]
    folder = f"{work_folder(spark)}/one-id"
    wavelet.write(spark.createDataFrame(rows, "doc_id long, text string"), BPE, folder, shard_ids=100)
    got = wavelet.read(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 5 + [3] + [7] * 200 and got[5].n_tokens == 1
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got][:-1]]).tolist()


def test_no_distinct_row_is_lost(spark):
    """Rows that differ in which column is null, or in a map, are different rows."""
    rows = [(None, "same text", None, {"a": 1}), (None, None, "same text", {"a": 1}), (1, "same text", None, {"a": 2}), (1, "same text", None, {"a": 3})]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, kind map<string,int>")
    got = neardup.one_of_each(table).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter({(1, "same text"): 1, (None, None): 1})
    long = "\n".join(f"line {i} " + " ".join(f"w{i}x{j}" for j in range(12)) for i in range(5))
    two = spark.createDataFrame([(None, long, None, {"a": 1}), (None, long, "x", {"a": 1}), (None, None, long, None)], table.schema)
    out = linededup.without_copies(two)
    assert sorted(r["__n_removed"] for r in out.collect()) == [0, 0, 5] and out.count() == 3
    assert mixing.repeated(table).columns == table.columns and quality.kept_documents(table).count() == 0


def test_cells_stay_small(spark, monkeypatch):
    """Cells are cut by further pivots until they are small, and every link stays within one."""
    rng = np.random.default_rng(9)
    x = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    x = np.unique(np.r_[x, x[:300] ^ np.uint64(1 << 40), x[:200] ^ np.uint64((1 << 3) | (1 << 62))])
    monkeypatch.setattr(neardup, "HOT_KEY", 100)
    table = materialize(spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long"))
    sizes = [r["count"] for r in neardup.cells(materialize(neardup.pivot_table(table))).groupBy("cell").count().collect()]
    assert max(sizes) <= 100
    linked = {r.node for r in neardup.components(neardup.links(table)).collect()}
    want = set()
    for i, v in enumerate(x):
        near = np.bitwise_count(x ^ v) <= 2
        near[i] = False
        if near.any():
            want.add(int(v.view(np.int64)))
    assert linked == want


@pytest.mark.parametrize("n", [3000, 12000])
def test_copies_in_cells_do_not_grow(spark, monkeypatch, n):
    """A fingerprint stands in as many cells as the limit asks for, however many there are, and cells are small."""
    monkeypatch.setattr(neardup, "HOT_KEY", 30)
    x = np.unique(np.random.default_rng(11).integers(0, 1 << 63, n, dtype=np.uint64))
    table = materialize(spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long"))
    sizes = [r["count"] for r in neardup.cells(materialize(neardup.pivot_table(table))).groupBy("cell").count().collect()]
    assert sum(sizes) == 3 * len(x) and max(sizes) <= 30


def test_links_where_cells_are_cut_to_the_end(spark, monkeypatch):
    """Any two differing bits are found in crowded cells, cut as often as cuts go; three bits are no link."""
    monkeypatch.setattr(neardup, "HOT_KEY", 5)
    base = 0x0F1E2D3C4B5A6978
    x = [base] + [base ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)]
    far = base ^ (1 << 64) - 1
    x += [far, far ^ 0b111 << 30]
    longs = np.array(x, dtype=np.uint64).view(np.int64).tolist()
    table = materialize(spark.createDataFrame([(v,) for v in longs], "fp long"))
    root = {r.node: r.root for r in neardup.components(neardup.links(table)).collect()}
    assert set(root) == set(longs[:-2]) and set(root.values()) == {min(longs[:-2])}

"""Nearest neighbours, spelling variants and phrase collocations against brute force."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellarium.llm import neighbours, phrases, spelling

VECTORS = "vec_id long, embedding array<double>, label string"


def cosine(x, y):
    x, y = np.asarray(x, float), np.asarray(y, float)
    return float(x @ y / np.sqrt((x @ x) * (y @ y)))


def usable(v):
    return v and all(x is not None and np.isfinite(x) for x in v) and any(v)


def exact_nearest(rows, asks, k):
    good = [(i, v) for i, v in rows if usable(v)]
    out = {}
    for at, (i, v) in enumerate(good):
        if i is not None and asks(i):
            near = [(-cosine(v, w), j if j is not None else 1 << 63) for b, (j, w) in enumerate(good) if b != at and len(w) == len(v)]
            out.setdefault(i, []).append(sorted(near)[:k])
    return out


def test_hadamard_and_probes():
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(neighbours.hadamard(neighbours.hadamard(x)), x)
    unit = neighbours._units(np.random.default_rng(2).normal(size=(40, 6)))
    for depth in (1, 2):
        every = neighbours.probes(unit, 3, depth, 10**6)
        assert every.shape == (40, 16**depth) and all(len(set(r)) == len(r) for r in every.tolist())
        assert (neighbours.probes(unit, 3, depth, 7) == every[:, :7]).all()
        assert (every[:, 0] == neighbours.buckets(unit, 3, depth)).all()


def test_nearest_recall(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(3000, 24))
    vectors[1000:1400] = vectors[0] + 0.01 * rng.normal(size=(400, 24))  # a crowded bucket
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    got = collections.defaultdict(list)
    for r in neighbours.nearest(spark.createDataFrame([(*r, "x") for r in rows], VECTORS), F.col("vec_id") % 50 == 0, 5).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = 0
    for i, (want,) in exact_nearest(rows, lambda i: i % 50 == 0, 5).items():
        have = sorted(got[i])
        assert [r for r, _, _ in have] == [1, 2, 3, 4, 5]
        assert all(abs(s - cosine(vectors[i], vectors[j])) < 1e-12 for _, j, s in have)
        assert [(-s, j) for _, j, s in have] == sorted((-s, j) for _, j, s in have)
        hits += len({j for _, j in want} & {j for _, j, _ in have})
    assert hits >= 0.9 * 5 * 60


def test_nearest_awkward(spark):
    """Few rows are searched exactly: ties, repeated ids and vectors, unusable ones, other lengths, clashing columns."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [2.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [-1.0, 0.0]), (None, [1.0, 0.1]), (100, None), (150, []), (200, [0.0, 0.0]),
            (250, [nan, 1.0]), (300, [inf, 1.0]), (350, [None, 1.0]), (400, [1.0, 2.0, 3.0]), (4, [1.0, 2.0, 4.0]), (0, [1.0, 0.0]), (7, [1e200, 1e200]), (450, [5.0])]
    rows += [(50, [2.0, 0.0])] * 3
    df = spark.createDataFrame([(*r, "clash") for r in rows], VECTORS).withColumns({c: F.lit("clash") for c in ("h1", "h2", "bucket", "tab", "width", "score", "rank", "asks", "ids")})
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0, 5).collect():
        got[r.query_id].append((r.rank, r.vec_id if r.vec_id is not None else 1 << 63, round(r.score, 9)))
    want = exact_nearest(rows, lambda i: i % 50 == 0, 5)
    flat = {i: sorted((k, j, round(-s, 9)) for near in lists for k, (s, j) in enumerate(near, 1)) for i, lists in want.items() if any(lists)}
    assert {i: sorted(v) for i, v in got.items()} == flat
    assert 450 not in got and 400 in got
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_nearest_of_very_many_copies(spark):
    many = spark.range(20_000).select((F.col("id") * 50).alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    rows = neighbours.nearest(many, F.col("vec_id") % 50 == 0, 5).filter("query_id IN (0, 100, 999950)").orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in rows] == [50, 100, 150, 200, 250, 0, 50, 150, 200, 250, 0, 50, 100, 150, 200]


def edits(word, vocabulary):
    near = set()
    for i in range(len(word)):
        near |= {w for w in vocabulary if len(w) == len(word) and w != word and w[:i] == word[:i] and w[i + 1 :] == word[i + 1 :]}
        if word[:i] + word[i + 1 :] in vocabulary:
            near.add(word[:i] + word[i + 1 :])
    return near | {w for w in vocabulary if len(w) == len(word) + 1 and any(w[:i] + w[i + 1 :] == word for i in range(len(w)))}


def plain_variants(docs):
    count = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}
    form, near = {}, {}
    for w in n:
        near[w] = edits(w, n)
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def spelled(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(df).collect()}


def test_spelling_against_plain(documents):
    rng = np.random.default_rng(3)
    alphabet = list("abéAB")
    words = ["".join(rng.choice(alphabet, rng.integers(4, 8))) for _ in range(120)]
    weight = 1 / np.arange(1, 121)
    docs = [(i, " ".join(rng.choice(words, 150, p=weight / weight.sum())) + ",ÀÉÿ×÷x3word") for i in range(60)]
    want = plain_variants(docs)
    assert spelled(documents(*docs)) == want
    assert sum(v[0] is not None for v in want.values()) > 20 and any(v[0] and v[0] != v[1] for v in want.values()) and max(v[3] for v in want.values()) > 4


def test_spelling_awkward(awkward, none, documents):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert spelled(awkward) == plain_variants(rows)
    assert spelled(none) == {}
    # Very long words, a stretch of equal letters, and one row very often.
    docs = [(1, "z" * 30_000), (1, "z" * 30_000), (1, "z" * 30_000), (2, "z" * 30_001), (2, "z" * 30_001), (2, "z" * 30_001)] + [(3, "hello hallo world")] * 500 + [(4, "hellp")] * 3
    got = spelled(documents(*docs))
    n = collections.Counter(len(w) for w in got)
    assert n[30_000] == n[30_001] == 1 and got["z" * 30_001][3] == got["z" * 30_000][3] == 1
    assert got["hellp"] == ("hello", "hello", 3, 1, 500) and got["hallo"][:4] == (None, "hallo", 500, 1)


def plain_phrases(docs, least=10, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        some = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in some.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in some.items()):
                continue
            score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, r[2].decode(), -r[1], r[3], r[4], n[lang], -r[0]) for i, r in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def mined(df, **given):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(df, **given).collect())


@pytest.fixture
def prose():
    rng = np.random.default_rng(8)
    words = [*"abcdefgh", "The", "été", "end", "x" * 300]
    marks = [" "] * 12 + ["  ", ", ", ".", "\n", "\t", "\x0b"]
    return [(str(rng.choice(["en", "de", None])) if rng.random() < 0.9 else None, "".join(w + m for w, m in zip(rng.choice(words, 80), rng.choice(marks, 80), strict=True))) for _ in range(60)]


def test_phrases_against_plain(spark, prose, monkeypatch):
    df = spark.createDataFrame(prose, "lang string, text string")
    want = plain_phrases(prose)
    assert mined(df) == want and len(want) > 100
    assert mined(df, top=7) == [r for r in want if r[1] <= 7]
    # A bitmap of very few bits lets rare phrases through, which exact counting drops; digests of all words give the same.
    monkeypatch.setattr(phrases, "LEAST_BITS", 4)
    monkeypatch.setattr(phrases, "MOST_BITS", 4)
    assert mined(df) == want
    monkeypatch.undo()
    monkeypatch.setattr(phrases, "_words_met", lambda found: True)
    assert mined(df) == want


def test_phrases_awkward(spark, awkward, none):
    rows = [(r.lang, r.text) for r in awkward.collect()]
    assert mined(awkward) == plain_phrases(rows)
    assert mined(none) == []
    often = spark.createDataFrame([(None, "Once upon a time. Once upon"), ("und", None), ("x", "")], "lang string, text string")
    often = often.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(20_000))))
    assert mined(often) == plain_phrases([(None, "Once upon a time. Once upon")] * 20_000)


def test_bucket_counts_in_a_tree(spark):
    rng = np.random.default_rng(4)
    pieces, total = [], collections.Counter()
    for piece in range(30):
        places = rng.integers(0, 1 << 16, 4000).astype(np.uint64)
        total.update(places.tolist())
        pieces.append(phrases._bucketed(places << np.uint64(48), 16, piece).to_pylist())
    df = spark.createDataFrame([(r["piece"], r["part"], bytes(r["counts"])) for rows in pieces for r in rows], "piece long, part int, counts binary")
    bitmap = np.frombuffer(phrases.bucket_bitmap(df, 16, at_once=4), np.uint8)
    got = np.flatnonzero(np.unpackbits(bitmap, bitorder="little"))
    assert got.tolist() == sorted(k for k, n in total.items() if n >= phrases.LEAST)

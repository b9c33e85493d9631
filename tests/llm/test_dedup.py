import collections
import hashlib
import random
import re

import numpy as np
import pytest

from cellarium.llm import embedding_dedup, exact_dedup, minhash
from cellarium.llm import shingles as S
from cellarium.llm.components import components


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def multiset(text):
    w = words(text)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def jaccard(a, b):
    common = sum(min(v, b[k]) for k, v in a.items() if k in b)
    return common / (sum(a.values()) + sum(b.values()) - common) if common else 0.0


def classes(n, links):
    root = {i: i for i in n}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in n}


def test_exact_dedup_against_texts(documents):
    random.seed(3)
    texts = ["".join(random.choice("ab. \n\t") for _ in range(random.choice((3, 400, 900)))) for _ in range(60)]
    texts += [t.replace(" ", "\t\n") for t in texts[:20]] + [texts[5] + "x", texts[5][:-1]]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(documents(*texts)).collect()}
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t) for i, t in enumerate(texts, 1)}
    for i, t in norm.items():
        same = [j for j, u in norm.items() if u == t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (min(same), len(same), i == min(same))
        assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_exact_dedup_awkward(awkward, none):
    rows = exact_dedup.exact_dedup(awkward).collect()
    assert len(rows) == 12
    by = {r.doc_id: r for r in rows}
    assert by[2].keep_id == 1 and by[1].group_size == 2 and by[3].group_size == 1  # white space is one space, not nothing
    assert by[5].keep_id == 4 and by[4].group_size == 3 and by[None].kept
    assert exact_dedup.exact_dedup(none).count() == 0


def test_chunks_make_up_the_text_and_resist_an_edit(spark):
    from pyspark.sql import functions as F

    random.seed(5)
    text = " ".join(random.choice(("alpha", "beta.", "gamma", "delta!")) for _ in range(2000))
    a, b = (spark.createDataFrame([(t,)], "t string").select(exact_dedup.chunks(F.col("t"))).first()[0] for t in (text, "new " + text))
    assert "".join(a) == text and len(set(a) - set(b)) < 4


@pytest.mark.parametrize("recipe_collides", [False, True])
def test_exact_dedup_survives_colliding_identifiers(documents, monkeypatch, recipe_collides):
    """Texts whose identifiers stand for two chunks are compared themselves, and results stay whole."""
    from pyspark.sql import functions as F

    real = exact_dedup.collisions
    if recipe_collides:  # all chunks of one length have the same identifier
        monkeypatch.setattr(exact_dedup, "identified", lambda text: F.transform(exact_dedup.chunks(text), lambda c: F.unhex(F.md5(F.length(c).cast("string")))))
    else:
        monkeypatch.setattr(exact_dedup, "collisions", lambda docs, keys: real(docs, keys).union(docs.sparkSession.range(1).select(F.unhex(F.md5(F.lit("a"))))))
    rows = exact_dedup.exact_dedup(documents("a", "a", "b", "b", "b", "c", "dd", "a ", (None, "b"))).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows} == {(1, 1, 2, True), (2, 1, 2, False), (3, 3, 4, True), (4, 3, 4, False), (5, 3, 4, False), (6, 6, 1, True), (7, 7, 1, True), (8, 8, 1, True), (None, 3, 4, False)}


def near_texts():
    random.seed(11)
    vocabulary = ["".join(random.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    texts = []
    for _ in range(12):
        base = [random.choice(vocabulary) for _ in range(random.choice((8, 60, 300)))]
        for edits in (0, 1, 1, 3, 6, 12):
            t = list(base)
            for _ in range(edits):
                t[random.randrange(len(t))] = random.choice(vocabulary)
            texts.append(" ".join(t))
    return texts


@pytest.mark.parametrize("paired", [64, 1])
def test_near_duplicates_against_all_pairs(documents, monkeypatch, paired):
    """Both ways of comparing mixed buckets: pair by pair, and in blocks."""
    monkeypatch.setattr(minhash, "PAIRED", paired)
    texts = near_texts()
    sets = {i: multiset(t) for i, t in enumerate(texts, 1)}
    links = [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(documents(*texts)).collect()}
    assert got == classes(sets, links) and len(links) > 20


def test_near_duplicates_awkward(awkward, none):
    rows = minhash.near_duplicates(awkward).collect()
    assert len(rows) == 12
    by = {r.doc_id: r.class_id for r in rows}
    assert by[1] == 1 and by[2] == 2 and by[3] == 3 and by[5] == 4 and by[7] == 6 and by[None] is None
    assert minhash.near_duplicates(none).count() == 0


def test_dart_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    values = S.mix(np.arange(300, dtype=np.uint64))
    a, b = rng.integers(0, 6, 300) * 0.5, rng.integers(0, 6, 300) * 0.5
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    row = np.repeat([0, 1], 300)
    weight = np.concatenate((a, b))
    use = weight > 0
    out = minhash.dart_minhash(2, row[use], np.tile(values, 2)[use], weight[use], 4000)
    assert np.isfinite(out).all() and abs((out[0] == out[1]).mean() - true) < 0.04


def test_hashes_do_not_depend_on_the_batch():
    import pyarrow as pa

    texts = ["The quick  brown fox", "", None, "jumps over\tthe lazy dog " * 50]
    whole = [S.words(d, r) for _, d, r in S.blocks(pa.array(texts))][0]
    for i, t in enumerate(texts):
        one = [S.words(d, r) for _, d, r in S.blocks(pa.array([t]))][0][0]
        assert np.array_equal(one, whole[0][whole[1][i] : whole[1][i + 1]])
        assert len(one) == len(words(t))


def test_components(spark):
    random.seed(2)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {k: v for k, v in classes({x for p in links for x in p}, links).items() if k != v}
    assert got == want


def test_embeddings_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(15, 8))
    vectors = [[float(x) for x in base[i % 15] * (1 + i % 3) + rng.normal(size=8) * 0.25 * (i % 4)] for i in range(90)]
    vectors += [vectors[3], vectors[3], None, [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [1.0, 2.0], [2.0, 4.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    good = {i: np.array(v) for i, v in enumerate(vectors) if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    links = [(a, b) for a in good for b in good if a != b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= 0.9]
    want, degree = classes(range(len(vectors)), links), collections.Counter(a for a, _ in links)
    for r in embedding_dedup.embedding_duplicates(df).collect():
        assert (r.n_links, r.component_id, r.kept) == (degree[r.vec_id], want[r.vec_id], want[r.vec_id] == r.vec_id)
    assert embedding_dedup.embedding_duplicates(df.limit(0)).count() == 0


def test_embeddings_with_repeated_and_null_ids(spark, monkeypatch):
    """Rows are linked by what they hold: an id on two vectors doesn't mix their links, and rows without an id count."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(embedding_dedup, "BLOCK", 2)
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.05]), (None, [0.05, 1.0]), (None, [-1.0, 0.01]), (None, [-1.0, 0.02]), (7, [0.1, 0.1]), (7, [0.1, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("key", "rep", "copies", "root", "n", "block")})
    found = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embedding_dedup.embedding_duplicates(df).collect())
    want = [("1", 1, "1", True), ("1", 1, "1", True), ("2", 1, "1", False), ("None", 1, "1", False), ("None", 1, "None", True), ("None", 1, "None", True), ("7", 1, "7", True), ("7", 1, "7", True)]
    assert found == sorted(want)

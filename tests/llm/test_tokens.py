import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from cellarium.llm import bpe, mixcoder, packing, token_files


@pytest.fixture(scope="module")
def vocab():
    return bpe.vocabulary(bpe.default_path())


TEXTS = ["a'b  c   d 's x's", "  \n\n lead", "x" * 3000, "no<|endoftext|> y <|endoftext|>z  w", "日本語 テキスト é ñ 'll", "1234 567,89 !!'s ''t ok", "a \n b\n\n c", "", " "]


def ids_of(vocab, text):
    return vocab.plain.encode(text or "", add_special_tokens=False).ids


def test_joined_pieces_are_the_whole(vocab):
    random.seed(1)
    for t in TEXTS:
        want = ids_of(vocab, t)
        assert vocab.encode(t).tolist() == want
        for _ in range(20):
            k = sorted(random.sample(range(len(t) + 1), min(len(t) + 1, random.choice((1, 3, 9)))))
            assert vocab.joined([vocab.encode(t[a:b]) for a, b in zip([0, *k], [*k, len(t)], strict=True)]).tolist() == want


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_encoding_with_shared_chunks(documents, vocab, monkeypatch, broadcast):
    """Digests of shared chunks are broadcast, or joined by shuffle."""
    monkeypatch.setattr(bpe, "SHARED", broadcast)
    monkeypatch.setattr(bpe, "MEAN", 64)
    monkeypatch.setattr(bpe, "LEAST", 16)
    random.seed(2)
    shared = " ".join(random.choice(("alpha", "Beta's", "42", "délta", "--")) for _ in range(400))
    texts = [*TEXTS, shared, "intro " + shared, shared[:900] + " other end", "x" + shared[100:] + "y" * 50, shared, None]
    rows = bpe.encode_chunked(documents(*texts), bpe.default_path()).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = ids_of(vocab, texts[r.doc_id - 1])
        decoded = vocab.plain.decode(want, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def _encoded(vocab, text):
    want = ids_of(vocab, text)
    decoded = vocab.plain.decode(want, skip_special_tokens=False)
    return len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_encoding_awkward(awkward, none, vocab):
    rows = bpe.encode_chunked(awkward, bpe.default_path()).collect()
    want = [(r.doc_id, *_encoded(vocab, r.text)) for r in awkward.select("doc_id", "text").collect()]
    assert sorted(map(repr, (tuple(r) for r in rows))) == sorted(map(repr, want)) and len(rows) == 12
    assert bpe.encode_chunked(none, bpe.default_path()).count() == 0


def test_encoding_of_a_row_that_repeats_very_often(spark, vocab):
    """One row is 100,000 rows; it is put together once. The same text under other ids, and without an id, is apart."""
    text = " ".join(f"word{i % 97} tail{i % 31}" for i in range(60))
    ids = spark.range(100_000, numPartitions=4).selectExpr("7L AS doc_id").union(spark.sql("SELECT * FROM VALUES (8L), (9L), (NULL), (NULL)"))
    docs = ids.withColumn("text", F.lit(text)).union(spark.sql("SELECT 7L, 'another text'"))
    rows = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256): r["count"] for r in bpe.encode_chunked(docs, bpe.default_path()).groupBy("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").count().collect()}
    found = _encoded(vocab, text)
    assert rows == {(7, *found): 100_000, (8, *found): 1, (9, *found): 1, (None, *found): 2, (7, *_encoded(vocab, "another text")): 1}


def test_other_kinds_of_vocabularies_are_refused(tmp_path):
    import json

    with open(bpe.default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}):
        (tmp_path / "v.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match="only"):
            bpe.Vocabulary(str(tmp_path / "v.json"))


def test_coder_round_trip():
    rng = np.random.default_rng(0)
    blocks = [rng.integers(0, 50257, rng.integers(0, 200)).astype(np.uint32) for _ in range(50)]
    blocks += [np.zeros(5000, np.uint32), np.zeros(0, np.uint32), np.full(300, 65535, np.uint32), np.tile([5, 6, 7], 900).astype(np.uint32)]
    coded = mixcoder.encode(blocks)
    for a, b in zip(blocks, mixcoder.decode(coded, np.array([len(b) for b in blocks])), strict=True):
        assert np.array_equal(a, b)
    assert len(coded[50]) < 1000 and len(coded[53]) < 1500  # repetition is nearly free
    assert mixcoder.encode([]) == [] and mixcoder.decode([], np.zeros(0, np.int64)) == []


def test_token_files(spark, documents, awkward, none, vocab, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 64)
    monkeypatch.setattr(token_files, "FILE_BYTES", 4000)
    texts = [*TEXTS, "some words here " * 100, None]
    token_files.write(documents(*texts), f"{tmp_path}/a", bpe.default_path())
    at = 0
    for r in sorted(token_files.read(spark, f"{tmp_path}/a").collect()):
        want = [*ids_of(vocab, texts[r.doc_id - 1]), 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)
    token_files.write(awkward, f"{tmp_path}/b", bpe.default_path())
    coded = lambda t: [*ids_of(vocab, t), 2]
    want = sorted((r.doc_id or 0, len(coded(r.text)), zlib.crc32(np.array(coded(r.text), "<u4").tobytes())) for r in awkward.select("doc_id", "text").collect())
    found = token_files.read(spark, f"{tmp_path}/b").collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in found) == want and len(found) == 12
    found = sorted(found, key=lambda r: r.start)
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found[:-1])]).tolist() and [r.doc_id or 0 for r in found] == [w[0] for w in want]
    token_files.write(none, f"{tmp_path}/c", bpe.default_path())
    assert token_files.read(spark, f"{tmp_path}/c").count() == 0


def test_a_damaged_block_is_noticed(spark, documents, tmp_path):
    from pyspark.sql import functions as F

    token_files.write(documents("one two three"), f"{tmp_path}/a", bpe.default_path())
    spark.read.parquet(f"{tmp_path}/a").withColumn("coded", F.unhex(F.lit("00FF"))).write.parquet(f"{tmp_path}/b")
    with pytest.raises(Exception, match="damaged"):
        token_files.read(spark, f"{tmp_path}/b").collect()


def check_pieces(rows, want):
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for doc_id, ids in want.items():
        at = 0
        for r in sorted(by[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return sequences


def topical(n, seed):
    random.seed(seed)
    topics = [["sun", "moon", "star"], ["iron", "zinc", "gold"], ["oak", "elm", "ash"]]
    return [" ".join(random.choice(topics[i % 3]) for _ in range(random.choice((5, 80, 700)))) for i in range(n)]


@pytest.mark.parametrize("seeds", [20, 1000])
def test_packing(documents, vocab, monkeypatch, seeds):
    """Every id in one piece and no padding, with many tasks, also without any seed."""
    monkeypatch.setattr(packing, "SHARD_IDS", 3000)
    monkeypatch.setattr(packing, "SEEDS", seeds)
    texts = [*topical(60, 7), None, ""]
    rows = packing.pack(documents(*texts), bpe.default_path()).collect()
    sequences = check_pieces(rows, {i: [*ids_of(vocab, t), 0] for i, t in enumerate(texts, 1)})
    sizes = [sum(r.length for r in s) for s in sequences.values()]
    assert all(s & (s - 1) == 0 for s in sizes)  # no padding
    assert len({s >> 32 for s in sequences}) > 3


def bm25(docs):
    """score(seed, doc) from the formula, term by term; documents are lists of ids."""
    import math

    sets = [set(d) for d in docs]
    terms = set().union(*sets)
    idf = {t: math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) for t in terms for n in [sum(t in s for s in sets)]}
    mean = sum(map(len, docs)) / len(docs)

    def score(seed, doc):
        bound = packing.K1 * (1 - packing.B + packing.B * len(docs[doc]) / mean)
        return sum(idf[t] * tf * (packing.K1 + 1) / (tf + bound) for t in sets[seed] & sets[doc] for tf in [docs[doc].count(t)])

    return score


@pytest.mark.parametrize(("index_terms", "dense"), [(2_000_000, 1 / 32), (40, 0.3), (40, 2), (2_000_000, -1)])
def test_neighbours_from_the_whole_corpus(documents, vocab, monkeypatch, index_terms, dense):
    """With one shard or many, with postings, a matrix or both: each document is in the list of the seed that brute force
    says, so each seed's ten best documents are its own or are another seed's by a score that is no smaller."""
    monkeypatch.setattr(packing, "INDEX_TERMS", index_terms)
    monkeypatch.setattr(packing, "BLOCK_TERMS", 200)
    monkeypatch.setattr(packing, "STEP", 3)
    monkeypatch.setattr(packing, "DENSE", dense)
    monkeypatch.setattr(packing, "SEEDS", 5)
    random.seed(12)
    words = [f"w{i}x" for i in range(60)]
    texts = [" ".join(random.choice(words[20 * (i % 3) :]) for _ in range(random.choice((3, 30, 90)))) for i in range(118)] + [None, ""]
    rows = packing.encoded(documents(*texts), bpe.default_path())
    found = packing.searched(rows, packing.Ranking(*packing.document_frequencies(rows))).collect()
    number = {r.row: r.doc_id for r in rows.collect()}
    docs = [[]] + [[*ids_of(vocab, t), 0] for t in texts]
    score = bm25(docs[1:])
    seeds = range(5, 121, 5)
    scaled = {(s, d): score(s - 1, d - 1) / score(s - 1, s - 1) ** 0.5 for s in seeds for d in range(1, 121) if d % 5}
    assert sorted(number[r.row] for r in found) == [d for d in range(1, 121) if d % 5]
    of = {number[r.row]: number[r.seed] for r in found}
    for r in found:
        d = number[r.row]
        best = max(scaled[s, d] for s in seeds)
        assert abs(r.score - best) < 1e-4 * best and scaled[of[d], d] > best * (1 - 1e-5)
    for s in seeds:
        for d in sorted((d for d in range(1, 121) if d % 5), key=lambda d: -score(s - 1, d - 1))[:10]:
            assert of[d] == s or scaled[of[d], d] >= scaled[s, d] * (1 - 1e-5)


def test_index_comes_in_small_pieces(monkeypatch):
    """No row holds a whole shard, and the pieces hold all of its seeds and terms."""
    monkeypatch.setattr(packing, "PIECE_TERMS", 40)
    monkeypatch.setattr(packing, "STEP", 3)
    lists = [np.arange(i % 7, 12 * (i % 7) + 1, dtype="<u4") for i in range(20)]
    ones = [np.ones(len(t), "<u4").tobytes() for t in lists]
    group = pa.table({"doc_id": range(20, 0, -1), "row": range(20), "n": [len(t) for t in lists], "terms": [t.tobytes() for t in lists], "times": ones, "shard": [0] * 20})
    ranking = packing.Ranking(np.bincount(np.concatenate(lists)), 20, sum(map(len, lists)))
    seeds, held = [], 0
    for row in packing._pieces(ranking)(group).to_pylist():
        piece = packing.Piece(ranking, **row)
        assert len(piece.seeds) == 1 or len(piece.seeds) <= 3 and np.frombuffer(row["sizes"], "<i4").sum() <= 40
        seeds += piece.keys.tolist()
        held += np.count_nonzero(piece.matrix) + len(piece.seed)
    assert seeds == list(range(1, 21)) and held == sum(map(len, lists))


def test_equal_scores_go_to_the_first_seed(documents, monkeypatch):
    monkeypatch.setattr(packing, "INDEX_SEEDS", 1)
    monkeypatch.setattr(packing, "SEEDS", 10)
    rows = packing.encoded(documents(*[(i, "the same words") for i in range(50, 0, -1)]), bpe.default_path())
    found = packing.searched(rows, packing.Ranking(*packing.document_frequencies(rows))).collect()
    first = {r.row for r in rows.collect() if r.doc_id == 10}
    assert len(found) == 45 and {r.seed for r in found} == first


def test_windows_go_down_the_whole_list():
    # 30 neighbours are too long for the room left; then short ones fit, and fill it.
    size = np.array([1000] + [501 + i for i in range(30)] + [2] * 12)
    found = list(packing.windows(size))
    assert sum(n for _, _, n in found[0]) == 1024 and {d for d, _, _ in found[0]} == {0, *range(31, 43)}
    # The best one that was passed over begins the next window; where nothing fits, it is cut to fit.
    assert found[1] == [(1, 0, 501), (2, 0, 502), (3, 0, 21)] and found[2][0] == (3, 21, 482)
    held = {}
    for d, start, n in (p for w in found for p in w):
        assert start == held.get(d, 0)
        held[d] = start + n
    assert held == dict(enumerate(size.tolist()))
    assert all(sum(n for _, _, n in w) == 1024 for w in found[:-1])


def test_windows_of_every_shape():
    random.seed(5)
    for _ in range(300):
        size = np.array([random.choice((1, 2, 100, 1023, 1024, 1025, 5000)) for _ in range(random.randrange(0, 12))], np.int64)
        room = random.choice((1, 7, 1024))
        found = list(packing.windows(size, room))
        sums = [sum(n for _, _, n in w) for w in found]
        assert sum(sums) == size.sum() and (not sums or sums[0] == min(room, size.sum())) and all(s == 1024 for s in sums[1:-1])
        held = {}
        for d, start, n in (p for w in found for p in w):
            assert n > 0 and start == held.get(d, 0)
            held[d] = start + n
        assert held == dict(enumerate(size.tolist()))


def test_packing_awkward(awkward, none, vocab):
    rows = packing.pack(awkward, bpe.default_path()).collect()
    texts = {r.doc_id: r.text for r in awkward.filter("doc_id IS NOT NULL AND doc_id <> 5").collect()}
    for doc_id, text in texts.items():
        ids, at = [*ids_of(vocab, text), 0], 0
        for r in sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert sum(r.length for r in rows if r.doc_id == 5) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 5) and any(r.doc_id is None for r in rows)
    assert packing.pack(none, bpe.default_path()).count() == 0


def test_white_space_beside_white_space_is_split_as_by_the_library(monkeypatch):
    """The pattern without lookahead serves where no white space follows white space, and only there."""
    vocab, looked = bpe.Vocabulary(bpe.default_path()), []
    fast = vocab.fast

    class Seen:
        def encode_to_numpy(self, text, **how):
            looked.append(text)
            return fast.encode_to_numpy(text, **how)

    monkeypatch.setattr(vocab, "fast", Seen())
    plain = ["one two\nthree 4,5 don't é ’x’ «y» ÿ", "<|endoftext|>a <|endoftext|>", "", " ", "\n", " a ", "a　b"]
    double = ["a  b", "a\n\nb", "a \nb", "a\n b", "a　　b", "a 　b", "a  b", "  x", "a\x85\x85b", "é\t\tb", "a  b"]
    for text in plain + double:
        assert vocab.encode(text).tolist() == vocab.plain.encode(text, add_special_tokens=False).ids, repr(text)
    assert looked == double
    assert vocab.encode("x" + " " * 3000 + "y").tolist() == vocab.plain.encode("x" + " " * 3000 + "y", add_special_tokens=False).ids


@pytest.mark.parametrize("most", [200, 50_000, 1 << 20])
def test_ids_are_packed_by_their_width(most):
    ids = np.random.default_rng(most).integers(0, most, 500).astype(np.uint32)
    data = packing._packed(ids, zstandard.ZstdCompressor(level=1))
    assert packing._unpacked(data, len(ids), zstandard.ZstdDecompressor()) == ids.astype("<u4").tobytes()
    assert len(zstandard.ZstdDecompressor().decompress(data)) == len(ids) * (4 if most > 1 << 16 else 2)


def test_white_space_beside_white_space_is_found():
    texts = ["", " ", "\n", " a ", "a b\nc", "é ü ÿ", "a　b", "a\xa0b", "　", "\xa0a\xa0"]
    double = ["  ", "a  b", "a\n b", "a\t\tb ", " \n", "a　　b", "é\xa0 b", "a  ", "\x85\x85"]
    assert [bpe.doubled(t) for t in texts + double] == [False] * len(texts) + [True] * len(double)


def test_an_id_takes_one_digit_at_most():
    """The least likely stretch still leaves a span that one digit fills up."""
    assert mixcoder.FULL == 1 << 2 * mixcoder.DIGIT and mixcoder.TOP - mixcoder.WHOLE + mixcoder.DIGIT >= mixcoder.TOP
    rng = np.random.default_rng(3)
    blocks = [np.tile([7, 8], 1500).astype(np.uint32), rng.permutation(65536)[:4096].astype(np.uint32), np.concatenate((np.zeros(2500, np.uint32), rng.integers(0, 3, 600).astype(np.uint32)))]
    coded = mixcoder.encode(blocks)
    for a, b in zip(blocks, mixcoder.decode(coded, np.array([len(b) for b in blocks])), strict=True):
        assert np.array_equal(a, b)


def test_last_blocks_are_coded_together(monkeypatch):
    import pyarrow as pa

    sizes = [token_files.LANES, 100, 5, token_files.LANES, token_files.LANES, 1]
    batches = [pa.record_batch({"n": list(range(n))}) for n in sizes]
    found = list(token_files._together(iter(batches)))
    assert [b.num_rows for b in found] == [token_files.LANES + 105, token_files.LANES, token_files.LANES + 1]
    assert sum((b.column(0).to_pylist() for b in found), []) == sum((b.column(0).to_pylist() for b in batches), [])

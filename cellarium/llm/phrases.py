"""Phrase collocations by PCY/DHP hashing: exact counts of words, pairs and triples, each pass also hashing the next longer ones.

The pass that counts phrases of k words exactly also counts into BUCKETS hash buckets the phrases of k + 1 words whose parts
of k words may be frequent. Buckets with fewer than LEAST occurrences hold no frequent phrase, and the bitmap of the others
is broadcast (a bit for each bucket, MOST_BITS at most, whatever the corpus); the next pass counts only phrases whose bucket
is in it and whose two parts are in the bitmap of frequent phrases of k words (Apriori). Bitmaps let some rare phrases
through and no frequent one fall, and what comes through is counted exactly, so results don't depend on their size.

Words are 64-bit keys of language and word while counting; the pass over words holds each key against its words, and takes
other keys if two of them ever meet. Everything is pre-aggregated in arrays of a few million words and again by Spark
before each shuffle, so a very frequent phrase is one row for each task.

Defined cases: null text counts as empty; a null lang is `und`; repeated rows count each; languages with fewer phrases than
asked for give all they have; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellarium.llm import shingles as S
from cellarium.llm.common import bounded_batches, shared_dir, table, written

LEAST, LONGEST, TOP = 10, 3, 2000
#: A phrase is dropped for a longer one that has at least this share of its occurrences, in hundredths.
SHARE = 50
SCALE = 1_000_000
BLOCK, WORDS_AT_ONCE = 1_000_000, 1_000_000
#: Bits of the smallest and the largest bitmap, and buckets that one task adds up.
LEAST_BITS, MOST_BITS, RANGE_BITS = 20, 30, 22

_SPLIT = np.zeros(256, dtype=bool)
_SPLIT[[32, 9, 10, 11, 12, 13, *b".,;:!?"]] = True
_BREAK = _SPLIT.copy()
_BREAK[[32, 9]] = False


def words(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte, end, row, and whether the next word belongs to the same piece, of each word of the rows."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none.astype(np.uint64), none, none, none, none.astype(bool)
    inner = ~_SPLIT[data]
    begins, stops = inner.copy(), inner.copy()
    begins[1:] &= ~inner[:-1]
    stops[:-1] &= ~inner[1:]
    edge = rows[(rows > 0) & (rows < len(data))]  # a word ends with its row
    begins[edge], stops[edge - 1] = inner[edge], inner[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    up, down = S.powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((S.LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    hashes = S.mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    row = np.searchsorted(rows, start, side="right") - 1
    piece = np.cumsum(_BREAK[data], dtype=np.int64)[start]
    joined = np.zeros(len(start), dtype=bool)
    joined[:-1] = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
    return hashes, start, end, row, joined


def phrase_key(parts: list[np.ndarray]) -> np.ndarray:
    out = parts[0]
    for p in parts[1:]:
        out = S.mix(out * S.BASE + np.uint64(1)) ^ p
    return S.mix(out) if len(parts) > 1 else out


def _long_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, longer: int) -> np.ndarray:
    """hashes, with a digest instead for words of more than so many bytes, as polynomials of long texts can be made to meet."""
    for i in np.flatnonzero(end - start > longer):
        hashes[i] = int.from_bytes(hashlib.blake2b(S.LOWER[data[start[i] : end[i]]].tobytes(), digest_size=8).digest(), "little")
    return hashes


class Stretch:
    """Some million words of texts: their keys, which of them join the next one, and the distinct words themselves."""

    def __init__(self) -> None:
        self.keys, self.joined, self.found = [], [], []
        self.size = 0

    def add(self, texts: pa.Array, langs: list[str], longer: int, spell: bool) -> None:
        names = sorted(set(langs))
        salt = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names}
        salts, index = np.array([salt[x] for x in langs], np.uint64), np.array([names.index(x) for x in langs], np.int64)
        for first, data, rows in S.blocks(texts, BLOCK):
            hashes, start, end, row, joined = words(data, rows)
            hashes = _long_words(data, start, end, hashes, longer)
            row += first
            keys = S.mix(hashes ^ salts[row]) if len(row) else hashes
            self.keys.append(keys)
            self.joined.append(joined)
            self.size += len(keys)
            if spell and len(keys):
                some, at, n = np.unique(keys, return_index=True, return_counts=True)
                ends = np.concatenate(([0], np.cumsum(end[at] - start[at])))
                byte = np.repeat(start[at] - ends[:-1], np.diff(ends)) + np.arange(ends[-1])
                spelled = pa.LargeStringArray.from_buffers(len(some), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(S.LOWER[data[byte]]))
                lang = pa.array(names, pa.string()).take(pa.array(index[row[at]]))
                self.found.append((some, n, spelled.cast(pa.string()), lang))

    def phrases(self, k: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The keys of the words of each phrase of k words, and where it begins."""
        keys, joined = np.concatenate(self.keys), np.concatenate(self.joined)
        whole = np.ones(max(len(keys) - k + 1, 0), dtype=bool)
        for j in range(k - 1):
            whole &= joined[j : j + len(whole)]
        at = np.flatnonzero(whole)
        return [keys[at + j] for j in range(k)], at


def has(bitmap: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    at = keys >> np.uint64(64 - bits)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


PASS = "a long, b long, c long, lang string, word string, n long, piece long, part int, counts binary"
PASS_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("piece", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])


def _batch(rows: int, **columns: object) -> pa.RecordBatch:
    """rows of PASS; columns that aren't given are null."""
    filled = [pa.nulls(rows, f.type) if (x := columns.get(f.name)) is None else x if isinstance(x, pa.Array) else pa.array(x, f.type) for f in PASS_ARROW]
    return pa.RecordBatch.from_arrays(filled, schema=PASS_ARROW)


def _packed(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted places in a range and their counts, LEAST at most, as byte planes."""
    step = np.diff(places, prepend=0).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(step.view(np.uint8).reshape(-1, 4).T.tobytes() + np.minimum(counts, LEAST).astype(np.uint8).tobytes())


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(5, -1)
    return np.cumsum(np.ascontiguousarray(planes[:4].T).view("<u4").ravel(), dtype=np.int64), planes[4]


def _bucketed(keys: np.ndarray, bits: int, piece: int) -> pa.RecordBatch:
    places, n = np.unique(keys >> np.uint64(64 - bits), return_counts=True)
    part = (places >> np.uint64(RANGE_BITS)).astype(np.int64)
    some, at = np.unique(part, return_index=True)
    ends = np.append(at, len(part))[1:]
    offset = (places & np.uint64((1 << RANGE_BITS) - 1)).astype(np.int64)
    return _batch(len(some), piece=np.full(len(some), piece), part=some, counts=[_packed(offset[i:j], n[i:j]) for i, j in zip(at, ends, strict=True)])


def _counter(k: int, bits: int, longer: int, good: list[Broadcast]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pass k. good: for each length below k the bitmap of frequent phrases, then the bitmap of buckets for length k."""

    def flush(stretch: Stretch, piece: int) -> Iterator[pa.RecordBatch]:
        if not stretch.size:
            return
        maps = [np.frombuffer(g.value, np.uint8) for g in good]
        parts, at = stretch.phrases(k)
        if k == 1:
            keys = np.concatenate([f[0] for f in stretch.found])
            some, first, place = np.unique(keys, return_index=True, return_inverse=True)
            n = np.bincount(place, weights=np.concatenate([f[1] for f in stretch.found])).astype(np.int64)
            word, lang = (pa.concat_arrays([f[i] for f in stretch.found]).take(pa.array(first)) for i in (2, 3))
            yield _batch(len(some), a=some.view(np.int64), lang=lang, word=word, n=n)
        else:
            fine = has(maps[-1], bits, phrase_key(parts))
            for j in (0, 1):
                fine &= has(maps[k - 2], bits, phrase_key(parts[j : j + k - 1]))
            parts, at = [p[fine] for p in parts], at[fine]
            some, first, n = np.unique(phrase_key(parts), return_index=True, return_counts=True)
            yield _batch(len(some), n=n, **{c: p[first].view(np.int64) for c, p in zip("abc", parts, strict=False)})
        if k < LONGEST:
            more, begin = stretch.phrases(k + 1)
            if k > 1:
                passed = np.zeros(stretch.size + 1, dtype=bool)
                passed[at] = True
                both = passed[begin] & passed[begin + 1]
                more = [p[both] for p in more]
            if len(more[0]):
                yield _bucketed(phrase_key(more), bits, piece)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        stretch = Stretch()
        for batch in batches:
            # A batch is some MB of text, or one long text.
            stretch.add(batch.column("text"), batch.column("lang").to_pylist(), longer, k == 1)
            if stretch.size >= WORDS_AT_ONCE:
                yield from flush(stretch, task)
                stretch, task = Stretch(), task + 1
        yield from flush(stretch, task)

    return run


def _added(group: pa.Table) -> tuple[int, np.ndarray]:
    total = np.zeros(1 << RANGE_BITS, np.uint8)
    for data in group.column("counts").to_pylist():
        at, n = _unpacked(data)
        total[at] = np.minimum(total[at] + n, LEAST)
    return group.column("part")[0].as_py(), total


def _merge(group: pa.Table) -> pa.Table:
    part, total = _added(group)
    at = np.flatnonzero(total)
    return pa.table({"part": pa.array([part], pa.int32()), "piece": pa.array([min(group.column("piece").to_pylist())], pa.int64()), "counts": pa.array([_packed(at, total[at])], pa.binary())})


def _frequent_buckets(group: pa.Table) -> pa.Table:
    part, total = _added(group)
    return pa.table({"part": pa.array([part], pa.int32()), "bitmap": pa.array([np.packbits(total >= LEAST, bitorder="little").tobytes()], pa.binary())})


def bucket_bitmap(counts: DataFrame, bits: int, at_once: int = 128) -> bytes:
    """A bit for each bucket that has LEAST occurrences; counts(piece, part, counts) are added up in a tree of tasks."""
    counts = counts.select("part", "piece", "counts")
    while (most := counts.groupBy("part").count().agg(F.max("count")).first()[0] or 0) > at_once:
        group = F.pmod(F.xxhash64("piece"), F.lit(-(-most // (at_once // 2))))
        counts = written(counts.groupBy("part", group.alias("of")).applyInArrow(_merge, "part int, piece long, counts binary"), "bucket-counts")
    out = bytearray(1 << (bits - 3))
    size = 1 << (min(bits, RANGE_BITS) - 3)
    for r in counts.groupBy("part").applyInArrow(_frequent_buckets, "part int, bitmap binary").toLocalIterator():
        out[r.part * size : (r.part + 1) * size] = r.bitmap[:size]
    return bytes(out)


def phrase_bitmap(found: DataFrame, parts: list[str], bits: int) -> bytes:
    """A bit for each bucket with a phrase of found, whose words' keys are in the columns parts."""
    at = found.select(_place(parts, bits).alias("x"))
    rows = at.groupBy(F.bitmap_bucket_number("x").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bitmap"))
    out = bytearray(1 << (bits - 3))
    for r in rows.toLocalIterator():
        out[(r.k - 1) * 4096 : r.k * 4096] = r.bitmap
    return bytes(out)


def _place(parts: list[str], bits: int) -> Column:
    """The place (from 1) of the bit of a phrase."""

    @F.arrow_udf("long")
    def place(*columns: pa.Array) -> pa.Array:
        keys = phrase_key([c.to_numpy(zero_copy_only=False).view(np.uint64) for c in columns])
        return pa.array((keys >> np.uint64(64 - bits)).astype(np.int64) + 1)

    return place(*(F.col(p) for p in parts))


def _words_met(words_found: DataFrame) -> bool:
    """Whether a key belongs to two words."""
    return words_found.groupBy("a").count().filter("count > 1").limit(1).count() > 0


def counted(docs: DataFrame, longer: int = 256) -> tuple[DataFrame, list[DataFrame]]:
    """words(a, lang, word, n) of all words, and for each longer length the phrases (a, b, ..., n) with LEAST occurrences."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max((size // 4).bit_length(), LEAST_BITS), MOST_BITS)
    one = written(texts.mapInArrow(_counter(1, bits, longer, []), PASS), "pass-1")
    found = written(one.filter("part IS NULL").groupBy("a", "lang", "word").agg(F.sum("n").alias("n")), "words")
    if longer and _words_met(found):
        return counted(docs, 0)  # keys of the digests of all words
    good, out, last = [], [], one
    kept, share = found.filter(F.col("n") >= LEAST), spark.sparkContext.broadcast
    for k in range(2, LONGEST + 1):
        good.append(share(phrase_bitmap(kept, list("abc"[: k - 1]), bits)))
        buckets = share(bucket_bitmap(last.filter("part IS NOT NULL"), bits))
        last = written(texts.mapInArrow(_counter(k, bits, longer, [*good, buckets]), PASS), f"pass-{k}")
        parts = list("abc"[:k])
        kept = written(last.filter("part IS NULL").groupBy(*parts).agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST), f"phrases-{k}")
        out.append(kept)
    return found, out


def _score(a: str, left: str, right: str) -> Column:
    """floor(SCALE * a * a / (left * right)), whatever the size of the products."""
    wide = lambda c: f"CAST({c} AS DECIMAL(15, 0))"
    return F.expr(f"CAST(({wide(a)} * {wide(a)} * CAST({SCALE} AS DECIMAL(7, 0))) DIV ({wide(left)} * {wide(right)}) AS BIGINT)")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language of docs(lang, text)."""
    shared_dir(docs.sparkSession)
    found, (pairs, triples) = counted(docs)
    frequent = found.filter(F.col("n") >= LEAST)
    word = lambda key, *names: frequent.select(F.col("a").alias(key), *(F.col(c).alias(f"{c}_{key}") for c in names))
    part = lambda x, y: pairs.select(F.col("a").alias(x), F.col("b").alias(y), F.col("n").alias(f"n_{x}{y}"))
    twos = pairs.withColumnRenamed("n", "f").join(word("a", "lang", "word", "n"), "a").join(word("b", "word", "n"), "b")
    covered = triples.select(F.explode(F.array(F.struct("a", "b", "n"), F.struct(F.col("b").alias("a"), F.col("c").alias("b"), "n"))).alias("e"))
    covered = covered.groupBy("e.a", "e.b").agg(F.max("e.n").alias("within"))
    twos = twos.join(covered, ["a", "b"], "left").filter(F.coalesce(100 * F.col("within") < SHARE * F.col("f"), F.lit(True)))
    twos = twos.select(F.col("lang_a").alias("lang"), F.concat_ws(" ", "word_a", "word_b").alias("phrase"), F.col("f").alias("a"), F.col("n_a").alias("l"), F.col("n_b").alias("r"), _score("f", "n_a", "n_b").alias("score"))
    threes = triples.withColumnRenamed("n", "f").join(part("a", "b"), ["a", "b"]).join(part("b", "c"), ["b", "c"])
    threes = threes.join(word("a", "lang", "word", "n"), "a").join(word("b", "word"), "b").join(word("c", "word", "n"), "c")
    threes = threes.withColumns({"s1": _score("f", "n_a", "n_bc"), "s2": _score("f", "n_ab", "n_c")})
    first = F.col("s1") <= F.col("s2")
    threes = threes.select(
        F.col("lang_a").alias("lang"), F.concat_ws(" ", "word_a", "word_b", "word_c").alias("phrase"), F.col("f").alias("a"), F.when(first, F.col("n_a")).otherwise(F.col("n_ab")).alias("l"),
        F.when(first, F.col("n_bc")).otherwise(F.col("n_c")).alias("r"), F.least("s1", "s2").alias("score"),
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = twos.unionByName(threes).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    sizes = found.groupBy("lang").agg(F.sum("n").alias("n"))  # a row for each language
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("n").cast("long").alias("n"), "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents
), p AS (
  SELECT lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS w FROM t
), one AS (
  SELECT lang, unnest(w) AS phrase, 1 AS size FROM p
), f1 AS (
  SELECT lang, phrase, count(*) AS f FROM one GROUP BY ALL
), s2 AS (
  SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: {{'x': w[i], 'y': w[i + 1]}})) AS s FROM p
), f2 AS (
  SELECT lang, s.x, s.y, count(*) AS f FROM s2 GROUP BY ALL HAVING count(*) >= {LEAST}
), s3 AS (
  SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: {{'x': w[i], 'y': w[i + 1], 'z': w[i + 2]}})) AS s FROM p
), f3 AS (
  SELECT lang, s.x, s.y, s.z, count(*) AS f FROM s3 GROUP BY ALL HAVING count(*) >= {LEAST}
), within AS (
  SELECT lang, x, y, max(f) AS most FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY ALL
), scored AS (
  SELECT c.lang, c.x || ' ' || c.y AS phrase, c.f AS a, u.f AS l, v.f AS r
  FROM f2 c JOIN f1 u ON u.lang = c.lang AND u.phrase = c.x JOIN f1 v ON v.lang = c.lang AND v.phrase = c.y
  LEFT JOIN within w ON w.lang = c.lang AND w.x = c.x AND w.y = c.y WHERE coalesce(100 * w.most < {SHARE} * c.f, true)
  UNION ALL
  SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z, c.f, CASE WHEN {{0}} <= {{1}} THEN u.f ELSE d.f END, CASE WHEN {{0}} <= {{1}} THEN e.f ELSE v.f END
  FROM f3 c JOIN f1 u ON u.lang = c.lang AND u.phrase = c.x JOIN f1 v ON v.lang = c.lang AND v.phrase = c.z
  JOIN f2 d ON d.lang = c.lang AND d.x = c.x AND d.y = c.y JOIN f2 e ON e.lang = c.lang AND e.x = c.y AND e.y = c.z
), ranked AS (
  SELECT *, {SCALE}::HUGEINT * a * a // (l::HUGEINT * r) AS score FROM scored
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ranked
)
SELECT lang, rank, phrase, a, l, r, (SELECT sum(f)::BIGINT FROM f1 WHERE f1.lang = numbered.lang) AS n, score::BIGINT AS score FROM numbered WHERE rank <= {TOP}
""".replace("{0}", f"{SCALE}::HUGEINT * c.f * c.f // (u.f::HUGEINT * e.f)").replace("{1}", f"{SCALE}::HUGEINT * c.f * c.f // (d.f::HUGEINT * v.f)")

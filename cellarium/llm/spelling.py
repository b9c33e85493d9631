"""Spelling variants: each word of a vocabulary with the frequent word that it is one edit away from, found without pairs.

Runs of letters are counted natively. A word of m code points joins m wildcard groups (position, what is before it, what is
after it); all words of a group replace each other's code point there. A group keeps its size and its two best words, which
answer all its members: the best one answers the others, and the second answers the best. A word also joins the group of
each word that deleting one code point would give; where that word is in the vocabulary, it is in that group, too, and
learns how many longer words there are and the best of them, while they learn of it. Words are numbered from the most
frequent to the least (ties in code-point order), so the best of a group is its smallest number.

A group's name is a sum of 64-bit hashes of (place, code point), twice, so a word's groups cost one pass over it, however
long it is; groups are told apart by 128 bits. A group of replacements has no more members than the alphabet has letters.

Roots follow forms by pointer doubling: n at least doubles in each step, so a chain of forms has at most 62 links.

Defined cases: null and empty texts have no words; a null doc_id is the empty text in `<doc_id>:<run>`; repeated rows count
each; very long runs are words like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellarium.llm.common import cut, shared_dir, table, written
from cellarium.llm.shingles import mix

#: Code points that a word has at least, times that it occurs at least, and by how much a form is more frequent.
LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
#: Every so many-th run (by its hash) loses a code point.
DAMAGED = 97
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points of words handled at once.
POINTS_AT_ONCE = 500_000
REPLACED, SHORTER, ITSELF = 0, 1, 2
GROUPS = "id long, kind byte, g1 long, g2 long"


def runs(docs: DataFrame) -> DataFrame:
    """word, n: the words of docs(doc_id, text), damaged where their hash says so, with their occurrences."""
    # A run that is too short stays too short, so it needn't be looked at.
    found = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{LEAST_LENGTH},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(found).alias("run"))
    each = each.select("doc", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run"))
    at = (h % F.char_length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    words = each.select(F.when(h % DAMAGED == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.filter(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))


def _hash(place: np.ndarray, point: np.ndarray, seed: int) -> np.ndarray:
    return mix(mix((place.astype(np.uint64) << np.uint64(21)) | point.astype(np.uint64)) + np.uint64(seed))


SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: No code point; it stands for any.
ANY = 1 << 20


def group_names(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """index of the word, kind, and the two hashes of each group of each word."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    point = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    first = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(point)) - first[owner]
    # Deleting any code point of a stretch of equal ones gives the same word.
    new = np.ones(len(point), dtype=bool)
    new[1:] = (point[1:] != point[:-1]) | (place[1:] == 0)
    kinds = [np.full(len(point), REPLACED, np.int8), np.full(int(new.sum()), SHORTER, np.int8), np.full(len(words), ITSELF, np.int8)]
    names = []
    for seed in SEEDS:
        here, before = _hash(place, point, seed), _hash(place - 1, point, seed)
        total = np.add.reduceat(here, first) if len(words) else here
        wild = total[owner] - here + _hash(place, np.full(len(point), ANY), seed)
        up, down = np.cumsum(here), np.cumsum(before)
        last = first + lengths - 1
        # What is before the place keeps its places, and what is after it moves up by one.
        left = up - here - (up[first] - here[first])[owner]
        right = down[last][owner] - down
        # The word's length is in its name, so that a whole word and a wildcard never meet.
        size = lambda n: mix(n.astype(np.uint64) + np.uint64(seed ^ 0x5555))  # noqa: B023, E731
        names.append(np.concatenate((wild + size(lengths)[owner] * np.uint64(3), (left + right)[new] + size(lengths - 1)[owner][new], total + size(lengths))))
    return np.concatenate((owner, owner[new], np.arange(len(words)))), np.concatenate(kinds), names


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, words = batch.column("id").to_numpy(), batch.column("word").to_pylist()
        cuts = np.cumsum([len(w) for w in words]) // POINTS_AT_ONCE
        for part in np.unique(cuts):
            rows = np.flatnonzero(cuts == part)
            owner, kind, (g1, g2) = group_names([words[i] for i in rows])
            for at in range(0, len(owner), 1 << 20):
                s = slice(at, at + (1 << 20))
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows][owner[s]]), pa.array(kind[s]), pa.array(g1[s].view(np.int64)), pa.array(g2[s].view(np.int64))], names=["id", "kind", "g1", "g2"])


def near_words(vocabulary: DataFrame) -> DataFrame:
    """id, n_near, best (the smallest id of a near word) of each word of vocabulary(id, word) that has near words."""
    members = vocabulary.select("id", "word").mapInArrow(_groups, GROUPS)
    group = Window.partitionBy("g1", "g2")
    best = group.orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kind = F.col("kind")
    of = lambda k, c: F.when(kind == k, c)
    told = members.withColumns({
        "size": F.count("*").over(group), "one": F.first("id").over(best), "two": F.nth_value("id", 2).over(best),
        "whole": F.min(of(ITSELF, F.col("id"))).over(group), "longer": F.min(of(SHORTER, F.col("id"))).over(group),
    })
    n = F.when(kind == SHORTER, F.when(F.col("whole").isNotNull(), 1).otherwise(0)).otherwise(F.col("size") - 1)
    other = F.when(kind == REPLACED, F.when(F.col("one") == F.col("id"), F.col("two")).otherwise(F.col("one"))).when(kind == SHORTER, F.col("whole")).otherwise(F.col("longer"))
    return told.select("id", n.cast("long").alias("n"), other.alias("other")).filter("n > 0").groupBy("id").agg(F.sum("n").alias("n_near"), F.min("other").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """id, root of each word of forms(id, form): where following forms ends."""
    found = cut(forms.select("id", F.col("form").alias("root")))
    while True:
        ahead = found.select(F.col("id").alias("root"), F.col("root").alias("next"))
        step = cut(found.join(ahead, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        found = step.drop("moved")
        if step.filter("moved").limit(1).count() == 0:
            return found


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs(doc_id, text)."""
    shared_dir(docs.sparkSession)
    counted = written(runs(docs).filter(F.col("n") >= LEAST_COUNT), "words")
    vocabulary = written(counted.orderBy(F.desc("n"), "word").withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    near = written(near_words(vocabulary), "near-words")
    forms = near.select("id", F.col("best").alias("form"), "n_near").join(vocabulary.select("id", "n"), "id")
    named = vocabulary.select(F.col("id").alias("form"), F.col("word").alias("form_word"), F.col("n").alias("form_n"))
    forms = written(forms.join(named, "form").withColumn("good", F.col("form_n") >= TIMES * F.col("n")), "forms")
    ends = roots(forms.filter("good")).join(vocabulary.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    out = vocabulary.join(forms.select("id", "n_near", F.when(F.col("good"), F.col("form_word")).alias("form"), F.when(F.col("good"), F.col("form_n")).alias("form_n")), "id", "left").join(ends, "id", "left")
    return out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


#: crc32 has no function there: a step for each byte, eight times "halve, and xor if odd".
_HALF = "list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, {0})"
SQL = rf"""
WITH r AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), '{UPPER}', '{LOWER}') AS run FROM documents
), d AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS key, run, count(*) AS k FROM r GROUP BY ALL
), h AS (
  SELECT run, k, xor(list_reduce(
    list_transform(range(octet_length(encode(key))), lambda i: ('0x' || substr(hex(encode(key)), 2 * i + 1, 2))::BIGINT),
    lambda c, x: {_HALF.format('xor(c, x)')}, 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM d
), w AS (
  SELECT CASE WHEN h % {DAMAGED} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM h
), v AS (
  SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}
), p AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v
), wild AS (
  SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS g FROM p
), cutaway AS (
  SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS g FROM p
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM wild a JOIN wild b ON a.g = b.g AND a.word <> b.word
  UNION ALL SELECT c.word, v.word, v.n FROM cutaway c JOIN v ON v.word = c.g
  UNION ALL SELECT v.word, c.word, c.n FROM cutaway c JOIN v ON v.word = c.g
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word
), f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {TIMES} * n THEN other END AS form, CASE WHEN other_n >= {TIMES} * n THEN other_n END AS form_n
  FROM v LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS root FROM f WHERE form IS NULL
  UNION ALL SELECT f.word, chain.root FROM f JOIN chain ON f.form = chain.word
)
SELECT f.word, form, chain.root, n, n_near, form_n FROM f JOIN chain ON f.word = chain.word
""".replace("WITH r AS", "WITH RECURSIVE r AS")

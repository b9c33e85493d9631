"""Near duplicates by DartMinHash: weighted five-word shingles, banded joining, exact weighted Jaccard.

A document is the multiset of its shingles; the number of times is a shingle's weight. Darts are thrown, by hashes of the
shingle alone, at the plane of weight and rank; those below a document's weight land on it. Each dart belongs to one of
BANDS * ROWS coordinates, and the earliest dart (least rank) of each coordinate is the signature: two documents agree in
a coordinate with a probability equal to their weighted Jaccard similarity. At 0.8 a pair meets in no band with
probability 5e-6. Weights need not be whole: cells of weight double in size, cells of rank too.

Joining never emits all pairs of a bucket. Copies (equal word sequences) are one class from the start; in each bucket all
members are first compared with the bucket's smallest id only (a star), and then only members of a bucket that are still
in different components are compared with each other. Of a bucket with more than PAIRED members this is done in blocks:
products of 0/1 matrices count the common elements of BLOCK by BLOCK texts, and only a spanning forest of the links leaves
a task. So no link between components is lost, and rows grow with members, not with their pairs.

Defined cases: null text counts as empty; a document without words is a class of its own; fewer than five words are one
shingle; rows that repeat an id share its class; a null id takes the class of its copies, else null; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.llm import shingles as S
from cellarium.llm.common import bounded_batches, cut, shared_dir, small, table, written
from cellarium.llm.components import Forest, components

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 40, 6
FIRST_RANK = 1 / 32
#: Members of a mixed bucket that are compared pair by pair; those of a larger one meet in blocks of so many texts, and
#: their elements in so many columns at once.
PAIRED, BLOCK, COLUMNS = 64, 256, 8192
PACKED = "grp long, block long, blocks long, ids binary, rows binary, places binary, distinct binary"
UNIT = 2.0**-53


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * UNIT


def _poisson(area: float) -> np.ndarray:
    """The distribution function of the number of darts in a cell of this area."""
    n = np.arange(int(area + 12 * math.sqrt(area) + 30))
    logs = n * math.log(area) - area - np.array([math.lgamma(k + 1) for k in n])
    return np.minimum(np.cumsum(np.exp(logs)), 1.0)[:-1]


def dart_minhash(rows: int, row: np.ndarray, value: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """The least rank for each of `rows` weighted sets and k coordinates; infinite only for empty sets."""
    out = np.full((rows, k), np.inf)
    total = np.bincount(row, weights=weight, minlength=rows)
    reach = np.where(total > 0, k * (math.log(k) + 4) / np.maximum(total, 1e-300), 0)
    todo = total > 0
    while todo.any():  # a set with an empty coordinate is done again with twice the reach
        use = todo[row]
        _throw(out, row[use], value[use], weight[use].astype(np.float64), np.where(todo, reach, 0), k)
        todo &= np.isinf(out).any(axis=1)
        reach *= 2
    return out


def _throw(out: np.ndarray, row: np.ndarray, value: np.ndarray, weight: np.ndarray, reach: np.ndarray, k: int) -> None:
    flat, far, cell = out.reshape(-1), reach[row], 0
    low, high = 0.0, 1.0
    while low < weight.max(initial=0):
        heavy = np.flatnonzero(weight > low)
        rank, upto, band = 0.0, FIRST_RANK, 0
        while len(heavy := heavy[far[heavy] > rank]):
            seed = S.mix(value[heavy] + np.uint64((cell * 4099 + band + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            count = np.searchsorted(_poisson((high - low) * (upto - rank)), _uniform(seed), side="right")
            which = np.repeat(np.arange(len(heavy)), count)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            a = S.mix(seed[which] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
            b = S.mix(a ^ np.uint64(0x165667B19E3779F9))
            ranks = rank + (upto - rank) * _uniform(b)
            owner = heavy[which]
            hit = (ranks < far[owner]) & (low + (high - low) * _uniform(a) < weight[owner])
            coordinate = (S.mix(b[hit] ^ a[hit]) % np.uint64(k)).astype(np.int64)
            np.minimum.at(flat, row[owner[hit]] * k + coordinate, ranks[hit])
            rank, upto, band = upto, upto * 2, band + 1
        low, high, cell = high, high * 2, cell + 1


def _weighted_shingles(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for first, data, rows in S.blocks(texts):
        hashes, word_rows = S.words(data, rows)
        values, starts = S.shingles(hashes, word_rows, WORDS)
        yield first, len(rows) - 1, hashes, word_rows, *S.multisets(starts, values)


SIGNATURE = "doc_id long, copy_a long, copy_b long, bands array<long>"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, n, hashes, word_rows, row, value, count in _weighted_shingles(batch.column(1)):
            least = dart_minhash(n, row, value, count, BANDS * ROWS).view(np.uint64).reshape(n, BANDS, ROWS)
            keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (n, BANDS)).copy()
            for i in range(ROWS):
                keys = S.mix(keys * S.BASE + least[:, :, i])
            some = np.diff(word_rows) > 0
            digests = [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() for a, b in zip(word_rows[:-1], word_rows[1:], strict=True)]
            copies = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(n, 2)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum(np.where(some, BANDS, 0)))), pa.int32()), pa.array(keys[some].reshape(-1).view(np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, n), pa.array(copies[:, 0]), pa.array(copies[:, 1]), lists], names=["doc_id", "copy_a", "copy_b", "bands"]
            )


def signatures(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_signatures, SIGNATURE)


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = []
        for name in ("text_a", "text_b"):
            parts = [(row + first, value, count) for first, _, _, _, row, value, count in _weighted_shingles(batch.column(name))]
            sides.append([np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3)])
        n = batch.num_rows
        row, value, count = (np.concatenate(x) for x in zip(*sides, strict=True))
        order = np.lexsort((value, row))
        row, value, count = row[order], value[order], count[order]
        both = np.flatnonzero((row[1:] == row[:-1]) & (value[1:] == value[:-1]))
        common = np.bincount(row[both], weights=np.minimum(count[both], count[both + 1]), minlength=n)
        total = np.bincount(row, weights=count, minlength=n)
        near = common * (1 + SIMILAR) >= SIMILAR * total - 1e-9  # common / (total - common) >= SIMILAR
        near &= common > 0
        keep = pa.array(near)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])


def similar(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of pairs(a, b), those whose documents have a weighted Jaccard similarity of SIMILAR or more; cut before its return."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(small(ids), "doc_id", "left_semi")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return cut(both.select("a", "b", "text_a", "text_b").mapInArrow(_similar, "a long, b long").distinct())


def _block(group: pa.Table) -> pa.Table:
    """One row for a block of a group: its ids and, compressed, the elements (shingle and how often before) of each text."""
    ids, rows, elements, first = group.column("doc_id").to_numpy(), [], [], 0
    for chunk in group.column("text").chunks:
        for at, _, _, _, row, value, count in _weighted_shingles(chunk):
            which = np.repeat(np.arange(len(row)), count)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            rows.append(row[which] + at + first)
            elements.append(S.mix(value[which] + nth.astype(np.uint64) * S.BASE))
        first += len(chunk)
    distinct, place = np.unique(np.concatenate(elements), return_inverse=True)
    pack = zstandard.ZstdCompressor().compress
    return pa.table({
        "grp": [group.column("grp")[0].as_py()], "block": [group.column("block")[0].as_py()], "blocks": [group.column("blocks")[0].as_py()],
        "ids": [ids.tobytes()], "rows": [pack(np.concatenate(rows).astype(np.int32).tobytes())],
        "places": [pack(place.astype(np.int32).tobytes())], "distinct": [pack(distinct.tobytes())],
    })


def _tile(group: pa.Table) -> pa.Table:
    """The links between the texts of two blocks, or within one, as a spanning forest: a text with the least it reaches."""
    unpack = zstandard.ZstdDecompressor().decompress
    if group.num_rows < 2 and group.column("lo")[0] != group.column("hi")[0]:  # the other block is empty
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    sides = []
    for r in sorted(group.to_pylist(), key=lambda r: r["block"]):
        distinct = np.frombuffer(unpack(r["distinct"]), np.uint64)
        sides.append((np.frombuffer(r["ids"], np.int64), np.frombuffer(unpack(r["rows"]), np.int32), distinct[np.frombuffer(unpack(r["places"]), np.int32)]))
    (ids_a, rows_a, el_a), (ids_b, rows_b, el_b) = sides[0], sides[-1]
    shared = np.intersect1d(el_a, el_b)
    common = np.zeros((len(ids_a), len(ids_b)), np.float32)  # whole numbers below 2**24
    for at in range(0, len(shared), COLUMNS):
        part = shared[at : at + COLUMNS]
        dense = []
        for ids, rows, el in ((ids_a, rows_a, el_a), (ids_b, rows_b, el_b)):
            place = np.minimum(np.searchsorted(part, el), len(part) - 1)
            ours = part[place] == el
            dense.append(np.zeros((len(ids), len(part)), np.float32))
            dense[-1][rows[ours], place[ours]] = 1
        common += dense[0] @ dense[1].T
    size = np.bincount(rows_a, minlength=len(ids_a))[:, None] + np.bincount(rows_b, minlength=len(ids_b))[None, :]
    near = (common * (1 + SIMILAR) >= SIMILAR * size - 1e-9) & (common > 0) & (ids_a[:, None] != ids_b[None, :])
    i, j = np.nonzero(near)
    nodes, at = np.unique(np.concatenate((ids_a[i], ids_b[j])), return_inverse=True)
    forest = Forest(len(nodes))
    forest.link(at[: len(i)], at[len(i) :])
    below = np.flatnonzero(forest.root != np.arange(len(nodes)))
    return pa.table({"a": nodes[forest.root[below]], "b": nodes[below]})


def similar_in_blocks(groups: DataFrame, docs: DataFrame) -> DataFrame:
    """Links that connect what is similar within each group of groups(doc_id, grp), by products of blocks of texts."""
    sizes = groups.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))
    dealt = groups.join(small(cut(sizes)), "grp").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(small(cut(dealt)), "doc_id")
    packed = written(texts.groupBy("grp", "block").applyInArrow(_block, PACKED), "text-blocks")
    tiles = packed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("peer"))
    tiles = tiles.withColumns({"lo": F.least("block", "peer"), "hi": F.greatest("block", "peer")}).drop("peer")
    return tiles.groupBy("grp", "lo", "hi").applyInArrow(_tile, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest id of its class) and kept for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    shared_dir(spark)
    bounded_batches(spark)
    signed = written(signatures(docs), "signatures")
    copies = signed.filter("doc_id IS NOT NULL").groupBy("copy_a", "copy_b").agg(F.min(F.struct("doc_id", "bands")).alias("one"))
    bands = written(copies.select("one.doc_id", F.explode("one.bands").alias("band")), "bands")
    buckets = bands.groupBy("band").agg(F.min("doc_id").alias("star"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = written(bands.join(buckets.select("band", "star"), "band"), "members")
    pairs = cut(members.filter("doc_id <> star").select(F.col("star").alias("a"), F.col("doc_id").alias("b")).distinct())
    links = similar(pairs, docs)
    roots = components(links)
    # What shares a bucket but no component yet is compared pair by pair.
    label = F.coalesce("root", "doc_id").alias("root")
    labelled = members.join(roots, members.doc_id == roots.node, "left").select("band", "star", "doc_id", label)
    mixed = labelled.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("n")).filter("x <> y")
    labelled = written(labelled.join(mixed.select("band", (F.col("n") > PAIRED).alias("large")), "band"), "mixed")
    few = labelled.filter("NOT large")
    left = few.select("band", F.col("doc_id").alias("a"), F.col("root").alias("ra"))
    right = few.select("band", F.col("doc_id").alias("b"), F.col("root").alias("rb"))
    rest = left.join(right, "band").filter("a < b AND ra <> rb").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
    # Large buckets of several bands overlap: each document is in one joined group of them, compared in blocks.
    groups = components(labelled.filter("large").select(F.col("star").alias("a"), F.col("doc_id").alias("b")))
    groups = groups.select(F.col("node").alias("doc_id"), F.col("root").alias("grp"))
    groups = cut(groups.union(groups.select(F.col("grp").alias("doc_id"), "grp").distinct()))
    more = cut(similar(cut(rest), docs).union(similar_in_blocks(groups, docs)))
    if more.limit(1).count():
        roots = components(links.union(more))
    firsts = copies.select("copy_a", "copy_b", F.col("one.doc_id").alias("least"))
    firsts = firsts.join(roots, F.col("least") == F.col("node"), "left").select("copy_a", "copy_b", F.coalesce("root", "least").alias("root"))
    found = signed.select("doc_id", "copy_a", "copy_b", (F.size("bands") > 0).alias("some")).join(firsts, ["copy_a", "copy_b"], "left")
    root = F.when(F.col("some"), F.col("root")).otherwise(F.col("doc_id"))
    return found.select("doc_id", root.alias("class_id"), F.col("doc_id").eqNullSafe(root).alias("kept"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

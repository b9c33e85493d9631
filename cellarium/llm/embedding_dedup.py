"""Embedding near duplicates: int8 tile products with error bounds, recomputed in full precision where they may pass.

A unit vector u is stored as s * q + e with q in int8; the length of e is known exactly, so the product of two quantised
vectors misses the true cosine by no more than |e_u| + |e_v| + |e_u||e_v|. Blocks of BLOCK vectors meet in tiles; a tile
multiplies the int8 parts, adds the bound, and recomputes in double precision only the pairs that may reach SIMILAR.

A tile returns no pairs: it gives a count of links per vector and a spanning forest of its links, so its result grows
with its vectors however many pairs link. Equal vectors are counted once with their number. All pairs of blocks meet, so
the work grows with the square of the distinct vectors; that is the method's price for missing no pair.

Defined cases: null vectors, zero vectors and vectors with null or non-finite components link with nothing; vectors of
different lengths do not link; rows that repeat an id or have none are vectors of their own, linked by what they hold, as
distinct vectors have keys of their own; a component takes the smallest id among its rows (null if none has one); an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.llm.common import cut, shared_dir, table, written
from cellarium.llm.components import Forest, components

SIMILAR = 0.9
BLOCK, ROWS_AT_ONCE, PAIRS_AT_ONCE = 4096, 512, 100_000
#: Over any error of rounding in the bound and the products.
SLACK = 1e-6


def _packed(group: pa.Table) -> pa.Table:
    """One row for a block: ids, numbers of copies, vectors, and their int8 parts with scale and error length."""
    ids = group.column("vec_id").to_numpy()
    x = np.array(group.column("embedding").to_pylist(), dtype=np.float64).reshape(len(ids), -1)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    unit = x / norm[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - q * scale[:, None]) ** 2).sum(axis=1))
    with np.errstate(over="ignore"):
        narrow = x.astype(np.float32)  # half the bytes, where nothing is lost
    parts = (ids, group.column("copies").to_numpy(), narrow if np.array_equal(narrow, x) else x, norm, q, scale, error)
    head = {"width": group.column("width")[0].as_py(), "block": group.column("block")[0].as_py(), "size": len(ids)}
    return pa.table({k: [v] for k, v in head.items()} | {f"p{i}": [p.tobytes()] for i, p in enumerate(parts)})


PACKED = "width long, block long, size long, p0 binary, p1 binary, p2 binary, p3 binary, p4 binary, p5 binary, p6 binary"
TYPES = (np.int64, np.int64, np.float64, np.float64, np.int8, np.float64, np.float64)


def _unpacked(row: dict) -> list[np.ndarray]:
    narrow = len(row["p2"]) == 4 * len(row["p4"])
    parts = [np.frombuffer(row[f"p{i}"], dtype=np.float32 if i == 2 and narrow else t) for i, t in enumerate(TYPES)]
    for i in (2, 4):
        parts[i] = parts[i].reshape(row["size"], -1)
    parts[2] = parts[2].astype(np.float64)
    return parts


def _tile(group: pa.Table) -> pa.Table:
    blocks = [_unpacked(r) for r in sorted(group.to_pylist(), key=lambda r: r["block"])]
    alone = group.column("lo")[0] == group.column("hi")[0]
    if len(blocks) < 2 and not alone:  # the other block has no vector of this length
        return pa.table({c: pa.array([], pa.int64()) for c in ("vec_id", "peer", "links")})
    left, right = blocks[0], blocks[-1]
    (ids_a, copies_a, xa, norm_a, qa, scale_a, error_a), (ids_b, copies_b, xb, norm_b, qb, scale_b, error_b) = left, right
    exact = np.float32 if qa.shape[1] * 127 * 127 < 1 << 24 else np.float64  # whole numbers that the type holds exactly
    other = qb.T.astype(exact)
    links_a, links_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    shift = 0 if alone else len(ids_a)
    forest = Forest(len(ids_b) + shift)
    for at in range(0, len(ids_a), ROWS_AT_ONCE):
        rows = slice(at, at + ROWS_AT_ONCE)
        bound = (qa[rows].astype(exact) @ other) * (scale_a[rows, None] * scale_b[None, :])
        bound += error_a[rows, None] * (1 + error_b[None, :]) + error_b[None, :]
        i, j = np.nonzero(bound >= SIMILAR - SLACK)
        i += at
        if alone:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), PAIRS_AT_ONCE):
            a, b = i[k : k + PAIRS_AT_ONCE], j[k : k + PAIRS_AT_ONCE]
            near = np.einsum("ij,ij->i", xa[a], xb[b]) / (norm_a[a] * norm_b[b]) >= SIMILAR
            a, b = a[near], b[near]
            links_a += np.bincount(a, weights=copies_b[b], minlength=len(ids_a)).astype(np.int64)
            links_b += np.bincount(b, weights=copies_a[a], minlength=len(ids_b)).astype(np.int64)
            forest.link(a, b + shift)
    ids = ids_b if alone else np.concatenate((ids_a, ids_b))
    links = links_a + links_b if alone else np.concatenate((links_a, links_b))
    some = np.flatnonzero(links)
    return pa.table({"vec_id": ids[some], "peer": ids[forest.root[some]], "links": links[some]})


def links_of(reps: DataFrame) -> DataFrame:
    """vec_id, peer, links for each tile and vector of reps(vec_id, copies, embedding) that has links there."""
    n = reps.count()
    blocks = max(1, -(-n // BLOCK))
    cells = reps.select("*", F.size("embedding").alias("width"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    packed = written(cells.groupBy("width", "block").applyInArrow(_packed, PACKED), "vector-blocks")
    # Each block goes to the tiles of its row and its column; a tile gets one or two blocks.
    peers = F.sequence(F.lit(0), F.lit(blocks - 1))
    tiles = packed.select("*", F.explode(peers).alias("peer_block"))
    tiles = tiles.withColumns({"lo": F.least("block", "peer_block"), "hi": F.greatest("block", "peer_block")}).drop("peer_block")
    return tiles.groupBy("width", "lo", "hi").applyInArrow(_tile, "vec_id long, peer long, links long")


def embedding_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors(vec_id, embedding)."""
    shared_dir(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    some = F.exists("embedding", lambda v: v != 0)
    rows = rows.withColumn("embedding", F.when(finite & some, F.col("embedding")))
    good = rows.filter("embedding IS NOT NULL")
    groups = good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    groups = written(groups.withColumn("key", F.monotonically_increasing_id()), "vectors")
    links = cut(links_of(groups.select(F.col("key").alias("vec_id"), "copies", "embedding")))
    roots = components(links.select(F.col("vec_id").alias("a"), F.col("peer").alias("b")))
    counts = links.groupBy(F.col("vec_id").alias("key")).agg(F.sum("links").alias("links"))
    known = groups.join(counts, "key", "left").join(roots, F.col("key") == F.col("node"), "left")
    known = known.withColumn("root", F.coalesce("root", "key"))
    least = known.groupBy("root").agg(F.min("rep").alias("component"))
    known = known.join(least, "root").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), "component")
    out = rows.join(known, "embedding", "left")
    component = F.when(F.col("embedding").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS len FROM embeddings
), link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.len > 0 AND b.len > 0 AND list_dot_product(a.e, b.e) / (a.len * b.len) >= {SIMILAR}
), reach(x, y) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x
), comp AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
deg AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT v.vec_id, coalesce(deg.n, 0) AS n_links, comp.component_id, v.vec_id = comp.component_id AS kept
FROM v JOIN comp ON v.vec_id = comp.x LEFT JOIN deg ON v.vec_id = deg.x
"""

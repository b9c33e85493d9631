"""Approximate nearest neighbours by cross-polytope hashing, with multiprobe tables and exact reranking.

A hash turns a unit vector by a pseudo-rotation (three times random signs and a Hadamard transform, after padding to a
power of two) and takes the signed axis that it points to most. A table joins the axes of DEPTH hashes into a bucket, DEPTH
growing with the logarithm of the number of vectors. Every distinct vector lies in one bucket of each of TABLES tables; a
query looks into the buckets of each table that its rotated values make likeliest. How many (the probes) is found by a
bounded sample: up to SAMPLE queries are searched exactly, and the fewest probes that find RECALL of their neighbours are
taken for all queries; if even MOST_PROBES don't, the tables get coarser, and a table that is probed whole is exact.

Rows meet queries by bucket, in tiles of at most BLOCK of each, so a crowded bucket becomes many tasks. A tile multiplies
them and returns the best few for each query, recomputed in double precision. Equal vectors are searched once, with the
smallest ids they have, so copies cost nothing. A query that finds too few is searched exactly against all rows, in blocks.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of different
lengths are no candidates of each other; a candidate is a row, so rows that repeat an id or a vector are candidates of
each other, and only the query's own row isn't one; rows without an id are candidates (last among ties) and never queries;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellarium.llm.common import cut, shared_dir, small, table, written

TABLES, BLOCK = 8, 2048
#: Distinct vectors in a bucket of the finest table, about.
IN_BUCKET = 64
SAMPLE, RECALL, MOST_PROBES = 256, 0.97, 2048
#: Over any error of rounding between one way of multiplying and another.
SLACK = 1e-9
SEED = 11
VECTOR = ["h1", "h2"]
CELL = ["width", "tab", "bucket"]


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthogonal Hadamard transform of each row; their length is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def padded(width: int) -> int:
    return 1 << max(1, (width - 1).bit_length())


def rotated(x: np.ndarray, tab: int, place: int) -> np.ndarray:
    """The values of rows x on all signed axes (first the positive ones), under one hash of a table."""
    n, width = x.shape
    d = padded(width)
    turned = np.zeros((n, d))
    turned[:, :width] = x
    signs = np.random.default_rng([SEED, d, tab, place]).integers(0, 2, (3, d)) * 2.0 - 1
    for s in signs:
        turned = hadamard(turned * s)
    return np.concatenate((turned, -turned), axis=1)


def buckets(x: np.ndarray, tab: int, depth: int) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for place in range(depth):
        values = rotated(x, tab, place)
        out = out * values.shape[1] + values.argmax(axis=1)
    return out


def probes(x: np.ndarray, tab: int, depth: int, most: int) -> np.ndarray:
    """The likeliest `most` buckets of each row, best first: those whose axes together have the largest values. The k-th
    best choice of axes has ranks (from 1) whose product is k at most, so only such choices are looked at."""
    axes = 2 * padded(x.shape[1])
    most = min(most, axes**depth)
    choice = [()]
    for _ in range(depth):
        choice = [(*c, r) for c in choice for r in range(min(axes, most // int(np.prod([k + 1 for k in c], dtype=np.int64))))]
    choice = np.array(choice, dtype=np.int64).reshape(len(choice), depth)
    loss, code = np.zeros((len(x), len(choice))), np.zeros((len(x), len(choice)), np.int64)
    for place in range(depth):
        values = rotated(x, tab, place)
        order = np.argsort(-values, axis=1, kind="stable")
        value = np.take_along_axis(values, order, axis=1)
        loss += (value[:, :1] - value)[:, choice[:, place]]
        code = code * axes + order[:, choice[:, place]]
    best = np.argsort(loss, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(code, best, axis=1)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares stay finite
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows with rows, in one fixed order of operations."""
    a, b = np.abs(x).max(axis=1, keepdims=True), np.abs(y).max(axis=1, keepdims=True)
    extreme = (a > 1e100) | (b > 1e100) | (a < 1e-100) | (b < 1e-100)
    x, y = np.where(extreme, x / a, x), np.where(extreme, y / b, y)
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


def _placed(plan: dict[int, tuple[int, int]], query: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of vectors with each of their buckets; of queries with each bucket that they look into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths):
                part = batch.filter(pa.array(widths == width))
                depth, most = plan[padded(int(width))]
                for at in range(0, part.num_rows, 256):
                    rows = part.slice(at, 256)
                    unit = _units(_matrix(rows.column("embedding")))
                    for tab in range(TABLES if depth else 1):
                        found = probes(unit, tab, depth, most) if query else buckets(unit, tab, depth)[:, None]
                        again = rows.take(pa.array(np.repeat(np.arange(len(found)), found.shape[1])))
                        yield pa.RecordBatch.from_arrays(
                            [*again.columns, pa.array(np.full(found.size, tab, np.int32)), pa.array(found.ravel())],
                            names=[*batch.schema.names, "tab", "bucket"],
                        )

    return run


FOUND = "q1 long, q2 long, h1 long, h2 long, first_id long, score double"


def _tile(most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in FOUND.split(", ")]
        if not rows.num_rows or not queries.num_rows:
            return pa.table([pa.array([], pa.float64() if n == "score" else pa.int64()) for n in names], names=names)
        x, y = _matrix(rows.column("embedding")), _matrix(queries.column("embedding"))
        first = rows.column("first_id").fill_null(np.iinfo(np.int64).max).to_numpy()
        near = _units(y) @ _units(x).T
        least = np.partition(near, -most, axis=1)[:, -most] if near.shape[1] > most else near.min(axis=1)
        i, j = np.nonzero(near >= (least - SLACK)[:, None])
        score = np.concatenate([cosines(y[i[k : k + 65536]], x[j[k : k + 65536]]) for k in range(0, len(i), 65536)])
        order = np.lexsort((first[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        i, j, score = i[place < most], j[place < most], score[place < most]
        take = lambda t, c, k: t.column(c).to_numpy()[k]
        return pa.table([take(queries, "h1", i), take(queries, "h2", i), take(rows, "h1", j), take(rows, "h2", j), first[j], score], names=names)

    return run


def _searched(vectors: DataFrame, queries: DataFrame, plan: dict[int, tuple[int, int]], most: int) -> DataFrame:
    """FOUND, with the best `most` vectors of each query, from vectors(h1, h2, first_id, width, embedding) and queries like them."""
    kinds = ", ".join(f"{c} {t}" for c, t in vectors.dtypes) + ", tab int, bucket long"
    rows, asked = (df.mapInArrow(_placed(plan, q), kinds) for df, q in ((vectors, False), (queries, True)))
    # A bucket with more rows or queries than a tile may have becomes several tiles; most buckets are one.
    thin = [df.select("h1", "h2", "width", "embedding").mapInArrow(_placed(plan, q), "h1 long, h2 long, width int, embedding array<double>, tab int, bucket long") for df, q in ((vectors, False), (queries, True))]
    sizes = thin[0].groupBy(*CELL).agg(F.count("*").alias("n")).join(thin[1].groupBy(*CELL).agg(F.count("*").alias("m")), CELL)
    parts = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    crowded = small(cut(sizes.select(*CELL, parts("n").alias("n"), parts("m").alias("m")).filter("n > 1 OR m > 1")))
    one = lambda c: F.coalesce(c, F.lit(1))
    share = lambda c: F.pmod("h2", one(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), one(c) - 1))
    rows = rows.join(crowded, CELL, "left").withColumn("rb", share("n")).withColumn("qb", each("m")).drop("n", "m")
    asked = asked.join(crowded, CELL, "left").withColumn("qb", share("m")).withColumn("rb", each("n")).drop("n", "m")
    tile = [*CELL, "rb", "qb"]
    found = rows.groupBy(*tile).cogroup(asked.groupBy(*tile)).applyInArrow(_tile(most), FOUND)
    pairs = found.groupBy("q1", "q2", "h1", "h2").agg(F.min("first_id").alias("first_id"), F.max("score").alias("score"))
    order = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "first_id", "h1", "h2")
    return pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("place")


def _plan(vectors: DataFrame, queries: DataFrame, most: int) -> dict[int, tuple[int, int]]:
    """Depth and probes for each padded length (a power of two, so there are few), from the sample of queries."""
    out = {}
    power = F.greatest(F.lit(2), F.pow(F.lit(2), F.ceil(F.log2("width"))).cast("int"))
    counts = vectors.groupBy(power.alias("d")).agg(F.count("*").alias("n")).collect()
    for d, n in counts:
        some = cut(queries.filter(power == d).orderBy(F.xxhash64("h1", "h2"), "h1", "h2").limit(SAMPLE))
        near = _searched(vectors.filter(power == d), some, {d: (0, 1)}, most)
        near = near.join(vectors.select(*VECTOR, "width", "embedding"), VECTOR).join(some.select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.col("embedding").alias("query")), ["q1", "q2"])
        pairs = near.filter("q1 <> h1 OR q2 <> h2").select("width", "query", "embedding").collect()  # SAMPLE * most rows at most
        depth = max(1, int(np.log(max(n / IN_BUCKET, 1)) / np.log(2 * d)))
        out[d] = next((k, t) for k in range(depth, -1, -1) if (t := _enough(pairs, d, k)))
    return out


def _enough(pairs: list, d: int, depth: int) -> int | None:
    """The fewest probes for each table that find RECALL of the pairs of vectors; None if MOST_PROBES don't."""
    if not depth or not pairs:
        return 1
    rank = np.full(len(pairs), MOST_PROBES + 1)
    for width in {r.width for r in pairs}:
        mine = np.array([i for i, r in enumerate(pairs) if r.width == width])
        for at in range(0, len(mine), 256):
            some = mine[at : at + 256]
            q, v = (_units(np.array([pairs[i][c] for i in some], dtype=np.float64)) for c in ("query", "embedding"))
            for tab in range(TABLES):
                hit = probes(q, tab, depth, MOST_PROBES) == buckets(v, tab, depth)[:, None]
                rank[some] = np.minimum(rank[some], np.where(hit.any(axis=1), hit.argmax(axis=1) + 1, MOST_PROBES + 1))
    need = int(np.sort(rank)[int(np.ceil(RECALL * len(rank))) - 1])
    return need if need <= MOST_PROBES else None


def nearest(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row of rows(vec_id, embedding) that is a query."""
    spark = rows.sparkSession
    shared_dir(spark)
    rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"), (is_query & F.col("vec_id").isNotNull()).alias("asks"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = rows.filter(F.coalesce(finite, F.lit(False))).withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(SEED), "embedding"), "width": F.size("embedding")})
    # Of equal vectors the k + 1 smallest ids do, as no query gets more of them, and one of them may be its own.
    order = Window.partitionBy(*VECTOR).orderBy(F.asc_nulls_last("vec_id"))
    few = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    vectors = few.groupBy(*VECTOR).agg(
        F.min("vec_id").alias("first_id"), F.first("width").alias("width"), F.first("embedding").alias("embedding"),
        F.array_sort(F.collect_list(F.struct(F.coalesce("vec_id", F.lit((1 << 63) - 1)).alias("key"), "vec_id"))).alias("ids"),
    )
    vectors = written(vectors, "distinct-vectors")
    asking = written(rows.filter(F.coalesce("asks", F.lit(False))).select("vec_id", *VECTOR), "query-rows")
    bare = vectors.drop("ids")
    queries = written(bare.join(asking.select(*VECTOR).distinct(), VECTOR, "left_semi"), "query-vectors")
    found = written(_searched(bare, queries, _plan(bare, queries, k + 1), k + 1), "neighbours")
    lacking = queries.join(found.groupBy(F.col("q1").alias("h1"), F.col("q2").alias("h2")).count().filter(F.col("count") > k), VECTOR, "left_anti")
    lacking = written(lacking, "queries-with-few")
    if lacking.limit(1).count():
        whole = {1 << e: (0, 1) for e in range(1, 32)}
        more = _searched(bare, lacking, whole, k + 1)
        found = found.join(lacking.select(F.col("h1").alias("q1"), F.col("h2").alias("q2")), ["q1", "q2"], "left_anti").unionByName(more)
    same = (F.col("q1") == F.col("h1")) & (F.col("q2") == F.col("h2"))
    listed = found.join(vectors.select(*VECTOR, "ids"), VECTOR).select("q1", "q2", same.alias("same"), F.col("score"), F.explode("ids").alias("id"))
    # At most (k + 1) squared for each query vector; sorted by the negative score, then by id.
    listed = listed.groupBy("q1", "q2").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), F.col("id.key").alias("key"), F.col("id.vec_id").alias("vec_id"), "same"))), 1, k + 1).alias("best"))
    out = asking.select(F.col("vec_id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2")).join(listed, ["q1", "q2"])
    own = F.array_position(F.transform("best", lambda b: b["same"] & b["vec_id"].eqNullSafe(F.col("query_id"))), True)
    others = F.when(own > 0, F.concat(F.slice("best", F.lit(1), own.cast("int") - 1), F.slice("best", own.cast("int") + 1, F.lit(k + 1)))).otherwise(F.col("best"))
    out = out.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("place", "b"))
    return out.select("query_id", (F.col("place") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.far")).alias("score"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)

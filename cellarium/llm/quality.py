"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

Statistics come from whole texts in one pass and are stored; the text is not read again. Cosines of fixed random
projections of the standardised statistics approximate a Gaussian kernel; their normal equations are summed within each
task, then in a tree of FANS, always in the same order, so a fixed number of small matrices reaches the driver. Ridge is solved there, and the scores
of a part of the labelled rows kept from it are binned (BINS counts) for the isotonic fit.

Defined cases: null text counts as empty and is scored as such; a null doc_id counts as held out; rows that repeat are
scored each; repeated labels of a document are averaged; without labels every score is 0.5; an empty table gives an
empty result; columns other than doc_id, text and the labels' quality are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.llm import shingles as S
from cellarium.llm.common import bounded_batches, shared_dir, table, written

FEATURES, WIDTH, RIDGE, SEED = 256, 4.0, 1e-3, 20240607
BINS, FANS, CUTOFF = 2000, (1024, 32), 0.3
LOWEST, HIGHEST = -1.0, 2.0

#: Classes of bytes: lower case, upper case, digit, sentence mark, other mark, space, line end, other control, not ASCII.
CLASSES = 9
CLASS = np.full(256, 4, dtype=np.int64)
CLASS[:32] = 7
CLASS[128:] = 8
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[[32, 9]], CLASS[[10, 13]] = 0, 1, 2, 5, 6
CLASS[[ord(c) for c in ".,;:!?'\"-()"]] = 3
STATS = CLASSES + 7


def statistics(texts: pa.Array) -> np.ndarray:
    """STATS numbers for each text: lengths, shares of byte classes, and repetition among words and bytes."""
    found = []
    for _, data, rows in S.blocks(texts):
        n, size = len(rows) - 1, np.diff(rows)
        row = np.repeat(np.arange(n), size)
        share = np.bincount(row * CLASSES + CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES) / np.maximum(size, 1)[:, None]
        double = np.flatnonzero((data[1:] == data[:-1]) & (CLASS[data[1:]] >= 3) & (CLASS[data[1:]] <= 4)) + 1
        hashes, word_rows = S.words(data, rows)
        words = np.diff(word_rows)
        owner, _, times = S.multisets(word_rows, hashes)
        distinct = np.bincount(owner, minlength=n)
        top = np.zeros(n)
        np.maximum.at(top, owner, times)
        pairs, starts = S.shingles(hashes, word_rows, 2)
        pair_owner, _, _ = S.multisets(starts, pairs)
        least = np.maximum(words, 1)
        found.append(np.column_stack([
            share, np.log1p(size), np.log1p(words), size / least, distinct / least, top / least,
            np.bincount(pair_owner, minlength=n) / np.maximum(np.diff(starts), 1), np.bincount(row[double], minlength=n) / np.maximum(size, 1),
        ]))
    return np.concatenate(found) if found else np.zeros((0, STATS))


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.reshape(-1)))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), _lists(statistics(batch.column(1))), *batch.columns[2:]], names=["doc_id", "stats", *batch.schema.names[2:]])


def remainder(doc_id: Column, of: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(of))


class Kernel:
    """Cosine features of standardised statistics, the same in every process."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray) -> None:
        draw = np.random.default_rng(SEED)
        self.mean, self.spread = mean, spread
        self.ways = draw.normal(size=(STATS, FEATURES)) / WIDTH
        self.shifts = draw.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -8, 8)
        return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(z @ self.ways + self.shifts), np.ones(len(z))])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column("stats").flatten()).reshape(-1, STATS)


def fit_ridge(rows: DataFrame, kernel: Kernel) -> np.ndarray:
    """Weights of the features for rows(stats, y)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((FEATURES + 1, FEATURES + 2)), 0
        for batch in batches:
            z = kernel(_matrix(batch))
            total += z.T @ np.column_stack([z, np.array(batch.column("y"))])
            seen += len(z)
        if seen:
            yield pa.RecordBatch.from_pydict({"fan": [int(total[0, 0] * 1e6)], "sums": [total.tobytes()], "n": [seen]})

    def summed(group: pa.Table) -> pa.Table:
        # Sorted, as sums of doubles depend on their order and rows arrive in any.
        total = sum(map(np.frombuffer, sorted(group.column("sums").to_pylist())))
        return pa.table({"fan": group.column("fan")[:1], "sums": [total.tobytes()], "n": [sum(group.column("n").to_pylist())]})

    kind = "fan long, sums binary, n long"
    parts = rows.mapInArrow(partial, kind)
    for width in FANS:
        parts = parts.withColumn("fan", F.pmod("fan", F.lit(width))).groupBy("fan").applyInArrow(summed, kind)
    parts = sorted(parts.collect(), key=lambda p: p.sums)
    total = sum((np.frombuffer(p.sums) for p in parts), np.zeros((FEATURES + 1) * (FEATURES + 2))).reshape(FEATURES + 1, FEATURES + 2)
    n = max(1, sum(p.n for p in parts))
    return np.linalg.solve(total[:, :-1] / n + RIDGE * np.eye(FEATURES + 1), total[:, -1] / n)


def isotonic(counts: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and rising levels of pools of adjacent violators, from counts and sums of labels by bin."""
    pools: list[list[float]] = []
    for at in np.flatnonzero(counts):
        pools.append([counts[at], ones[at], at * counts[at]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    if not pools:
        return np.zeros(1), np.full(1, 0.5)
    n, y, at = np.array(pools).T
    return LOWEST + (at / n + 0.5) * (HIGHEST - LOWEST) / BINS, y / n


def _bin(raw: Column) -> Column:
    return F.floor((F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST - 1e-9), raw)) - LOWEST) * (BINS / (HIGHEST - LOWEST)))


def quality_scores(docs: DataFrame, labels: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text), learnt from labels(doc_id, quality). String
    columns of docs named in also are passed through."""
    spark = docs.sparkSession
    shared_dir(spark)
    bounded_batches(spark)
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *also)
    further = "".join(f", {c} string" for c in also)
    stats = written(source.mapInArrow(_measure, f"doc_id long, stats array<double>{further}"), "statistics")
    marks = labels.filter("quality IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    part = remainder(F.col("doc_id"), 5)
    learn = written(stats.join(marks, "doc_id").filter(part != 0).select("stats", "y", part.alias("part")), "labelled")
    fitted = learn.filter("part <> 1")
    sums = fitted.select(*(F.col("stats")[i].alias(f"s{i}") for i in range(STATS)))
    row = sums.agg(*(F.avg(c).alias(f"a{c}") for c in sums.columns), *(F.stddev_pop(c).alias(f"d{c}") for c in sums.columns)).first()
    mean = np.array([row[f"as{i}"] or 0.0 for i in range(STATS)])
    spread = np.array([row[f"ds{i}"] or 0.0 for i in range(STATS)])
    kernel = Kernel(mean, np.where(spread > 1e-9, spread, 1.0))
    weights = fit_ridge(fitted, kernel)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(kernel(_matrix(batch)) @ weights), batch.column("y")], names=["raw", "y"])

    tested = learn.filter("part = 1").mapInArrow(raw, "raw double, y double")
    counts, ones = np.zeros(BINS), np.zeros(BINS)
    for b in tested.groupBy(_bin(F.col("raw")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).collect():
        counts[b.bin], ones[b.bin] = b.n, b.y
    centres, levels = isotonic(counts, ones)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rated = np.interp(kernel(_matrix(batch)) @ weights, centres, levels)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.clip(rated, 0, 1)), *(batch.column(c) for c in also)], names=["doc_id", "score", *also])

    rated = stats.mapInArrow(score, f"doc_id long, score double{further}")
    return rated.select("doc_id", *also, (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Token-id files: documents in ascending order, coded in independently reset, checksummed blocks.

Rows are dealt by ranges of doc_id and sorted within them (a range is one task and one file), encoded, and cut into blocks
of BLOCK ids, of which mixcoder codes LANES together. An id that very many rows share is dealt to several ranges, by text. A file is a Parquet table with a row per block: its place, the number of ids,
the pieces of documents that it holds, the coded ids and their CRC-32. So a file is written and committed by Spark, to
any store, and a block can be read alone. Reading decodes and checks the blocks of a file as Spark splits them; pieces of a
document from several blocks are put together by their lengths and checksums alone, so no document is gathered whole.

Defined cases: null text counts as empty, which is the end id alone; a null doc_id comes first; rows that repeat an id
follow each other, ordered by a hash of their text; an empty table gives files without blocks and an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellarium.llm import mixcoder
from cellarium.llm.bpe import default_path, vocabulary
from cellarium.llm.common import bounded_batches, cut, shared_dir, small, table

BLOCK, LANES, END_ID = 4096, 2048, 2
#: Blocks up to which the last ones of a task are coded together, as a few blocks take nearly as long as LANES.
LAST = LANES * 5 // 4
#: Bytes of text in a file, about: no more than the first, nor fewer than the second just to give every core a file.
FILE_BYTES, LEAST_BYTES = 512_000_000, 16_000_000

FILE = "part int, block int, n_ids int, doc_ids array<long>, ordinals array<long>, starts array<long>, pieces array<int>, lengths array<int>, coded binary, crc long"
FILE_ARROW = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("ordinals", pa.list_(pa.int64())),
    ("starts", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("coded", pa.binary()), ("crc", pa.int64()),
])


class _Cutter:
    """Blocks of one task's stream of documents."""

    def __init__(self) -> None:
        self.part, self.block, self.ordinal, self.start = TaskContext.get().partitionId(), 0, 0, 0
        self.full: list[tuple[np.ndarray, list[tuple]]] = []
        self.ids: list[np.ndarray] = []
        self.pieces: list[tuple] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        at = piece = 0
        while at < len(ids):
            n = min(BLOCK - self.held, len(ids) - at)
            self.ids.append(ids[at : at + n])
            self.pieces.append((doc_id, self.ordinal, self.start, piece, n))
            self.held, at, piece = self.held + n, at + n, piece + 1
            if self.held == BLOCK:
                self.close()
        self.ordinal, self.start = self.ordinal + 1, self.start + len(ids)

    def close(self) -> None:
        if self.held:
            self.full.append((np.concatenate(self.ids).astype(np.uint16), self.pieces))
            self.ids, self.pieces, self.held = [], [], 0

    def coded(self, blocks: int) -> pa.RecordBatch:
        rows, full = [], self.full[:blocks]
        for (ids, pieces), coded in zip(full, mixcoder.encode([b for b, _ in full]), strict=True):
            rows.append((self.part, self.block, len(ids), *map(list, zip(*pieces, strict=True)), coded, zlib.crc32(coded)))
            self.block += 1
        self.full = self.full[blocks:]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FILE_ARROW, strict=True)], schema=FILE_ARROW)


def write(docs: DataFrame, path: str, vocabulary_path: str, end_id: int = END_ID) -> None:
    """Files of the ids of docs(doc_id, text), each document followed by end_id."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-size // FILE_BYTES), min(size // LEAST_BYTES, spark.sparkContext.defaultParallelism))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, cutter = vocabulary(vocabulary_path), _Cutter()
        if max(len(vocab.token) - 1, end_id) >= mixcoder.NOTHING:
            raise ValueError("ids of more than 16 bits")
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cutter.add(doc_id, np.append(vocab.encode(text), np.uint32(end_id)))
                while len(cutter.full) >= LAST:
                    yield cutter.coded(LANES)
        cutter.close()
        if cutter.full:
            yield cutter.coded(LAST)

    # Equal rows may change places, so which of them a range takes doesn't matter.
    order = ["doc_id", "_text", "_row"]
    placed = rows.withColumns({"_text": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    ranges = placed.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text")
    ranges.mapInArrow(code, FILE).write.mode("errorifexists").parquet(path)


def _joined_crc(parts: list[dict]) -> int:
    """The CRC-32 of pieces that follow each other, from their own."""
    crc = parts[0]["crc"]
    for p in parts[1:]:
        nothing = bytes(4 * p["n"])
        crc = zlib.crc32(nothing, crc) ^ zlib.crc32(nothing) ^ p["crc"]
    return crc


PIECES = "part int, ordinal long, doc_id long, start long, piece int, n long, crc long"


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, small ones put together up to LAST rows."""
    held = None
    for batch in batches:
        if held is None:
            held = batch
        elif held.num_rows + batch.num_rows <= LAST:
            held = pa.concat_batches([held, batch])
        else:
            yield held
            held = batch
    if held is not None:
        yield held


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _together(batches):
        rows = batch.to_pylist()
        for r in rows:
            if zlib.crc32(r["coded"]) != r["crc"]:
                raise ValueError(f"block {r['block']} of part {r['part']} is damaged")
        out = []
        for r, ids in zip(rows, mixcoder.decode([r["coded"] for r in rows], np.array([r["n_ids"] for r in rows], np.int64)), strict=True):
            at = 0
            for doc_id, ordinal, start, piece, n in zip(r["doc_ids"], r["ordinals"], r["starts"], r["pieces"], r["lengths"], strict=True):
                out.append((r["part"], ordinal, doc_id, start, piece, n, zlib.crc32(ids[at : at + n].astype("<u4").tobytes())))
                at += n
        if out:
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = [_joined_crc(parts) for parts in batch.column("parts").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "doc_id", "local", "n_tokens")), pa.array(crc, pa.int64())], names=["part", "doc_id", "local", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files under path, decoded and checked."""
    bounded_batches(spark, LANES)
    blocks = spark.read.schema(FILE).parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each file
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    places = cut(totals.select("part", F.coalesce(before, F.lit(0)).alias("before")))
    pieces = blocks.mapInArrow(_decode, PIECES)
    part = F.struct("piece", "n", "crc")
    docs = pieces.groupBy("part", "ordinal").agg(F.min("doc_id").alias("doc_id"), F.min("start").alias("local"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(part)).alias("parts"))
    docs = docs.select("part", "doc_id", "local", "n_tokens", "parts").mapInArrow(_close, "part int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return docs.join(small(places), "part").select("doc_id", (F.col("local") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = os.path.join(shared_dir(spark), f"token-files-{uuid.uuid4().hex}")
    write(table(spark, sf_dir, "documents"), path, default_path())
    return read(spark, path)

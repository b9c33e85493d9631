"""Byte-level BPE over whole texts: a vocabulary for tasks, and encoding with reuse of content-defined chunks.

Texts are cut where a rolling hash of their bytes says so. Chunks that several texts share are encoded once and their ids
joined to each text by digest; a text that shares nothing is encoded in place and never moves. A cut may fall within a
token, so each join is repaired: the ids around it are turned back into text and encoded again, over a stretch that
grows until both of its ends are places where every encoding splits, so the result agrees exactly with the encoding of
the whole text.

Defined cases: null text counts as empty and has no ids; rows that repeat are put together once and returned each; a null doc_id is kept; an empty
table gives an empty result; other columns are ignored. All shared chunks are reused: their digests are broadcast where
there are SHARED at most, and joined by shuffle where there are more.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.llm import shingles as S
from cellarium.llm.common import bounded_batches, cut, shared_dir, shuffle_width, small, table, written

#: Bytes that the rolling hash spans, bytes between cuts on average (a power of two) and at least.
SPAN, MEAN, LEAST = 32, 2048, 256
#: Digests that are broadcast, of 16 bytes each; about 100 MB in memory.
SHARED = 1_000_000
#: ASCII's white space as spaces, and the first bytes of other white space.
SPACES, UNSURE = bytes.maketrans(b"\t\n\v\f\r", b"     "), b"\xc2\xe1\xe2\xe3"


def doubled(text: str) -> bool:
    """Whether white space follows white space."""
    data = text.encode()
    if not any(b in data for b in UNSURE):
        return b"  " in data.translate(SPACES)
    words = text.split()
    between = len(words) - 1 + text[:1].isspace() + text[-1:].isspace() if words else 1
    return len(text) - sum(map(len, words)) > between


class Vocabulary:
    """The ids of a tokenizers file of kind byte-level BPE, read once in each Python process."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splits, model = spec["pre_tokenizer"] or {}, spec["model"]
        if spec["normalizer"] or splits.get("type") != "ByteLevel" or splits["add_prefix_space"] or not splits.get("use_regex", True):
            raise ValueError(f"{path}: only byte-level splits without a normaliser and a first space are known")
        if model["type"] != "BPE" or model["dropout"] or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: only plain BPE with added tokens that keep what is beside them is known")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        sign = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(sign[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
        self.path = path
        #: The second looks ahead, which only matters where white space follows white space, and makes its matcher a third slower.
        self.single, self.fast = (tiktoken.Encoding("vocabulary", pat_str=p, mergeable_ranks=ranks, special_tokens=special) for p in (pattern, pattern.replace(r"|\s+", r"|\s+(?!\S)|\s+")))
        size = max([*ranks.values(), *special.values()]) + 1
        self.token = [b""] * size
        for token, i in [*ranks.items(), *((k.encode(), i) for k, i in special.items())]:
            self.token[i] = token
        self.text = [str(i) for i in range(size)]
        graphic = lambda b: 0x21 <= b <= 0x7E
        #: A space between two marks always starts a token of its own, whatever surrounds it.
        self.opens = np.array([len(t) > 1 and t[0] == 32 and graphic(t[1]) for t in self.token])
        self.closes = np.array([bool(t) and graphic(t[-1]) for t in self.token])

    def encode(self, text: str) -> np.ndarray:
        try:
            encoding = self.fast if doubled(text) else self.single
            return np.asarray(encoding.encode_to_numpy(text, allowed_special="all"), dtype=np.uint32)
        except BaseException as e:  # its pattern matcher gives up on some very long runs of one kind of sign
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    @property
    def plain(self):  # noqa: ANN201
        if not hasattr(self, "_plain"):
            from tokenizers import Tokenizer

            self._plain = Tokenizer.from_file(self.path)
            self._plain.no_padding()
            self._plain.no_truncation()
        return self._plain

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))

    def joined(self, parts: list[np.ndarray]) -> np.ndarray:
        """The ids of the text whose consecutive pieces have these ids."""
        parts = [p.astype(np.uint32) for p in parts if len(p)]
        settled, left = [], parts[0] if parts else np.zeros(0, np.uint32)
        for right in parts[1:]:
            reach = 8
            while True:
                tail, head = left[-reach:], right[:reach]
                opens = np.flatnonzero(self.opens[tail[1:]] & self.closes[tail[:-1]]) + 1
                ends = np.flatnonzero(self.opens[head[1:]] & self.closes[head[:-1]]) + 1
                if not len(opens) and len(tail) == len(left) and settled:
                    left = np.concatenate((settled.pop(), left))
                elif (len(opens) or len(tail) == len(left)) and (len(ends) or len(head) == len(right)):
                    break
                else:
                    reach *= 4
            a = len(left) - len(tail) + (int(opens[-1]) if len(opens) else 0)
            b = int(ends[0]) if len(ends) else len(head)
            middle = self.encode(self.decode(np.concatenate((left[a:], right[:b]))).decode("utf-8"))
            settled.append(left[:a])
            left = np.concatenate((middle, right[b:]))
        return np.concatenate([*settled, left])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(data: np.ndarray, rows: np.ndarray) -> list[list[int]]:
    """For each row its cut places, both ends among them; never within a character."""
    places: list[list[int]] = [[a, b] if b > a else [a] for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
    if len(data) <= SPAN:
        return places
    up, down = S.powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    rolling = S.mix((total[SPAN:] - total[:-SPAN]) * down[: len(data) - SPAN + 1])
    at = np.flatnonzero((rolling & np.uint64(MEAN - 1)) == 0) + SPAN
    at = at[at < len(data)]
    at = at[(data[at] & 0xC0) != 0x80]
    owner = np.searchsorted(rows, at, side="right") - 1
    for row, place in zip(owner.tolist(), at.tolist(), strict=True):
        # A span must lie within its row, or the cut would depend on the row before.
        if place - SPAN >= rows[row] and place - places[row][-2] >= LEAST and place < rows[row + 1]:
            places[row].insert(-1, place)
    return places


CHUNKS = "doc_id long, text_key binary, text_row long, last int, pos int, chunk_a long, chunk_b long, chunk string"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys, numbers = (batch.column(i).to_pylist() for i in range(3))
        for first, data, rows in S.blocks(batch.column(3)):
            raw, out = data.tobytes(), []
            for i, places in enumerate(cuts(data, rows)):
                if len(places) == 1:
                    places = places * 2
                for pos, (a, b) in enumerate(zip(places[:-1], places[1:], strict=True)):
                    piece = raw[a:b]
                    digest = hashlib.blake2b(piece, digest_size=16).digest()
                    out.append((ids[first + i], keys[first + i], numbers[first + i], len(places) - 2, pos, int.from_bytes(digest[:8], "little", signed=True),
                                int.from_bytes(digest[8:], "little", signed=True), piece.decode("utf-8")))
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            names = [c.split()[0] for c in CHUNKS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
DONE = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(vocab: Vocabulary, ids: np.ndarray) -> tuple[int, str, str]:
    decoded = vocab.decode(ids).decode("utf-8", errors="replace")
    listed = ",".join(map(vocab.text.__getitem__, ids.tolist()))
    return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()


def _stretches(vocab: Vocabulary, rows: list[dict], finish: Callable) -> Iterator[tuple]:
    """A text's rows of chunks: its result if none is shared, else ids of each unshared stretch and the shared digests."""
    head = tuple(rows[0][c] for c in ("doc_id", "text_key", "text_row"))
    if not any(r["shared"] for r in rows):
        yield *head, None, None, None, None, *finish(vocab, vocab.encode("".join(r["chunk"] for r in rows)))
        return
    rest = (None,) * len(finish(vocab, np.zeros(0, np.uint32)))
    for known, group in groupby(rows, key=lambda r: bool(r["shared"])):
        if known:
            yield from ((*head, r["pos"], r["chunk_a"], r["chunk_b"], None, *rest) for r in group)
        else:
            group = list(group)
            yield *head, group[0]["pos"], None, None, vocab.encode("".join(r["chunk"] for r in group)).astype("<u4").tobytes(), *rest


def encode_chunked(docs: DataFrame, path: str, finish: Callable = digests, done: str = DONE) -> DataFrame:
    """doc_id and finish(vocabulary, ids) for every row of docs(doc_id, text); `done` is the schema of what finish returns."""
    spark = docs.sparkSession
    shared_dir(spark)
    bounded_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    pieces = docs.select(F.col("doc_id").cast("long"), F.unhex(F.md5(text)).alias("text_key"), F.monotonically_increasing_id(), text.alias("text")).mapInArrow(_chunks, CHUNKS)
    # A text that repeats its own chunk shares it with itself.
    counts = pieces.filter("chunk <> ''").groupBy("chunk_a", "chunk_b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    common = cut(counts.select("chunk_a", "chunk_b", F.lit(True).alias("shared")))
    few = common.limit(SHARED + 1).count() <= SHARED
    marked = pieces.join(F.broadcast(common) if few else common, ["chunk_a", "chunk_b"], "left")
    if not few:
        marked = marked.repartition(shuffle_width(spark), "text_row").sortWithinPartitions("text_row", "pos")
    names = [c.split()[0] for c in done.split(", ")]

    def in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A broadcast join keeps the order of its streamed side, and the other one is sorted, so a text's chunks follow each other.
        vocab, held = vocabulary(path), []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["pos"] != len(held):
                    raise ValueError("the chunks of a text are out of order")
                held.append(row)
                if row["pos"] == row["last"]:
                    out += _stretches(vocab, held, finish)
                    held = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=fields)

    schema = f"doc_id long, text_key binary, text_row long, pos int, chunk_a long, chunk_b long, ids binary, {done}"
    fields, kinds = [c.split()[0] for c in schema.split(", ")], [ARROW[c.split()[1]] for c in schema.split(", ")]
    stretches = written(marked.mapInArrow(in_place, schema), "stretches")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            ids = [vocab.encode(t).astype("<u4").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], names=["chunk_a", "chunk_b", "known"])

    distinct = marked.filter("shared").select("chunk_a", "chunk_b", "chunk").distinct()
    known = distinct.mapInArrow(once, "chunk_a long, chunk_b long, known binary")
    # Of rows that repeat, the first one's parts are put together for all, so a group has the parts of one text however often it occurs.
    again = stretches.filter("pos = 0").groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.min("text_row").alias("first"), F.count(F.lit(1)).alias("times"))
    again = small(cut(again.filter("times > 1")))
    parts = stretches.filter("pos IS NOT NULL").join(again, (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    parts = parts.filter("first IS NULL OR first = text_row").join(known, ["chunk_a", "chunk_b"], "left")
    part = F.struct("pos", F.coalesce("ids", "known").alias("ids"))
    texts = parts.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.coalesce(F.max("times"), F.lit(1)).alias("times"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                ids = vocab.joined([np.frombuffer(p["ids"], "<u4") for p in row["parts"]])
                out.append((row["times"], row["doc_id"], *finish(vocab, ids)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), *kinds[7:]], strict=True)], names=["times", "doc_id", *names])

    joined = texts.select("doc_id", "parts", "times").mapInArrow(assemble, f"times long, doc_id long, {done}")
    joined = joined.withColumn("_time", F.explode(F.sequence(F.lit(1), "times"))).select("doc_id", *names)
    return stretches.filter("pos IS NULL").select("doc_id", *names).union(joined)


def op4_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_chunked(table(spark, sf_dir, "documents"), default_path())

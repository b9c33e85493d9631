"""Language-model scores by deleted interpolation of word bigrams, word counts and a uniform share.

Documents are dealt to buckets by hash. A bucket packs the hashes of its distinct words and word pairs, sorted, with
their training counts, into one row for each key range; a range adds up the counts of all buckets and answers each with
the totals of its keys, in the order in which it asked. So counts of the whole corpus meet by shuffle only, in rows of
packed numbers, and a frequent word is one number per bucket.

The mixture weights of each context-frequency class come from expectation-maximisation over the deleted part (every
tenth bucket), with counts that leave that part out. Its tokens are reduced to a histogram over class and quarter-octave
steps of the two estimates, which has at most some 170,000 cells whatever the corpus.

Defined cases: null text counts as empty, which is one token (the end); a null doc_id counts as held out; rows that
repeat count and are scored each; without training documents the model is uniform; an empty table gives an empty result;
other columns are ignored. Words are told apart by 55 bits of their hashes.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.llm import shingles as S
from cellarium.llm.common import shared_dir, table, written
from cellarium.llm.quality import remainder

#: Characters of text in a bucket and behind a key range, about; both keep a task's arrays under 200 MB.
BUCKET_CHARS, RANGE_CHARS = 8_000_000, 24_000_000
HELD_OUT, DELETED, DELETED_REST = 10, 10, 3
CLASSES, STEP, ROUNDS = 24, 4, 60
KEY_BITS = 56
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers below 2**56 as byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].T.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(7, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :7] = planes.T
    return out.view("<u8").reshape(-1).astype(np.uint64)


class Tokens:
    """The tokens of a bucket's texts: keys of words and of pairs at each place, and the row of each place."""

    def __init__(self, texts: pa.Array) -> None:
        single, pair, row = [], [], []
        for first, data, rows in S.blocks(texts):
            hashes, word_rows = S.words(data, rows)
            n = np.diff(word_rows)
            tokens = np.insert(hashes, word_rows[1:], END)
            before = np.insert(hashes, word_rows[:-1], BEGIN)
            single.append(self.key(tokens, 0))
            pair.append(self.key(S.mix(before * S.BASE + np.uint64(1)) ^ tokens, 1))
            row.append(first + np.repeat(np.arange(len(n)), n + 1))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.single, self.pair, self.row = join(single, np.uint64), join(pair, np.uint64), join(row, np.int64)
        self.keys, at = np.unique(np.concatenate((self.single, self.pair)), return_inverse=True)
        self.single_at, self.pair_at = at[: len(self.single)], at[len(self.single) :]

    @staticmethod
    def key(hashes: np.ndarray, kind: int) -> np.ndarray:
        return (S.mix(hashes) >> np.uint64(64 - KEY_BITS)) & ~np.uint64(1) | np.uint64(kind)

    def ranges(self, parts: int) -> np.ndarray:
        """Where each key range begins among the sorted keys."""
        edges = [min((p << KEY_BITS) // parts, (1 << KEY_BITS) - 1) for p in range(1, parts)]
        return np.concatenate(([0], np.searchsorted(self.keys, np.array(edges, dtype=np.uint64)), [len(self.keys)]))


def _text(group: pa.Table) -> pa.Array:
    return pa.concat_arrays([c.cast(pa.large_string()) for c in group.column("text").chunks])


ASKED = "bucket long, part int, keys binary, counts binary"


def _asker(parts: int):  # noqa: ANN202
    def ask(group: pa.Table) -> pa.Table:
        tokens = Tokens(_text(group))
        train = ~group.column("held_out").to_numpy()
        weight = train[tokens.row]
        counts = np.bincount(tokens.single_at[weight], minlength=len(tokens.keys)) + np.bincount(tokens.pair_at[weight], minlength=len(tokens.keys))
        at = tokens.ranges(parts)
        some = [p for p in range(parts) if at[p + 1] > at[p]]
        step = lambda k: np.diff(k, prepend=k[:1])
        rows = [(tokens.keys[at[p] : at[p + 1]], counts[at[p] : at[p + 1]]) for p in some]
        return pa.table({
            "bucket": pa.array([group.column("bucket")[0].as_py()] * len(some), pa.int64()), "part": pa.array(some, pa.int32()),
            "keys": pa.array([int(k[0]).to_bytes(8, "little") + _packed(step(k)) for k, _ in rows], pa.binary()),
            "counts": pa.array([_packed(c) for _, c in rows], pa.binary()),
        })

    return ask


ANSWER = "bucket long, part int, totals binary, rest binary, words long, tokens long"


def _answer(group: pa.Table) -> pa.Table:
    """For each bucket the corpus counts of the keys it sent, all and without the deleted part; one more row has the sums."""
    buckets = group.column("bucket").to_pylist()
    keys = []
    for data in group.column("keys").to_pylist():
        keys.append(np.uint64(int.from_bytes(data[:8], "little")) + np.cumsum(_unpacked(data[8:])))
    counts = [_unpacked(c).astype(np.int64) for c in group.column("counts").to_pylist()]
    sizes = [len(k) for k in keys]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    each = np.concatenate(counts)
    total = np.bincount(at, weights=each, minlength=len(distinct)).astype(np.int64)
    deleted = np.repeat([b % DELETED == DELETED_REST for b in buckets], sizes)
    rest = total - np.bincount(at[deleted], weights=each[deleted], minlength=len(distinct)).astype(np.int64)
    part, out, first = group.column("part")[0].as_py(), [], 0
    for bucket, size in zip(buckets, sizes, strict=True):
        mine = at[first : first + size]
        out.append((bucket, part, _packed(total[mine]), _packed(rest[mine]) if bucket % DELETED == DELETED_REST else None, None, None))
        first += size
    word = (distinct & np.uint64(1)) == 0
    out.append((-1, part, None, None, int((total[word] > 0).sum()), int(total[word].sum())))
    out.append((-2, part, None, None, int((rest[word] > 0).sum()), int(rest[word].sum())))
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    names = [c.split()[0] for c in ANSWER.split(", ")]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


class Model:
    """Estimates at every place of a bucket, from its tokens and the corpus counts of their keys."""

    def __init__(self, tokens: Tokens, counts: np.ndarray, words: int, total: int) -> None:
        self.count = counts[tokens.single_at]
        context = np.empty_like(self.count)
        context[1:] = self.count[:-1]
        first = np.flatnonzero(np.diff(tokens.row, prepend=-1))
        # A text begins as often as one ends.
        context[first] = self.count[np.flatnonzero(np.diff(tokens.row, append=-1))]
        self.pair = np.where(context > 0, counts[tokens.pair_at] / np.maximum(context, 1), 0.0)
        self.single = self.count / max(total, 1)
        self.uniform = 1.0 / (words + 1)
        self.kind = np.minimum(np.ceil(np.log2(context + 1)), CLASSES - 1).astype(np.int64)


def _answers(group: pa.Table, column: str) -> np.ndarray:
    rows = sorted(zip(group.column("part").to_pylist(), group.column(column).to_pylist(), strict=True))
    return np.concatenate([_unpacked(r) for _, r in rows]).astype(np.float64)


def _steps(ratio: np.ndarray) -> np.ndarray:
    """0 for nothing, else quarter octaves over 2**-8."""
    with np.errstate(divide="ignore"):
        return np.where(ratio > 0, np.clip(np.rint(STEP * np.log2(ratio)) + 33, 1, 255), 0).astype(np.int64)


def _histogram(words: int, total: int):  # noqa: ANN202
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows or not answers.num_rows:
            return pa.table({"cell": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        tokens = Tokens(_text(docs))
        model = Model(tokens, _answers(answers, "rest"), words, total)
        use = (~docs.column("held_out").to_numpy())[tokens.row]
        cell = (model.kind << 16) | (_steps(model.pair / model.uniform) << 8) | _steps(model.single / model.uniform)
        cells, n = np.unique(cell[use], return_counts=True)
        return pa.table({"cell": cells, "n": n})

    return run


def mixture(cells: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of the pair, word and uniform estimates for each class of contexts, by expectation-maximisation."""
    kind, pair, single = cells >> 16, (cells >> 8) & 255, cells & 255
    level = lambda q: np.where(q > 0, 2.0 ** ((q - 33) / STEP), 0.0)
    estimate = np.column_stack([level(pair), level(single), np.ones(len(cells))])
    weight = np.tile([0.4, 0.4, 0.2], (CLASSES, 1))
    for _ in range(ROUNDS):
        share = weight[kind] * estimate
        share *= (n / share.sum(axis=1))[:, None]
        # A little of each keeps every text possible, and is all that a class without tokens has.
        new = np.column_stack([np.bincount(kind, weights=share[:, i], minlength=CLASSES) for i in range(3)]) + [0.5, 0.5, 0.5]
        weight = new / new.sum(axis=1, keepdims=True)
    return weight


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scorer(words: int, total: int, weight: np.ndarray):  # noqa: ANN202
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        n = docs.num_rows
        tokens = Tokens(_text(docs)) if n else None
        if not n:
            return pa.table({c.split()[0]: [] for c in SCORED.split(", ")}).cast(SCORED_ARROW)
        model = Model(tokens, _answers(answers, "totals"), words, total)
        w = weight[model.kind]
        p = w[:, 0] * model.pair + w[:, 1] * model.single + w[:, 2] * model.uniform
        base = np.log10((model.count + 0.1) / (total + 0.1 * (words + 1)))
        add = lambda x: np.bincount(tokens.row, weights=x, minlength=n)
        return pa.table([
            docs.column("doc_id"), docs.column("held_out"), np.bincount(tokens.row, minlength=n), add(model.count > 0).astype(np.int64),
            np.full(n, total, np.int64), add(base), add(np.log10(p)),
        ], schema=SCORED_ARROW)

    return run


SCORED_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def language_model_scores(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """The SCORED columns for every row of docs(doc_id, text), learnt from the rows that aren't held out."""
    spark = docs.sparkSession
    shared_dir(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    chars = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets, parts = max(DELETED * 2, -(-chars // BUCKET_CHARS)), max(8, -(-chars // RANGE_CHARS))
    held = remainder(F.col("doc_id"), HELD_OUT) == 0 if held_out is None else held_out
    dealt = docs.select(F.col("doc_id").cast("long"), text.alias("text"), held.alias("held_out"))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)))
    asked = dealt.groupBy("bucket").applyInArrow(_asker(parts), ASKED)
    answers = written(asked.groupBy("part").applyInArrow(_answer, ANSWER), "ngram-counts")
    sums = {r.bucket: (r.words or 0, r.tokens or 0) for r in answers.filter("bucket < 0").groupBy("bucket").agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).collect()}
    (words, total), rest = sums.get(-1, (0, 0)), sums.get(-2, (0, 0))
    answers = answers.filter("bucket >= 0")
    part = F.col("bucket") % DELETED == DELETED_REST
    cells = dealt.filter(part).groupBy("bucket").cogroup(answers.filter(part).groupBy("bucket")).applyInArrow(_histogram(*rest), "cell long, n long")
    rows = cells.groupBy("cell").agg(F.sum("n").alias("n")).collect()  # CLASSES * 255 * 255 cells at most, by far fewer occur
    weight = mixture(np.array([r.cell for r in rows], np.int64), np.array([r.n for r in rows], np.float64))
    return dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_scorer(words, total, weight), SCORED)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))

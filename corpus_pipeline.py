"""The corpus pipeline: quality filter, exact and near deduplication, then packing into training sequences.

Each stage takes (spark, docs, sf_dir), with docs shaped as the table documents, and works on all that its predecessor
kept. Stages decide by row: they drop by doc_id and text (null ids are ids here), through an anti join with the keys of
the dropped rows (broadcast only if they are few), so the texts that stay aren't shuffled, and rows that share an id or
have none are dropped for their own texts only. The near-duplicate stage drops by doc_id alone where ids are unique; else
it numbers the rows. The table labels is read from sf_dir. Null and empty texts, further columns and empty tables are
handled as the operators' docstrings say; further columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.llm.bpe import default_path
from cellarium.llm.common import BROADCAST_ROWS, cut, small, table, written
from cellarium.llm.exact_dedup import exact_dedup, normalised
from cellarium.llm.minhash import near_duplicates
from cellarium.llm.packing import pack
from cellarium.llm.quality import quality_scores


#: Keys with a digest are broadcast up to this many.
FEW = BROADCAST_ROWS // 4


def _id(docs: DataFrame) -> Column:
    return docs["doc_id"].cast("long")


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _matched(docs: DataFrame, keys: DataFrame, digest: Column, how: str) -> DataFrame:
    """The rows of docs whose id and digest are (left_semi) or are not (left_anti) in keys(doc_id, digest)."""
    key, sign = _free(docs, "_id"), _free(docs, "_digest")
    found = small(cut(keys.select(F.col("doc_id").alias(key), F.col("digest").alias(sign)).distinct()), FEW)
    return docs.join(found, _id(docs).eqNullSafe(F.col(key)) & (digest == F.col(sign)), how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    digest = _digest(docs["text"])
    scores = quality_scores(docs.select("doc_id", "text", digest.alias("digest")), table(spark, sf_dir, "labels"), ["digest"])
    return _matched(docs, scores.filter("predicted = 0"), digest, "left_anti")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, with the smallest id; among rows that repeat it, the same one in each run."""
    digest = F.sha2(normalised(docs["text"]), 256)
    shared = exact_dedup(docs).filter("group_size > 1").select("doc_id", "kept", F.col("text_sha256").alias("digest"))
    shared = written(shared, "copies")
    left = _matched(docs, shared.filter("NOT kept"), digest, "left_anti")
    repeated = cut(shared.filter("kept").groupBy("doc_id", "digest").count().filter("count > 1"))
    if repeated.limit(1).count() == 0:
        return left
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns))
    again = _matched(docs, repeated, digest, "left_semi").groupBy(_id(docs).alias("_id"), digest.alias("_digest"))
    again = again.agg(F.min_by(row, F.sha2(F.to_json(row), 256)).alias("_row")).select("_row.*")
    return _matched(left, repeated, digest, "left_anti").unionByName(again)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    out, key, sign, row = (_free(docs, n) for n in ("_gone", "_id", "_digest", "_row"))
    ids = docs.select(_id(docs).alias("doc_id")).groupBy("doc_id").count()
    if ids.filter("count > 1 OR doc_id IS NULL").limit(1).count() == 0:
        gone = small(cut(near_duplicates(docs).filter("NOT kept").select(F.col("doc_id").alias(out))))
        return docs.join(gone, _id(docs) == F.col(out), "left_anti")
    # Texts are numbered in the order of their ids, so that each has its own id and the smallest is still the first.
    digest = _digest(docs["text"])
    keys = docs.select(_id(docs).alias(key), digest.alias(sign)).distinct().orderBy(F.asc_nulls_last(key), sign)
    keys = cut(keys.withColumn(row, F.monotonically_increasing_id()))
    rows = written(docs.join(keys, _id(docs).eqNullSafe(F.col(key)) & (digest == F.col(sign))).drop(key, sign), "numbered")
    found = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"))
    gone = small(cut(found.filter("NOT kept").select(F.col("doc_id").alias(out)).distinct()))
    return rows.join(gone, F.col(row) == F.col(out), "left_anti").drop(row)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    return pack(docs, default_path())


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("MinHash near-dedup", near), ("packing", packing)]

#: Classifier scores can't be expressed in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

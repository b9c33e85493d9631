"""Exact dedup by content-defined chunk recipes, in DataFrame operations only.

Each normalised text is cut where its own content says so (after sentence marks), each chunk is replaced by a 128-bit
identifier, and texts are compared by their ordered lists of identifiers (recipes). Only chunks of texts whose recipes
agree are then compared byte by byte, deduplicated before they move, so no document is shuffled as a whole and a unique
one not at all. Texts of recipes with an identifier that stands for two chunks are compared themselves.

Defined cases: null text counts as empty; empty texts equal each other; a null doc_id never wins over another id and
stays only in a group of null ids; rows that repeat an id and a text are all marked kept if their id stays. Further
columns of the input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.llm.common import cut, shared_dir, small, table, written

#: Characters before a chunk may end at a sentence mark, and at which it ends in any case.
CHUNK_LEAST, CHUNK_MOST = 192, 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def chunks(text: Column) -> Column:
    """Consecutive pieces that make up the text; an edit changes the pieces around it only."""
    piece = rf"(?s).{{{CHUNK_LEAST},{CHUNK_MOST}}}?[.!?;|] |.{{1,{CHUNK_MOST}}}"
    return F.regexp_extract_all(text, F.lit(piece), F.lit(0))


def identified(text: Column) -> Column:
    """The recipe of a text: 128-bit identifiers of its chunks, in order."""
    return F.transform(chunks(text), lambda c: F.unhex(F.md5(c)))


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256, text_key (64-bit, of the whole text) and recipe of every row."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm"))
    return text.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), F.xxhash64("norm").alias("text_key"), identified(F.col("norm")).alias("recipe"))


def collisions(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Identifiers (id) that stand for more than one chunk among the texts whose text_key is in keys."""
    text = docs.select(normalised(F.col("text")).alias("norm"))
    text = text.withColumn("text_key", F.xxhash64("norm")).join(small(keys), "text_key", "left_semi")
    distinct = text.select(F.explode(chunks(F.col("norm"))).alias("chunk")).groupBy("chunk").agg(F.lit(1).alias("one"))
    return distinct.groupBy(F.unhex(F.md5("chunk")).alias("id")).count().filter("count > 1").select("id")


RESULT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _settled(rows: DataFrame, groups: DataFrame, by: str) -> DataFrame:
    """RESULT of rows, from groups(by, keep_id, group_size) of more than one row; other rows stand alone."""
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    return rows.join(groups, by, "left").select("doc_id", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs(doc_id, text)."""
    shared_dir(docs.sparkSession)
    rows = written(recipes(docs), "recipes")
    # A recipe's group is found by its hash and settled by the recipe itself, as both are grouping keys.
    groups = rows.groupBy("recipe").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"),
        F.min("text_key").alias("key_a"), F.max("text_key").alias("key_b"),
    )
    shared = cut(groups.filter("group_size > 1"))
    # Texts with equal recipes are equal if no identifier of theirs stands for two chunks. With one text_key in a group its
    # members are found by it; the largest and smallest are enough to see that a group has two.
    found = cut(collisions(docs, cut(shared.filter("key_a = key_b").select(F.col("key_a").alias("text_key")).distinct())))
    mixed = shared.filter("key_a <> key_b").select("recipe")
    doubtful = shared.select("recipe", F.explode("recipe").alias("id")).join(found, "id", "left_semi").select("recipe")
    doubtful = cut(mixed.union(doubtful).distinct())
    back = shared.select("recipe", "keep_id", "group_size")
    if doubtful.limit(1).count() == 0:
        return _settled(rows, back, "recipe")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm"))
    text = text.withColumns({"text_sha256": F.sha2("norm", 256), "recipe": identified(F.col("norm"))}).join(doubtful, "recipe", "left_semi")
    same = text.groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    clear = _settled(rows.join(doubtful, "recipe", "left_anti"), back, "recipe")
    return clear.unionByName(_settled(text, same, "norm"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""

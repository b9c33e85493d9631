"""Reports of any size as documents: a row of a frame is a variant value, written and read by executors.

A report is a table partitioned by section, with `place` (increasing in the frame's order) and `body`. Nothing passes through the
driver but what was no frame. Types that JSON lacks (dates, timestamps, decimals, binary) are kept.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

NAME = re.compile(r"\w[\w.-]*")


def bodies(df: DataFrame) -> DataFrame:
    """place and body of each row of df. Duplicate column names are refused, as a document holds one value for a name."""
    if len(set(df.columns)) < len(df.columns):
        raise ValueError(f"columns occur twice: {sorted({c for c in df.columns if df.columns.count(c) > 1})}")
    fields = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
    return df.select(F.monotonically_increasing_id().alias("place"), F.to_variant_object(F.struct(*fields)).alias("body"))


def write(found: dict[str, object], spark: SparkSession, path: str) -> None:
    """Writes a report to a new folder in one job: frames as a document a row, anything else as one document of its JSON form."""
    parts = []
    for name, value in found.items():
        if not NAME.fullmatch(name):
            raise ValueError(f"{name!r} is no name of a section")
        if isinstance(value, DataFrame):
            rows = bodies(value)
        else:
            text = json.dumps(value, ensure_ascii=False, default=str)
            rows = spark.range(1).select(F.lit(0).cast("long").alias("place"), F.parse_json(F.lit(text)).alias("body"))
        parts.append(rows.select(F.lit(name).alias("section"), "place", "body"))
    if not parts:
        raise ValueError("a report has at least one section")
    reduce(DataFrame.unionAll, parts).write.partitionBy("section").parquet(path)


def report(spark: SparkSession, path: str) -> DataFrame:
    """section, place and body of all documents."""
    return spark.read.schema("place long, body variant, section string").parquet(path)


def section(spark: SparkSession, path: str, name: str, schema: StructType | str | None = None) -> DataFrame:
    """The rows of a section as a frame, in no particular order. Without a schema, one is found by a pass over the section; a section
    without rows then has no columns. What has not the type asked for is an error."""
    rows = report(spark, path).filter(F.col("section") == name)
    if schema is None:
        seen = rows.agg(F.schema_of_variant_agg("body").alias("s")).first().s
        if seen == "VOID":
            return spark.createDataFrame([], StructType())
        if not seen.startswith("OBJECT<"):
            return rows.select("body")
        schema = re.sub(r"\bOBJECT<", "STRUCT<", seen)
    kind = schema if isinstance(schema, StructType) or schema.startswith("STRUCT<") else StructType.fromDDL(schema)
    return rows.select(F.col("body").cast(kind).alias("body")).select("body.*")


def json_lines(spark: SparkSession, path: str, out: str) -> None:
    """The documents as text files with a line of JSON each, in a folder a section."""
    report(spark, path).select(F.to_json("body").alias("value"), "section").write.partitionBy("section").text(out)

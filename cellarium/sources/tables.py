"""Text tables with row numbers, folders of them, and JSON and HTML results."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellarium.operators import cleaning as C


def numbered(df: DataFrame, name: str = "row_no", first: int = 1) -> DataFrame:
    """df with consecutive row numbers in file order: places within partitions, plus what comes before each partition."""
    df = df.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    sizes = df.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    out = df.withColumn("_p", part).join(F.broadcast(before), "_p")  # a row per partition
    return out.withColumn(name, F.col("_b") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + first).drop("_id", "_p", "_b")


def csv_grid(spark: SparkSession, path: str, sep: str = ",") -> tuple[DataFrame, list[str]]:
    """All cells as text: the body as a grid, and the headers."""
    raw = spark.read.csv(path, header=False, inferSchema=False, sep=sep, encoding="UTF-8", multiLine=False)
    rows = numbered(raw.toDF(*(f"c{i}" for i in range(len(raw.columns)))))
    head = rows.filter("row_no = 1").first()
    return rows.filter("row_no > 1"), [(head[f"c{i}"] or "") if head else "" for i in range(len(raw.columns))]


def named(grid: DataFrame, headers: list[str]) -> DataFrame:
    return grid.select(*(F.col(f"c{i}").alias(h) for i, h in enumerate(headers)), "row_no")


def sales_folder(spark: SparkSession, paths: list[str], override: dict[str, str] | None = None) -> tuple[C.Loaded, list[tuple[str, str]]]:
    """Sales of several CSV files; a file without the needed columns, or with ambiguous dates, is skipped and listed."""
    loaded, skipped = [], []
    for path in sorted(paths):
        try:
            loaded.append(C.load_sales(named(*csv_grid(spark, path)), path, override))
        except (C.MissingRole, C.AmbiguousDates) as e:
            skipped.append((path, str(e)))
    if not loaded:
        empty = spark.createDataFrame([], C.SALES)
        return C.Loaded(empty, spark.createDataFrame([], "source_file string, source_row long, reason string")), skipped
    accepted, discarded = loaded[0].accepted, loaded[0].discarded
    for more in loaded[1:]:
        accepted, discarded = accepted.unionByName(more.accepted), discarded.unionByName(more.discarded)
    return C.Loaded(accepted, discarded), skipped


def artifact(found: dict[str, object]) -> str:
    """A small report as JSON in one text: frames become lists of rows. `documents.write` takes reports of any size."""
    rows = lambda v: [r.asDict(recursive=True) for r in v.collect()] if isinstance(v, DataFrame) else v
    return json.dumps({k: rows(v) for k, v in found.items()}, ensure_ascii=False, default=str, indent=1)


def page(title: str, found: dict[str, object], most: int = 1000) -> str:
    """A report as an HTML page of tables, without scripts: the first rows of each frame, at most `most`, and how many there are if
    those aren't all."""
    parts = [f"<h1>{html.escape(title)}</h1>"]
    for name, v in found.items():
        parts.append(f"<h2>{html.escape(name)}</h2>")
        if isinstance(v, DataFrame):
            rows = v.limit(most + 1).collect()
            if len(rows) > most:
                rows = rows[:most]
                parts.append(f"<p>{most} of {v.count()} rows</p>")
            head = "".join(f"<th>{html.escape(c)}</th>" for c in v.columns)
            parts.append(f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{html.escape(str(x))}</td>" for x in r) + "</tr>" for r in rows) + "</table>")
        else:
            parts.append(f"<p>{html.escape(str(v))}</p>")
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body>{"".join(parts)}</body></html>'

"""Any table as long rows: structure, un-pivoting with lineage, column roles, indicators, a dashboard's views.

A grid is a DataFrame of text cells c0, c1, ... with row_no (the header is row 1, the body begins at 2) and its headers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellarium.operators.cleaning import dotted_number, plain, table_number

# Words of total rows and of column names, and the names of the canonical columns.
GRAND_TOTAL = ("total geral", "grand total")
ENTITY_WORDS = {"cnpj", "cpf", "id", "codigo", "documento"}
TIME_WORDS = {"data", "date", "mes", "ano", "periodo"}
BUSINESS_ROLES = {"cnpj": "merchant_document", "cpf": "person_document", "status": "proposal_status", "quantidade": "record_count"}
STATUS, MEASURE, CHILD = "status", "quantidade", "subgrupo"
CATEGORIES, TOP, CONCENTRATED = 20, 15, 0.5
#: Rows of one stretch of a running window.
STRETCH = 100_000


def column_letters(i: int) -> str:
    letters = ""
    while i >= 0:
        letters, i = chr(65 + i % 26) + letters, i // 26 - 1
    return letters


def filled(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def carried(df: DataFrame, value: str, order: str, name: str, inclusive: bool) -> DataFrame:
    """df with the last non-null value at or before (or only before) each row. Windows run within stretches of rows; what
    enters a stretch comes from a small table with a row per stretch."""
    df = df.withColumn("_s", F.floor(F.col(order) / STRETCH))
    ends = df.groupBy("_s").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_end"))
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_s", F.last("_end", ignorenulls=True).over(before).alias("_in"))
    within = Window.partitionBy("_s").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = df.withColumn(name, F.last(value, ignorenulls=True).over(within)).join(ends, "_s", "left")
    return out.withColumn(name, F.coalesce(name, "_in")).drop("_s", "_in")


@dataclass
class Long:
    """The long table with its lineage, the rows left out with the reason, and what was found."""

    kind: str
    rows: DataFrame
    discarded: DataFrame
    context: DataFrame
    dimensions: list[str]
    measures: list[str] = field(default_factory=list)

    def closure(self, total: int) -> bool:
        """Rows read are those emitted, those that name a group and those discarded."""
        return total == self.rows.select("origin_row").distinct().count() + self.context.count() + self.discarded.count()


def measure_columns(body: DataFrame, n: int) -> list[int]:
    """Columns whose every filled cell is a number, from one aggregate over all."""
    checks = []
    for i in range(n):
        c = F.col(f"c{i}")
        checks += [F.count_if(filled(c)).alias(f"n{i}"), F.count_if(filled(c) & table_number(c).isNull()).alias(f"t{i}")]
    seen = body.agg(*checks).first()
    return [i for i in range(n) if seen[f"n{i}"] and not seen[f"t{i}"]]


def long_table(grid: DataFrame, headers: list[str]) -> Long:
    """The canonical long form of a flat, wide or nested table."""
    n = len(headers)
    first = F.lower(F.trim("c0"))
    grand = F.coalesce(filled(F.col("c0")) & F.greatest(*(F.instr(first, t) > 0 for t in GRAND_TOTAL)), F.lit(False))
    empty = ~F.greatest(*(F.coalesce(filled(F.col(f"c{i}")), F.lit(False)) for i in range(n))) if n > 1 else ~F.coalesce(filled(F.col("c0")), F.lit(False))
    body = grid.withColumn("reason", F.when(empty, "empty").when(grand, "grand_total"))
    measures = measure_columns(body.filter("reason IS NULL"), n)
    nested = _nested(body, measures) if measures else None
    if nested is not None:
        return _long_nested(nested, headers, measures)
    dims = [i for i in range(n) if i not in measures]
    gone = body.filter("reason IS NOT NULL").select(F.col("row_no").alias("origin_row"), "reason")
    kept = body.filter("reason IS NULL")
    names = [headers[i] for i in dims]
    if len(measures) >= 2:
        none = ~F.greatest(*(F.coalesce(filled(F.col(f"c{i}")), F.lit(False)) for i in measures))
        gone = gone.unionByName(kept.filter(none).select(F.col("row_no").alias("origin_row"), F.lit("no_measures").alias("reason")))
        rows = _unpivot(kept, headers, dims, measures)
        return Long("wide", rows, gone, body.limit(0).select("row_no"), [*names, STATUS], [MEASURE])
    values = [table_number(F.col(f"c{i}")).alias(headers[i]) for i in measures]
    cells = F.create_map(*(x for i in range(n) for x in (F.lit(headers[i]), F.concat(F.lit(column_letters(i)), F.col("row_no").cast("string")))))
    rows = kept.select(F.col("row_no").alias("origin_row"), *(F.col(f"c{i}").alias(headers[i]) for i in dims), *values, cells.alias("origin_cells"))
    return Long("flat", rows, gone, body.limit(0).select("row_no"), names, [headers[i] for i in measures])


def _unpivot(rows: DataFrame, headers: list[str], dims: list[int], measures: list[int], extra: dict[str, Column] | None = None, places: dict[str, Column] | None = None) -> DataFrame:
    entries = F.array(*(F.struct(F.lit(headers[i]).alias(STATUS), table_number(F.col(f"c{i}")).alias(MEASURE), F.lit(column_letters(i)).alias("letter")) for i in measures))
    own = {headers[i]: F.col(f"c{i}") for i in dims} | (extra or {})
    at = F.col("row_no").cast("string")
    where = {headers[i]: F.concat(F.lit(column_letters(i)), at) for i in dims} | (places or {})
    where |= {STATUS: F.concat(F.col("letter"), F.lit("1")), MEASURE: F.concat(F.col("letter"), at)}
    out = rows.select("*", F.inline(F.filter(entries, lambda e: e[MEASURE].isNotNull())))
    return out.select(F.col("row_no").alias("origin_row"), *(c.alias(k) for k, c in own.items()), STATUS, MEASURE, F.create_map(*(x for k, v in where.items() for x in (F.lit(k), v))).alias("origin_cells"))


def _nested(body: DataFrame, measures: list[int]) -> DataFrame | None:
    """The body with the group of each row, if a row that only names a group is followed by a row of its own."""
    bare = ~F.greatest(F.lit(False), *(F.coalesce(filled(F.col(f"c{i}")), F.lit(False)) for i in measures))
    named = F.col("reason").isNull() & filled(F.col("c0"))
    total = F.coalesce(F.instr(F.lower("c0"), "total") > 0, F.lit(False))
    rows = body.withColumn("_p", F.when(named & bare & ~total, F.trim("c0")))
    rows = carried(rows, "_p", "row_no", "_before", inclusive=False)
    subtotal = named & (total | F.coalesce(F.trim("c0") == F.col("_before"), F.lit(False)))
    rows = rows.withColumn("reason", F.when(subtotal, "subtotal").otherwise(F.col("reason")))
    parent = F.col("reason").isNull() & F.col("_p").isNotNull()
    rows = rows.withColumns({"is_parent": parent, "_g": F.when(parent, F.struct(F.col("c0").alias("name"), F.col("row_no").alias("row")))})
    rows = carried(rows, "_g", "row_no", "grp", inclusive=True).drop("_p", "_before", "_g")
    child = F.col("reason").isNull() & ~F.col("is_parent") & F.col("grp").isNotNull()
    return rows if rows.filter(child).limit(1).count() else None


def _long_nested(rows: DataFrame, headers: list[str], measures: list[int]) -> Long:
    parent = headers[0] or "grupo"
    children = rows.filter("reason IS NULL AND NOT is_parent")
    at = F.col("row_no").cast("string")
    out = _unpivot(children, headers, [], measures, {parent: F.col("grp.name"), CHILD: F.col("c0")},
                   {parent: F.concat(F.lit("A"), F.coalesce(F.col("grp.row"), F.lit(1)).cast("string")), CHILD: F.concat(F.lit("A"), at)})
    gone = rows.filter("reason IS NOT NULL").select(F.col("row_no").alias("origin_row"), "reason")
    return Long("pivot_hierarchical", out, gone, rows.filter("reason IS NULL AND is_parent").select("row_no"), [parent, CHILD, STATUS], [MEASURE])


# Column roles ------------------------------------------------------------------------------------------------------


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, type, semantic_role, business_role, cardinality of each column, from one pass. Distinct counts are exact."""
    parts = []
    for i, name in enumerate(columns):
        c = F.col(f"`{name}`").cast("string")
        number = F.col(f"`{name}`").cast("double") if dict(df.dtypes)[name] in ("int", "bigint", "double", "float") else dotted_number(c)
        parts += [
            F.count_if(filled(c)).alias(f"n{i}"), F.count_if(filled(c) & number.isNull()).alias(f"t{i}"), F.count_if(number != F.floor(number)).alias(f"f{i}"),
            F.count_distinct(F.when(filled(c), c)).alias(f"d{i}"),
        ]
    seen = df.agg(*parts).first()
    rows = []
    for i, name in enumerate(columns):
        n, t, f, d = (seen[f"{k}{i}"] for k in "ntfd")
        kind = "string" if not n else ("float" if f else "integer") if not t else "category" if d <= CATEGORIES else "string"
        words = {w for w in re.split(r"[\s_./\-]+", name.lower().strip()) if w}
        if words & ENTITY_WORDS:
            role = "entity_id"
        elif kind in ("integer", "float"):
            role = "measure"
        elif words & TIME_WORDS:
            role = "temporal"
        else:
            role = "breakdown_dimension" if kind == "category" else "label"
        business = next((r for k, r in BUSINESS_ROLES.items() if k in name.lower()), None)
        rows.append((i, name, kind, role, business, None if role == "measure" else d))
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string, semantic_role string, business_role string, cardinality long")


# Indicators --------------------------------------------------------------------------------------------------------


def group_sums(df: DataFrame, by: str, measure: str) -> DataFrame:
    """key, value by falling value; ties by key."""
    key = F.coalesce(F.col(f"`{by}`").cast("string"), F.lit(""))
    return df.groupBy(key.alias("key")).agg(F.coalesce(F.sum(F.col(f"`{measure}`").cast("double")), F.lit(0.0)).alias("value")).orderBy(F.desc("value"), "key")


def kpi_rates(df: DataFrame, by: str, measure: str) -> DataFrame:
    """The total, and each category's share of it; a share of nothing is 0 and undefined."""
    groups = group_sums(df, by, measure)
    groups = groups.withColumn("total", F.sum("value").over(Window.partitionBy(F.lit(0))))
    share = F.when(F.col("total") == 0, 0.0).otherwise(F.col("value") / F.col("total"))
    rates = groups.select(F.concat(F.col("key"), F.lit("_rate")).alias("metric"), share.alias("value"), F.col("value").alias("numerator"), F.col("total").alias("denominator"),
                          F.when(F.col("total") == 0, "undefined").otherwise("ok").alias("validation_status"))
    total = df.agg(F.coalesce(F.sum(F.col(f"`{measure}`").cast("double")), F.lit(0.0)).alias("v"))
    return total.select(F.lit(f"total_{measure}").alias("metric"), F.col("v").alias("value"), F.col("v").alias("numerator"), F.col("v").alias("denominator"), F.lit("ok").alias("validation_status")).unionByName(rates)


def concentration(rates: DataFrame) -> DataFrame:
    """Shares over a half."""
    return rates.filter(F.col("metric").endswith("_rate") & (F.col("value") > CONCENTRATED)).select(F.lit("concentration").alias("type"), F.lit("high").alias("severity"), "metric", "value")


def slug(text: str) -> str:
    return plain(text).strip().replace(" ", "_")

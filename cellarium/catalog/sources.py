"""Queries that read files: CSV files and workbooks are written from tables to the checkpoint folder first, then read back.

The folder holds a CSV file of sales, one without the needed columns, and a workbook with sales, stock, customers and finance.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.catalog.audit import read
from cellarium.operators import audit as A
from cellarium.plans import audit as P
from cellarium.session import shared_dir
from cellarium.sources import documents, tables, workbook_source, xlsx


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """A file at any path that Spark reads."""
    jvm, sc = spark._jvm, spark.sparkContext
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def _new(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def _sales(spark: SparkSession, d: str) -> list[list[object]]:
    """A row a nation, with a header: dates as text, and money as a spreadsheet of the country writes it."""
    rows = read(spark, d, "nation").orderBy("n_nationkey").collect()  # 25 rows
    head = ["Data", "Produto", "Cliente", "Valor", "Custo", "Loja"]
    body = [[f"{1 + k % 28:02d}/01/2024" if k != 7 else "soon", f"item {k % 5}" if k != 9 else None, r.n_name, f"R$ 1.{k:03d},50" if k != 11 else "?", f"{k},25", f"store {r.n_regionkey}"] for r in rows for k in (r.n_nationkey,)]
    return [head, *body]


def _csv(rows: list[list[object]]) -> bytes:
    return "\n".join(",".join('"' + ("" if v is None else str(v)) + '"' for v in r) for r in rows).encode()


def _book(spark: SparkSession, d: str) -> bytes:
    nations = read(spark, d, "nation").orderBy("n_nationkey").collect()
    sales = [["Data", "Produto", "Cliente", "Valor", "Loja"], *([45292 + r.n_nationkey, f"item {r.n_nationkey % 5}", r.n_name, 1000.5 + r.n_nationkey, f"store {r.n_regionkey}"] for r in nations)]
    stock = [["SKU", "Custo", "Saldo", "Ultimo_mov", "Categoria"], *([f"sku {r.n_nationkey}", 2.5, r.n_nationkey + 1, 45000 + 10 * r.n_nationkey, f"kind {r.n_regionkey}"] for r in nations)]
    people = [["cliente_id", "telefone", "cpf"], *([r.n_name, "1" if r.n_nationkey % 2 else None, f"{r.n_nationkey // 2:03d}"] for r in nations)]
    return xlsx.written({"Vendas": sales, "Estoque": stock, "Clientes": people, "Notas": [["a", "b"], [1, "=A2*2"]]})


def sales_folder(spark: SparkSession, d: str) -> str:
    at = _new(spark)
    put(spark, f"{at}/a.csv", _csv(_sales(spark, d)))
    put(spark, f"{at}/b.csv", _csv([["x", "y"], ["1", "2"]]))
    put(spark, f"{at}/c.xlsx", _book(spark, d))
    put(spark, f"{at}/d.txt", b"nothing")
    return at


def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    at = _new(spark)
    put(spark, f"{at}/a.csv", _csv(_sales(spark, d)))
    grid, headers = tables.csv_grid(spark, f"{at}/a.csv")
    return tables.named(grid, [h.lower() for h in headers])


def _cells(spark: SparkSession, d: str) -> str:
    at = f"{_new(spark)}/book.xlsx"
    put(spark, at, _book(spark, d))
    return at


def xlsx_cells(spark: SparkSession, d: str) -> DataFrame:
    return xlsx.cells(spark, _cells(spark, d)).drop("file")


def xlsx_sheets(spark: SparkSession, d: str) -> DataFrame:
    return xlsx.sheets(spark, _cells(spark, d)).drop("file")


def workbook_class(spark: SparkSession, d: str) -> DataFrame:
    return xlsx.compatibility(spark, _cells(spark, d)).drop("file")


def missing_cache(spark: SparkSession, d: str) -> DataFrame:
    return xlsx.missing_cache(xlsx.cells(spark, _cells(spark, d))).select("sheet", "row", "col", "formula")


def folder_scan(spark: SparkSession, d: str) -> DataFrame:
    """Rows by source (its name without the folder) and reason (null: accepted), and the sources that were skipped."""
    loaded, _, skipped = P.folder(spark, sales_folder(spark, d))
    name = F.substring_index("source_file", "/", -1).alias("source")
    rows = loaded.accepted.select(name, F.lit(None).cast("string").alias("reason")).unionByName(loaded.discarded.select(name, "reason"))
    gone = spark.createDataFrame([(s.rsplit("/", 1)[-1], "skipped") for s, _ in skipped], "source string, reason string")
    return rows.unionByName(gone).groupBy("source", "reason").agg(F.count("*").alias("rows"))


def audit_folder(spark: SparkSession, d: str) -> DataFrame:
    out = P.audit_folder(spark, sales_folder(spark, d))
    one = lambda key, name, value: out[key].select(F.lit(name).alias("finding"), F.round(value, 4).cast("double").alias("value"))
    pnl = out["store_pnl"].agg(F.sum("gross_revenue").alias("v"))
    parts = [pnl.select(F.lit("revenue").alias("finding"), F.round("v", 4).alias("value")), one("dead_stock", "dead_skus", F.col("sku_count")), one("dead_stock", "frozen", F.col("capital_frozen")), one("data_completeness", "completeness", F.col("completeness_pct"))]
    parts.append(out["skipped"].agg(F.count("*").cast("double").alias("value")).select(F.lit("skipped").alias("finding"), "value"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def frozen_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    from cellarium.catalog.audit import T, stock

    rows = stock(spark, d)
    by_item = P.frozen_capital(A.dead_skus(rows, T), rows, ["category"])
    return P.reconciled(A.dead_stock(rows, T), by_item).select(F.round("total", 2).alias("total"), F.round("by_item", 2).alias("by_item"), "reconciled")


def _supplier_sheets(group: pd.DataFrame) -> dict[str, list[list[object]]]:
    """Suppliers of a nation, a row each, with formulas of four kinds; the hidden sheet has one that is volatile."""
    rows = []
    for r, (key, balance) in enumerate(sorted(zip(group["s_suppkey"], group["s_acctbal"], strict=True)), 1):
        formulas = (f"=NOW()+A{r}", f"=[Rates.xlsx]S!A{r}" + f"+A{r}" * 70, f"=A{r}*2", f"=SNOW(A{r})")
        rows.append([int(key), float(balance), formulas[int(key) % 4]])
    return {"Data": rows, "Raw": [["=RAND()" if int(group["s_nationkey"].iloc[0]) % 2 == 0 else "=1+1"]]}


def _books(spark: SparkSession, d: str) -> str:
    """A folder with a workbook for each nation that has suppliers, written by the tasks, and a file that is none."""
    at = _new(spark)
    suppliers = read(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.col("s_acctbal").cast("double").alias("s_acctbal"))
    xlsx.write_books(suppliers, "s_nationkey", at, _supplier_sheets, hidden=("Raw",)).agg(F.sum("bytes")).collect()
    put(spark, f"{at}/broken.xlsx", b"nothing")
    workbook_source.register(spark)
    return at


def _nation(file: str = "file") -> Column:
    return F.regexp_extract(file, r"(\d+)\.xlsx$", 1).cast("long").alias("nation")


def xlsx_source(spark: SparkSession, d: str) -> DataFrame:
    """The cells of all workbooks of a folder, a partition a sheet."""
    return spark.read.format("xlsx").load(_books(spark, d)).select(_nation(), "sheet", "row", "col", F.round("num", 2).alias("num"), "formula")


def xlsx_source_formulas(spark: SparkSession, d: str) -> DataFrame:
    """The formulas of one sheet, whose partitions alone are read."""
    return spark.read.format("xlsx").option("mode", "formulas").load(_books(spark, d)).filter("sheet = 'Raw'").select(_nation(), "formula")


def xlsx_refused(spark: SparkSession, d: str) -> DataFrame:
    """Files that can't be read, and those that unpack to more than is allowed; the others are read."""
    found = spark.read.format("xlsx").option("mode", "refused").load(_books(spark, d))
    return found.select(F.substring_index("file", "/", -1).alias("file"), "reason")


def restricted_items(spark: SparkSession, d: str) -> DataFrame:
    at, read_ = _books(spark, d), spark.read.format("xlsx")
    items = xlsx.restricted_items(read_.load(at), read_.option("mode", "sheets").load(at))
    return items.select("kind", _nation(), "sheet", "cell", "formula")


def report_documents(s: SparkSession, d: str) -> DataFrame:
    """Orders out of a report with a document for each customer, which executors wrote and read again."""
    order = F.struct("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").cast("double").alias("price"), "o_orderpriority")
    customers = read(s, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(order)).alias("orders"), F.count(F.lit(1)).alias("n"))
    path = f"{shared_dir(s)}/report-{uuid.uuid4().hex}"
    documents.write({"customers": customers, "note": {"kind": "orders", "of": ["customers"]}}, s, path)
    found = documents.section(s, path, "customers", customers.schema).select("o_custkey", "n", F.inline("orders"))
    return found.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


QUERIES = {
    "report_documents": report_documents,
    "restricted_items": restricted_items, "xlsx_source": xlsx_source, "xlsx_source_formulas": xlsx_source_formulas, "xlsx_refused": xlsx_refused,
    "csv_scan": csv_scan, "xlsx_cells": xlsx_cells, "xlsx_sheets": xlsx_sheets, "workbook_class": workbook_class, "missing_cache": missing_cache, "folder_scan": folder_scan, "audit_folder": audit_folder,
    "frozen_reconciliation": frozen_reconciliation,
}

_K = "n_nationkey"
_V = f"CASE WHEN {_K} NOT IN (7, 9, 11) THEN 1000 + {_K} + 0.5 ELSE 0 END"
_STOCK = f"s AS (SELECT {_K} AS k, 2.5 * ({_K} + 1) AS v, DATE '1899-12-30' + (45000 + 10 * {_K})::INT AS t FROM nation), m AS (SELECT max(t) AS t FROM s), e AS (SELECT s.*, (year(m.t) * 12 + month(m.t)) - (year(s.t) * 12 + month(s.t)) AS age FROM s, m)"
_CELL = "SELECT '{s}' AS sheet, {r} AS row, {c} AS col, {n} AS num, {t} AS txt, {f} AS formula FROM {q}"
_SHEETS = {
    "Vendas": (["Data", "Produto", "Cliente", "Valor", "Loja"], [f"45292 + {_K}", f"@'item ' || {_K} % 5", "@n_name", f"1000.5 + {_K}", "@'store ' || n_regionkey"]),
    "Estoque": (["SKU", "Custo", "Saldo", "Ultimo_mov", "Categoria"], [f"@'sku ' || {_K}", "2.5", f"{_K} + 1", f"45000 + 10 * {_K}", "@'kind ' || n_regionkey"]),
    "Clientes": (["cliente_id", "telefone", "cpf"], ["@n_name", f"@CASE WHEN {_K} % 2 = 1 THEN '1' END", f"@lpad(({_K} // 2)::VARCHAR, 3, '0')"]),
}


def _cell_sql() -> str:
    parts = [_CELL.format(s="Notas", r=1, c=c, n="NULL", t=f"'{t}'", f="NULL", q="(SELECT 1)") for c, t in ((1, "a"), (2, "b"))]
    parts += [_CELL.format(s="Notas", r=2, c=1, n=1, t="NULL", f="NULL", q="(SELECT 1)"), _CELL.format(s="Notas", r=2, c=2, n="NULL", t="NULL", f="'=A2*2'", q="(SELECT 1)")]
    for sheet, (heads, body) in _SHEETS.items():
        for c, (h, e) in enumerate(zip(heads, body, strict=True), 1):
            parts.append(_CELL.format(s=sheet, r=1, c=c, n="NULL", t=f"'{h}'", f="NULL", q="(SELECT 1)"))
            n, t = ("NULL", e[1:]) if e[0] == "@" else (e, "NULL")
            parts.append(_CELL.format(s=sheet, r=f"{_K} + 2", c=c, n=n, t=t, f="NULL", q="nation"))
    return " UNION ALL ".join(parts)


_BOOKS = """WITH o AS (SELECT s_suppkey AS k, s_nationkey AS nation, s_acctbal::DOUBLE AS v, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey, s_acctbal))::INT AS row FROM supplier),
b AS (SELECT *, ['=NOW()+A' || row, '=[Rates.xlsx]S!A' || row || repeat('+A' || row, 70), '=A' || row || '*2', '=SNOW(A' || row || ')'][k % 4 + 1] AS formula FROM o)"""
ORACLE_SQL = {
    "restricted_items": f"""{_BOOKS} SELECT CASE WHEN k % 4 = 0 THEN 'volatile' ELSE 'external_ref' END AS kind, nation, 'Data' AS sheet, 'C' || row AS cell, formula FROM b WHERE k % 4 < 2
UNION ALL SELECT DISTINCT 'volatile', nation, 'Raw', 'A1', '=RAND()' FROM b WHERE nation % 2 = 0 UNION ALL SELECT DISTINCT 'hidden_sheet', nation, 'Raw', NULL, NULL FROM b WHERE nation % 2 = 0""",
    "xlsx_source": f"""{_BOOKS} SELECT nation, 'Data' AS sheet, row, 1 AS col, k::DOUBLE AS num, NULL AS formula FROM b UNION ALL SELECT nation, 'Data', row, 2, round(v, 2), NULL FROM b UNION ALL SELECT nation, 'Data', row, 3, NULL, formula FROM b
UNION ALL SELECT DISTINCT nation, 'Raw', 1, 1, NULL::DOUBLE, CASE WHEN nation % 2 = 0 THEN '=RAND()' ELSE '=1+1' END FROM b""",
    "xlsx_source_formulas": "SELECT DISTINCT s_nationkey AS nation, CASE WHEN s_nationkey % 2 = 0 THEN '=RAND()' ELSE '=1+1' END AS formula FROM supplier",
    "xlsx_refused": "SELECT 'broken.xlsx' AS file, 'no zip file' AS reason",
    "csv_scan": f"SELECT CASE WHEN {_K} = 7 THEN 'soon' ELSE lpad((1 + {_K} % 28)::VARCHAR, 2, '0') || '/01/2024' END AS data, CASE WHEN {_K} <> 9 THEN 'item ' || {_K} % 5 END AS produto, n_name AS cliente, CASE WHEN {_K} = 11 THEN '?' ELSE 'R$ 1.' || lpad({_K}::VARCHAR, 3, '0') || ',50' END AS valor, {_K} || ',25' AS custo, 'store ' || n_regionkey AS loja, {_K} + 2 AS row_no FROM nation",
    "xlsx_cells": f"SELECT sheet, row, col, chr((64 + col)::INT) || row AS coord, num::DOUBLE AS num, txt, NULL AS bool, NULL AS err, formula FROM ({_cell_sql()}) WHERE num IS NOT NULL OR txt IS NOT NULL OR formula IS NOT NULL",
    "xlsx_sheets": "SELECT * FROM (VALUES ('Vendas', 0, 'visible', 26, 5), ('Estoque', 1, 'visible', 26, 5), ('Clientes', 2, 'visible', 26, 3), ('Notas', 3, 'visible', 2, 2)) t(sheet, position, state, rows, columns)",
    "workbook_class": "SELECT 1 AS formulas, false AS has_macros, false AS has_external_links, 0 AS volatile_formulas, 'supported' AS verdict",
    "missing_cache": "SELECT 'Notas' AS sheet, 2 AS row, 2 AS col, '=A2*2' AS formula",
    "folder_scan": "SELECT * FROM (VALUES ('a.csv', NULL, 22), ('a.csv', 'data_invalida', 1), ('a.csv', 'valor_nao_numerico', 1), ('a.csv', 'produto_ausente', 1), ('c.xlsx#Vendas', NULL, 25), ('b.csv', 'skipped', 1), ('c.xlsx#Notas', 'skipped', 1), ('d.txt', 'skipped', 1)) t(source, reason, rows)",
    "audit_folder": f"WITH {_STOCK} SELECT 'revenue' AS finding, round(sum({_V} + 1000.5 + {_K}), 4)::DOUBLE AS value FROM nation UNION ALL SELECT 'dead_skus', count(*) FROM e WHERE age >= 8 UNION ALL SELECT 'frozen', sum(v) FROM e WHERE age >= 8 UNION ALL SELECT 'completeness', round((100.0 * count(*) FILTER ({_K} % 2 = 1) / count(*) + 100) / 2, 4) FROM nation UNION ALL SELECT 'skipped', 3",
    "frozen_reconciliation": "WITH m AS (SELECT l_partkey, max(l_shipdate) AS t FROM lineitem GROUP BY 1), n AS (SELECT max(t) AS t FROM m), v AS (SELECT round(sum(p_retailprice * p_size), 2) AS v FROM part JOIN m ON p_partkey = l_partkey, n WHERE (year(n.t) * 12 + month(n.t)) - (year(m.t) * 12 + month(m.t)) >= 2) SELECT v AS total, v AS by_item, true AS reconciled FROM v",
}
ORACLE_SQL["report_documents"] = """SELECT o_custkey, count(*) OVER (PARTITION BY o_custkey) AS n, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day,
  o_totalprice::DOUBLE AS price, o_orderpriority FROM orders"""

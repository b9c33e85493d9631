"""Cleaning and dashboard queries, and their SQL. Dirty text is made from clean columns, so SQL knows what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.catalog.audit import read
from cellarium.operators import cleaning as C
from cellarium.operators import longform as L


def _digits(cents: Column) -> Column:
    return F.format_number((cents / 100).cast("decimal(18,2)"), 2)  # 1,234.56


def _brazilian(text: Column) -> Column:
    return F.translate(text, ",.", ".,")


def dirty_money(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    english = _digits(cents)
    kind = F.col("o_orderkey") % 7
    text = (
        F.when(kind == 0, F.concat(F.lit("R$ "), _brazilian(english))).when(kind == 1, english).when(kind == 2, F.replace(_brazilian(english), F.lit("."), F.lit("")))
        .when(kind == 3, F.replace(english, F.lit(","), F.lit(""))).when(kind == 4, F.concat(F.lit("€"), F.format_string("%d.%03d", cents % 999 + 1, cents % 1000)))
        .when(kind == 5, F.lit("n/d"))
    )
    return o.select("o_orderkey", text.alias("text"))


def currency_coercion(spark: SparkSession, d: str) -> DataFrame:
    return dirty_money(spark, d).select("o_orderkey", F.round(C.money(F.col("text")), 2).alias("amount"))


def date_coercion(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 9 == 0, "31/13/2024").when(F.col("o_orderkey") % 9 == 1, F.date_format("o_orderdate", "d-M-yyyy")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    raw = o.select("o_orderkey", text.alias("text"))
    return raw.select("o_orderkey", F.date_format(C.dates(F.col("text"), C.date_style(raw, "text")), "yyyy-MM-dd").alias("day"))


def raw_sales(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.when(k % 11 == 0, "31/13/2024").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("Data Emissão"),
        F.when(k % 13 != 0, F.col("o_orderpriority")).alias("Produto/Serviço"), F.when(k % 5 != 0, F.concat(F.lit("C"), F.col("o_custkey"))).alias("Cliente"),
        F.when(k % 17 == 0, "").otherwise(F.concat(F.lit("R$ "), _brazilian(_digits(F.round(F.col("o_totalprice") * 100).cast("long"))))).alias("Valor Líquido"),
        F.when(k % 3 != 0, (k % 4 + 1).cast("string")).alias("Qtd"), k.alias("row_no"),
    )


def discard_accounting(spark: SparkSession, d: str) -> DataFrame:
    return C.load_sales(raw_sales(spark, d), "orders").summary().select(F.coalesce("reason", F.lit("aceita")).alias("reason"), "rows")


def loaded_sales(spark: SparkSession, d: str) -> DataFrame:
    rows = C.load_sales(raw_sales(spark, d), "orders").accepted
    return rows.select("source_row", F.date_format("date", "yyyy-MM-dd").alias("day"), "product", "customer", F.round("value", 2).alias("value"), "quantity")


def customer_roles(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    raw = c.select(F.col("c_custkey").cast("string").alias("Código"), F.col("c_name").alias("Telefone"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).otherwise(" ").alias("CPF"))
    return C.by_roles(raw, C.CUSTOMER_ROLES, C.REQUIRED["customers"])


def wide_grid(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """A row per nation and status of orders; some cells empty, one total row, one empty row."""
    c, o = read(spark, d, "customer"), read(spark, d, "orders")
    rows = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_nationkey").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "O").alias("o"), F.round(F.sum("o_totalprice") * 100).cast("long").alias("cents")
    )
    cells = rows.select(
        (F.col("c_nationkey") + 2).cast("long").alias("row_no"), F.concat(F.lit("N"), F.col("c_nationkey")).alias("c0"),
        F.when(F.col("c_nationkey") % 6 != 0, F.col("f").cast("string")).otherwise("").alias("c1"), F.when((F.col("c_nationkey") % 9 != 0) & (F.col("c_nationkey") != 24), F.col("o").cast("string")).alias("c2"),
        F.when(F.col("c_nationkey") != 24, _brazilian(_digits(F.col("cents")))).alias("c3"),
    )
    more = spark.sql("SELECT 900L AS row_no, 'Total Geral' AS c0, '1' AS c1, '2' AS c2, '3' AS c3 UNION ALL SELECT 901L, '', NULL, '', NULL")
    return cells.unionByName(more), ["nation", "done", "open", "amount"]


def unpivot_wide(spark: SparkSession, d: str) -> DataFrame:
    rows = L.long_table(*wide_grid(spark, d)).rows
    return rows.select("origin_row", "nation", "status", F.round("quantidade", 2).alias("quantidade"), F.col("origin_cells")["quantidade"].alias("cell"))


def unpivot_discards(spark: SparkSession, d: str) -> DataFrame:
    return L.long_table(*wide_grid(spark, d)).discarded


def nested_grid(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """Regions as group rows, their nations below, a subtotal after each, a grand total at the end."""
    n, r, c = read(spark, d, "nation"), read(spark, d, "region"), read(spark, d, "customer")
    counts = c.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    base = (F.col("n_regionkey") * 100 + 2).cast("long")
    kids = n.join(counts, n.n_nationkey == counts.c_nationkey, "left").select((base + 1 + F.col("n_nationkey")).alias("row_no"), F.col("n_name").alias("c0"), F.coalesce(F.col("n"), F.lit(0)).cast("string").alias("c1"))
    heads = r.select((F.col("r_regionkey") * 100 + 2).cast("long").alias("row_no"), F.col("r_name").alias("c0"), F.lit("").alias("c1"))
    subs = r.select((F.col("r_regionkey") * 100 + 90).cast("long").alias("row_no"), F.concat(F.lit("Subtotal "), F.col("r_name")).alias("c0"), F.lit("7").alias("c1"))
    end = spark.sql("SELECT 9000L AS row_no, 'Grand Total' AS c0, '99' AS c1")
    return kids.unionByName(heads).unionByName(subs).unionByName(end), ["region", "customers"]


def unpivot_hierarchical(spark: SparkSession, d: str) -> DataFrame:
    rows = L.long_table(*nested_grid(spark, d)).rows
    return rows.select("origin_row", "region", "subgrupo", "status", "quantidade", F.col("origin_cells")["region"].alias("region_cell"))


def column_profile(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd").alias("data"))
    return L.column_profile(e, e.columns)


def _spend(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_suppkey", "l_quantity")


QUERIES = {
    "currency_coercion": currency_coercion, "date_coercion": date_coercion, "discard_accounting": discard_accounting, "loaded_sales": loaded_sales,
    "customer_roles": customer_roles, "unpivot_wide": unpivot_wide, "unpivot_discards": unpivot_discards, "unpivot_hierarchical": unpivot_hierarchical,
    "column_profile": column_profile, "kpi_rates": lambda s, d: L.kpi_rates(_spend(s, d), "l_returnflag", "l_quantity"),
    "group_distribution": lambda s, d: L.group_sums(_spend(s, d), "l_linestatus", "l_quantity"),
    "entity_ranking_topk": lambda s, d: L.group_sums(_spend(s, d), "l_suppkey", "l_quantity").limit(L.TOP),
    "concentration": lambda s, d: L.concentration(L.kpi_rates(_spend(s, d), "l_linestatus", "l_quantity")),
}

_RAW = """r AS (SELECT o_orderkey AS k, o_orderdate, o_orderpriority, o_custkey, round(o_totalprice, 2) AS p FROM orders)"""
_REASON = "CASE WHEN k % 11 = 0 THEN 'data_invalida' WHEN k % 17 = 0 THEN 'valor_nao_numerico' WHEN k % 13 = 0 THEN 'produto_ausente' ELSE 'aceita' END"
_WIDE = """w AS (SELECT c_nationkey AS k, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS f, count(*) FILTER (o_orderstatus = 'O')::DOUBLE AS o, round(sum(o_totalprice), 2) AS a
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)"""
_KPI = "SELECT l_returnflag AS k, sum(l_quantity) AS v, sum(sum(l_quantity)) OVER () AS t FROM lineitem {} GROUP BY 1"

ORACLE_SQL = {
    "currency_coercion": """WITH r AS (SELECT o_orderkey, o_orderkey % 7 AS k, round(o_totalprice * 100)::BIGINT AS c FROM orders)
SELECT o_orderkey, CASE WHEN k < 4 THEN round(c / 100.0::DOUBLE, 2) WHEN k = 4 THEN ((c % 999 + 1) * 1000 + c % 1000)::DOUBLE END AS amount FROM r""",
    "date_coercion": "SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders",
    "discard_accounting": f"WITH {_RAW} SELECT {_REASON} AS reason, count(*) AS rows FROM r GROUP BY 1",
    "loaded_sales": f"""WITH {_RAW} SELECT k AS source_row, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS product, CASE WHEN k % 5 <> 0 THEN 'C' || o_custkey ELSE 'SEM_CADASTRO' END AS customer,
round(p * CASE WHEN k % 3 <> 0 THEN k % 4 + 1 ELSE 1 END, 2) AS value, CASE WHEN k % 3 <> 0 THEN (k % 4 + 1)::DOUBLE END AS quantity FROM r WHERE {_REASON} = 'aceita'""",
    "customer_roles": "SELECT c_custkey::VARCHAR AS customer_id, c_name AS phone, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS document FROM customer",
    "unpivot_wide": f"""WITH {_WIDE}, u AS (SELECT k, 'done' AS status, f AS q, 'B' AS l FROM w WHERE k % 6 <> 0 UNION ALL SELECT k, 'open', o, 'C' FROM w WHERE k % 9 <> 0 AND k <> 24 UNION ALL SELECT k, 'amount', a, 'D' FROM w WHERE k <> 24)
SELECT (k + 2)::BIGINT AS origin_row, 'N' || k AS nation, status, round(q, 2) AS quantidade, l || (k + 2) AS cell FROM u""",
    "unpivot_discards": "SELECT 900::BIGINT AS origin_row, 'grand_total' AS reason UNION ALL SELECT 901, 'empty' UNION ALL SELECT 26, 'no_measures' FROM nation WHERE n_nationkey = 24",
    "unpivot_hierarchical": """SELECT (n_regionkey * 100 + 3 + n_nationkey)::BIGINT AS origin_row, r_name AS region, n_name AS subgrupo, 'customers' AS status,
(SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey)::DOUBLE AS quantidade, 'A' || (n_regionkey * 100 + 2) AS region_cell FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "column_profile": """SELECT * FROM (VALUES (0, 'event_id', 'integer', 'entity_id', NULL, (SELECT count(DISTINCT event_id) FROM events)), (1, 'user_id', 'integer', 'entity_id', NULL, (SELECT count(DISTINCT user_id) FROM events)),
(2, 'event_type', 'category', 'breakdown_dimension', NULL, (SELECT count(DISTINCT event_type) FROM events)), (3, 'value', 'float', 'measure', NULL, NULL),
(4, 'data', CASE WHEN (SELECT count(DISTINCT ts::DATE) FROM events) <= 20 THEN 'category' ELSE 'string' END, 'temporal', NULL, (SELECT count(DISTINCT ts::DATE) FROM events)))
t(position, name, type, semantic_role, business_role, cardinality)""",
    "kpi_rates": f"""WITH g AS ({_KPI.format('')}) SELECT 'total_l_quantity' AS metric, sum(v) AS value, sum(v) AS numerator, sum(v) AS denominator, 'ok' AS validation_status FROM g
UNION ALL SELECT k || '_rate', v / t, v, t, 'ok' FROM g""",
    "group_distribution": "SELECT l_linestatus AS key, sum(l_quantity) AS value FROM lineitem GROUP BY 1",
    "entity_ranking_topk": "SELECT l_suppkey::VARCHAR AS key, sum(l_quantity) AS value FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
    "concentration": "WITH g AS (SELECT l_linestatus AS k, sum(l_quantity) AS v, sum(sum(l_quantity)) OVER () AS t FROM lineitem GROUP BY 1) SELECT 'concentration' AS type, 'high' AS severity, k || '_rate' AS metric, v / t AS value FROM g WHERE v / t > 0.5",
}

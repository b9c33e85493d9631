"""Audit queries over the star schema, and their SQL.

`sales` is what the order lines say as a sales table: returned lines are refunds, a seventh of the customers and an
eleventh of the suppliers are unknown, and costs come from a rule that gives some products and stores a negative margin.
Sums are rounded to four places (that many they have) and ratios to six places, as sums of doubles depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.operators import audit as A
from cellarium.operators.thresholds import Thresholds

#: The defaults find nothing in these tables, so the queries name what they look for.
T = Thresholds(
    concentration_pct=1.2, outlier_ratio=2.0, cold_start_months=78.6, decoupling_pct=5.0, promo_payment="5-LOW", anchor_category="STANDARD",
    target_category="ECONOMY", service_category="PROMO", capture_pct=86.0, dead_stock_months=2, ramp_days=2370, conversion_pct=20.0,
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are shuffled for parts and suppliers while they are narrow; customers meet orders before orders meet lines, of which there
    are several an order, so names of customers and stores are shuffled once an order."""
    price, refund = F.col("l_extendedprice"), F.col("l_returnflag") == "R"
    amount = price * (1 - F.col("l_discount"))
    line = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", F.when(refund, -amount).otherwise(amount).alias("value"), F.col("l_quantity").alias("quantity"), price.alias("price"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("source_row"),
    )
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("product"), F.col("p_type").alias("category"), (0.02 * (F.col("p_partkey") % 64 % 5)).alias("part_rate"))
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 11 != 0, F.col("s_name")).alias("salesperson"))
    nation = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("store"))
    people = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("customer"), (0.70 + 0.02 * (F.col("c_nationkey") % 8)).alias("store_rate"), "store"
    )
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("date"), F.col("o_orderpriority").alias("payment_method"))
    orders = orders.join(people, F.col("o_custkey") == F.col("c_custkey"))
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        "date", "product", "customer", "value", "quantity", (F.col("price") * (F.col("store_rate") + F.col("part_rate"))).alias("entry_cost"), "category", "store", "salesperson",
        "payment_method", F.lit("lineitem").alias("source_file"), "source_row",
    )


def stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max("l_shipdate").alias("last_movement"))
    part = read(spark, sf_dir, "part")
    return part.join(moved, part.p_partkey == moved.l_partkey, "left").select(
        F.col("p_partkey").cast("string").alias("sku"), F.col("p_retailprice").alias("cost"), F.col("p_size").cast("double").alias("qty_on_hand"), "last_movement", F.col("p_type").alias("category")
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        F.col("c_name").alias("customer_id"), F.when(key % 3 != 0, F.concat(F.lit("+55 "), key.cast("string"))).alias("phone"),
        F.when(key % 5 == 0, "").when(key % 5 == 2, F.concat((key - 1).cast("string"), F.lit(".000-00"))).otherwise(F.concat(key.cast("string"), F.lit("00000"))).alias("document"),
    )


def finance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sales(spark, sf_dir).filter(F.col("category") == T.service_category).groupBy("store", A.month_text(F.col("date")).alias("period")).agg(F.sum("value").alias("v"))
    return rows.select("store", "period", (F.col("v") + F.when(F.substring("period", 6, 2) == "12", 1000.0).otherwise(0.25)).alias("service_revenue"))


def _money(df: DataFrame, money: str = "", ratio: str = "") -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in money.split()} | {c: F.round(c, 6) for c in ratio.split()})


def _q(make, money: str = "", ratio: str = ""):  # noqa: ANN001, ANN202
    return lambda spark, d: _money(make(spark, d), money, ratio)


QUERIES = {
    "store_pnl": _q(lambda s, d: A.store_pnl(sales(s, d), T), "gross_revenue avg_price avg_entry_cost contribution_margin_avg contribution_margin_total", "months_of_history"),
    "store_macro": _q(lambda s, d: A.store_macro(A.store_pnl(sales(s, d), T)).select(
        F.array_join("stores_with_negative_margin", ",").alias("stores_with_negative_margin"), "masked_amount", "network_contribution_margin_total",
        F.array_join("revenue_rank", ",").alias("revenue_rank"), F.array_join("margin_rank", ",").alias("margin_rank"), "rank_differs"), "masked_amount network_contribution_margin_total"),
    "leaks_total": _q(lambda s, d: A.leaks_total(sales(s, d), T), "expected_value actual_value", "drop_sigma"),
    "leaks_product_yoy": _q(lambda s, d: A.leaks_by_product(sales(s, d), T), "expected_value actual_value", "drop_sigma"),
    "churn": _q(lambda s, d: A.churn(sales(s, d), T), "historical_value", "avg_cadence_days"),
    "product_trend": _q(lambda s, d: A.product_trends(sales(s, d), T), "", "company_growth_pct product_growth_pct"),
    "seasonality": _q(lambda s, d: A.seasonality(sales(s, d), T), "", "monthly_index"),
    "rfm_champions": _q(lambda s, d: A.rfm_champions(sales(s, d), T), "monetary"),
    "contribution_margin": _q(lambda s, d: A.contribution_margin(sales(s, d), T), "avg_price avg_entry_cost contribution_margin"),
    "customer_concentration": _q(lambda s, d: A.customer_concentration(sales(s, d), T), "customer_revenue store_revenue", "concentration_pct"),
    "salesperson_efficiency": _q(lambda s, d: A.salesperson_performance(sales(s, d), T), "revenue", "capture_pct"),
    "latent_revenue": _q(lambda s, d: A.latent_revenue(sales(s, d), T), "avg_ticket estimated_latent_revenue", "attach_rate_pct"),
    "latent_customers": _q(lambda s, d: A.latent_customers(sales(s, d), T)),
    "dead_stock": _q(lambda s, d: A.dead_stock(stock(s, d), T), "capital_frozen total_inventory_value", "dead_stock_pct"),
    "dead_stock_skus": _q(lambda s, d: A.dead_skus(stock(s, d), T).select("sku", "category", "qty_on_hand", "cost"), "cost"),
    "gmroi": _q(lambda s, d: A.gmroi(sales(s, d), stock(s, d), T), "gross_margin avg_inventory_value", "gmroi"),
    "data_completeness": _q(lambda s, d: A.data_completeness(customers(s, d), T), "", "phone_filled_pct document_filled_pct completeness_pct"),
    "cpf_dedupe": _q(lambda s, d: A.canonical_ids(customers(s, d))),
    "pseudonyms": _q(lambda s, d: A.pseudonyms(sales(s, d))),
    "service_decomposition": _q(lambda s, d: A.service_decomposition(sales(s, d), T), "follow_on_effect", "product_margin service_margin total_margin"),
    "service_reconciliation": _q(lambda s, d: A.service_reconciliation(sales(s, d), finance(s, d), T), "declared_revenue transactional_revenue gap"),
    "executive_totals": _q(lambda s, d: A.executive_totals(A.contribution_margin(sales(s, d), T), A.dead_stock(stock(s, d), T), A.churn(sales(s, d), T)), "impact"),
    "discarded_alarms": _q(lambda s, d: A.discarded_alarms(A.salesperson_performance(sales(s, d), T), A.store_pnl(sales(s, d), T)), "", "measure"),
    "winsorise": _q(lambda s, d: A.capped_values(sales(s, d), T), "original_value capped_value"),
    "silence_by_month": _q(lambda s, d: A.silence_by_month(A.churn(sales(s, d), T)), "value"),
}

_SALES = """
sales AS (
  SELECT o_orderdate AS date, p_name AS product, CASE WHEN o_custkey % 7 <> 0 THEN c_name END AS customer,
    CASE WHEN l_returnflag = 'R' THEN -(l_extendedprice * (1 - l_discount)) ELSE l_extendedprice * (1 - l_discount) END AS value,
    l_quantity AS quantity, l_extendedprice * (0.70::DOUBLE + 0.02::DOUBLE * (c_nationkey % 8) + 0.02::DOUBLE * (p_partkey % 64 % 5)) AS entry_cost,
    p_type AS category, n_name AS store, CASE WHEN l_suppkey % 11 <> 0 THEN s_name END AS salesperson, o_orderpriority AS payment_method,
    l_orderkey * 8 + l_linenumber AS source_row
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON l_suppkey = s_suppkey
)"""
_STOCK = """
stock AS (
  SELECT p_partkey::VARCHAR AS sku, p_retailprice AS cost, p_size::DOUBLE AS qty, m.last_movement, p_type AS category
  FROM part LEFT JOIN (SELECT l_partkey, max(l_shipdate) AS last_movement FROM lineitem GROUP BY 1) m ON p_partkey = m.l_partkey
)"""
_CUSTOMERS = """
people AS (
  SELECT c_name AS customer_id, CASE WHEN c_custkey % 3 <> 0 THEN '+55 ' || c_custkey END AS phone,
    CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 5 = 2 THEN (c_custkey - 1) || '.000-00' ELSE c_custkey || '00000' END AS document
  FROM customer
)"""
_PNL = f"""
pnl AS (
  SELECT store, sum(value) AS gross_revenue, count(*) AS revenue_sample_size, avg(value) FILTER (entry_cost IS NOT NULL AND value > 0) AS avg_price,
    avg(entry_cost) FILTER (entry_cost IS NOT NULL AND value > 0) AS avg_entry_cost, count(*) FILTER (entry_cost IS NOT NULL AND value > 0) AS margin_sample_size,
    date_diff('day', min(date), max(date)) / 30.44::DOUBLE AS months_of_history
  FROM sales GROUP BY store
), pnl2 AS (
  SELECT *, avg_price - avg_entry_cost - avg_price * 0.15::DOUBLE AS m, months_of_history >= {T.cold_start_months} AS ok FROM pnl
)"""
_CHURN = """
lost AS (
  SELECT customer, n AS purchase_count, date_diff('day', a, b)::DOUBLE / (n - 1) AS avg_cadence_days, strftime(b, '%Y-%m-%d') AS last_purchase,
    (year(g) * 12 + month(g)) - (year(b) * 12 + month(b)) AS months_silent, v AS historical_value
  FROM (SELECT customer, count(DISTINCT date::DATE) AS n, min(date::DATE) AS a, max(date::DATE) AS b, sum(value) AS v FROM sales WHERE customer IS NOT NULL GROUP BY 1),
    (SELECT max(date::DATE) AS g FROM sales)
  WHERE n >= 3 AND date_diff('day', b, g) > 2.0 * date_diff('day', a, b)::DOUBLE / (n - 1) AND (year(g) * 12 + month(g)) - (year(b) * 12 + month(b)) >= 3
)"""
_MARGINS = """
margins AS (
  SELECT product, p AS avg_price, c AS avg_entry_cost, p - c - p * 0.15::DOUBLE AS contribution_margin, n AS sample_size, promotional FROM (
    SELECT product, avg(value) AS p, avg(entry_cost) AS c, count(*) AS n, bool_and(lower(trim(payment_method)) = '5-low') AS promotional
    FROM sales WHERE value > 0 AND entry_cost IS NOT NULL AND category IS DISTINCT FROM 'PROMO' GROUP BY product)
  WHERE p - c - p * 0.15::DOUBLE < 0
)"""
_DEAD = f"""
dead AS (
  SELECT *, (year(g) * 12 + month(g)) - (year(last_movement) * 12 + month(last_movement)) >= {T.dead_stock_months} AS is_dead FROM stock, (SELECT max(last_movement) AS g FROM stock)
  WHERE sku IS NOT NULL AND cost IS NOT NULL AND qty IS NOT NULL AND last_movement IS NOT NULL
), frozen AS (
  SELECT count(*) FILTER (is_dead) AS sku_count, sum(qty * cost) FILTER (is_dead) AS capital_frozen, sum(qty * cost) AS total_inventory_value FROM dead
)"""
_PEOPLE = f"""
sellers AS (
  SELECT coalesce(salesperson, 'VENDEDOR_NAO_IDENTIFICADO') AS salesperson, count(*) AS sales_count, sum(value) AS revenue,
    100.0::DOUBLE * count(customer) / count(*) AS capture_pct, date_diff('day', min(date)::DATE, (SELECT max(date)::DATE FROM sales)) AS tenure_days
  FROM sales GROUP BY 1
), sellers2 AS (
  SELECT *, tenure_days >= {T.ramp_days} AS ok FROM sellers
)"""

ORACLE_SQL = {
    "store_pnl": f"""WITH {_SALES}, {_PNL}
SELECT store, round(gross_revenue, 4) AS gross_revenue, revenue_sample_size, round(avg_price, 4) AS avg_price, round(avg_entry_cost, 4) AS avg_entry_cost,
  margin_sample_size, round(m, 4) AS contribution_margin_avg, round(months_of_history, 6) AS months_of_history,
  round(m * margin_sample_size, 4) AS contribution_margin_total, ok AS has_sufficient_history FROM pnl2""",
    "store_macro": f"""WITH {_SALES}, {_PNL}
SELECT coalesce(string_agg(store, ',' ORDER BY store) FILTER (m < 0 AND ok), '') AS stores_with_negative_margin, round(coalesce(sum(-m * margin_sample_size) FILTER (m < 0 AND ok), 0), 4) AS masked_amount,
  round(sum(m * margin_sample_size), 4) AS network_contribution_margin_total, string_agg(store, ',' ORDER BY gross_revenue DESC, store) AS revenue_rank,
  string_agg(store, ',' ORDER BY m * margin_sample_size DESC, store) AS margin_rank,
  string_agg(store, ',' ORDER BY gross_revenue DESC, store) <> string_agg(store, ',' ORDER BY m * margin_sample_size DESC, store) AS rank_differs FROM pnl2""",
    "leaks_total": f"""WITH {_SALES}, m AS (SELECT date_trunc('month', date) AS m, sum(value) AS v FROM sales GROUP BY 1),
l AS (SELECT m, v, lag(v) OVER (ORDER BY m) AS b, lag(m) OVER (ORDER BY m) AS pm FROM m), s AS (SELECT stddev_samp(v - b) AS sd, count(*) AS n FROM l),
x AS (SELECT *, -(v - b) / sd AS sigma FROM l, s WHERE n >= 3 AND sd > 0 AND pm + INTERVAL 1 MONTH = m)
SELECT 'total' AS entity, strftime(m, '%Y-%m') AS period, round(b, 4) AS expected_value, round(v, 4) AS actual_value, round(sigma, 6) AS drop_sigma,
  CASE WHEN sigma >= 3.0 THEN 'high' ELSE 'medium' END AS severity FROM x WHERE sigma >= 2.0""",
    "leaks_product_yoy": f"""WITH {_SALES}, m AS (SELECT product, date_trunc('month', date) AS m, sum(value) AS v FROM sales GROUP BY 1, 2),
t AS (SELECT sum(value) AS total FROM sales), p AS (SELECT product FROM m, t GROUP BY product, total HAVING sum(v) >= total * 0.01::DOUBLE AND count(*) >= 3),
o AS (SELECT a.product, a.m, a.v, avg(b.v) AS others, count(*) AS n FROM m a JOIN p ON a.product = p.product JOIN m b ON a.product = b.product AND month(a.m) = month(b.m) AND a.m <> b.m GROUP BY 1, 2, 3),
r AS (SELECT *, v - others AS res, stddev_samp(v - others) OVER (PARTITION BY product) AS sd, count(*) OVER (PARTITION BY product) AS k FROM o)
SELECT product AS entity, strftime(m, '%Y-%m') AS period, round(others, 4) AS expected_value, round(v, 4) AS actual_value, round(-res / sd, 6) AS drop_sigma,
  CASE WHEN n < 2 THEN 'medium' WHEN -res / sd >= 3.0 THEN 'high' ELSE 'medium' END AS severity, n < 2 AS low_confidence
FROM r WHERE k >= 2 AND sd > 0 AND -res / sd >= 2.0""",
    "churn": f"""WITH {_SALES}, {_CHURN}
SELECT customer, purchase_count, round(avg_cadence_days, 6) AS avg_cadence_days, last_purchase, months_silent, round(historical_value, 4) AS historical_value FROM lost""",
    "product_trend": f"""WITH {_SALES}, mm AS (SELECT DISTINCT date_trunc('month', date) AS m FROM sales),
mid AS (SELECT m AS middle FROM (SELECT m, row_number() OVER (ORDER BY m) - 1 AS i, count(*) OVER () AS n FROM mm) WHERE i = n // 2),
s AS (SELECT *, date_trunc('month', date) < middle AS early FROM sales, mid), st AS (SELECT store FROM s GROUP BY store HAVING bool_or(early) AND bool_or(NOT early)),
c AS (SELECT sum(value) FILTER (early) AS b, sum(value) FILTER (NOT early) AS a FROM s WHERE store IN (SELECT store FROM st)),
p AS (SELECT product, coalesce(sum(value) FILTER (early), 0) AS b, coalesce(sum(value) FILTER (NOT early), 0) AS a, max(date) AS last FROM s GROUP BY product),
g AS (SELECT product, CASE WHEN c.b = 0 THEN 0 ELSE (c.a - c.b) / c.b * 100 END AS cg, CASE WHEN p.b = 0 THEN 0 ELSE (p.a - p.b) / p.b * 100 END AS pg, last FROM p, c)
SELECT product, round(cg, 6) AS company_growth_pct, round(pg, 6) AS product_growth_pct, cg - pg > {T.decoupling_pct} AS decoupled, strftime(last, '%Y-%m') AS last_sale_month FROM g""",
    "seasonality": f"""WITH {_SALES}, m AS (SELECT date_trunc('month', date) AS m, sum(value) AS v FROM sales GROUP BY 1), a AS (SELECT avg(v) AS mean, count(*) AS n FROM m)
SELECT month(m)::INT AS month_of_year, round(avg(v) / mean, 6) AS monthly_index, false AS insufficient_data, n AS months_available FROM m, a GROUP BY 1, mean, n""",
    "rfm_champions": f"""WITH {_SALES}, r AS (SELECT * FROM sales WHERE customer IS NOT NULL AND category IS DISTINCT FROM 'PROMO'),
p AS (SELECT customer, min(date)::DATE AS a, max(date)::DATE AS b, count(DISTINCT date) AS f, sum(value) AS v, (SELECT max(date)::DATE FROM r) AS g FROM r GROUP BY 1),
q AS (SELECT *, date_diff('day', b, g) AS rec, count(*) OVER () AS n FROM p),
k AS (SELECT *, greatest(1, ceil((row_number() OVER (ORDER BY f, customer) - 1) * 5.0::DOUBLE / (n - 1)))::INT AS fs, greatest(1, ceil((row_number() OVER (ORDER BY v, customer) - 1) * 5.0::DOUBLE / (n - 1)))::INT AS ms,
  greatest(1, ceil((row_number() OVER (ORDER BY -rec, customer) - 1) * 5.0::DOUBLE / (n - 1)))::INT AS rs FROM q)
SELECT customer, rec AS recency_days, f AS frequency, round(v, 4) AS monetary, rs AS recency_score, fs AS frequency_score, ms AS monetary_score
FROM k WHERE n >= 5 AND f > 1 AND rec <= date_diff('day', a, b)::DOUBLE / (f - 1) * 2 AND fs = 5 AND ms = 5""",
    "contribution_margin": f"""WITH {_SALES}, {_MARGINS}
SELECT product, round(avg_price, 4) AS avg_price, round(avg_entry_cost, 4) AS avg_entry_cost, round(contribution_margin, 4) AS contribution_margin, sample_size, promotional FROM margins""",
    "customer_concentration": f"""WITH {_SALES}, r AS (SELECT store, sum(value) AS sr FROM sales GROUP BY 1), c AS (SELECT store, customer, sum(value) AS cr, count(*) AS n FROM sales WHERE customer IS NOT NULL GROUP BY 1, 2)
SELECT store, customer, round(cr, 4) AS customer_revenue, n AS sample_size, round(sr, 4) AS store_revenue, round(100 * cr / sr, 6) AS concentration_pct FROM c JOIN r USING (store) WHERE sr <> 0 AND 100 * cr / sr >= {T.concentration_pct}""",
    "salesperson_efficiency": f"""WITH {_SALES}, {_PEOPLE}, md AS (SELECT median(sales_count) AS md FROM sellers2 WHERE ok AND salesperson <> 'VENDEDOR_NAO_IDENTIFICADO')
SELECT salesperson, sales_count, round(revenue, 4) AS revenue, round(capture_pct, 6) AS capture_pct, tenure_days, ok AS has_sufficient_tenure, capture_pct < {T.capture_pct} AS low_capture,
  coalesce(ok AND sales_count < md, false) AS low_volume FROM sellers2, md""",
    "latent_revenue": f"""WITH {_SALES}, f AS (SELECT customer, bool_or(category = 'STANDARD') AS a, bool_or(category = 'ECONOMY') AS t FROM sales WHERE customer IS NOT NULL GROUP BY 1),
k AS (SELECT avg(value) AS ticket FROM sales WHERE customer IS NOT NULL AND category = 'ECONOMY'), c AS (SELECT count(*) FILTER (a) AS e, count(*) FILTER (a AND NOT t) AS nb FROM f)
SELECT 'STANDARD' AS anchor_category, 'ECONOMY' AS target_category, e AS eligible_customers, nb AS non_buyers, round(100.0::DOUBLE * (e - nb) / e, 6) AS attach_rate_pct, round(ticket, 4) AS avg_ticket,
  round(nb * 0.2::DOUBLE * ticket, 4) AS estimated_latent_revenue FROM c, k WHERE nb > 0""",
    "latent_customers": f"""WITH {_SALES} SELECT customer FROM sales WHERE customer IS NOT NULL GROUP BY 1 HAVING bool_or(category = 'STANDARD') AND NOT bool_or(category = 'ECONOMY')""",
    "dead_stock": f"""WITH {_STOCK}, {_DEAD}
SELECT sku_count, round(capital_frozen, 4) AS capital_frozen, round(total_inventory_value, 4) AS total_inventory_value, round(capital_frozen * 100 / total_inventory_value, 6) AS dead_stock_pct FROM frozen WHERE sku_count > 0""",
    "dead_stock_skus": f"""WITH {_STOCK}, {_DEAD} SELECT sku, category, qty AS qty_on_hand, round(cost, 4) AS cost FROM dead WHERE is_dead""",
    "gmroi": f"""WITH {_SALES}, {_STOCK}, v AS (SELECT category, sum(qty * cost) AS iv FROM stock GROUP BY 1), m AS (SELECT category, sum(value - entry_cost) AS gm, count(*) AS n FROM sales GROUP BY 1),
g AS (SELECT category, coalesce(gm, 0) AS gm, iv, coalesce(n, 0) AS n, gm / nullif(iv, 0) AS g FROM v LEFT JOIN m USING (category))
SELECT category, round(gm, 4) AS gross_margin, round(iv, 4) AS avg_inventory_value, n AS sample_size, round(g, 6) AS gmroi, coalesce(max(g) OVER () < 1, true) AS is_directional_only FROM g""",
    "data_completeness": f"""WITH {_CUSTOMERS}, c AS (SELECT count(*) AS n, 100.0::DOUBLE * count(*) FILTER (trim(phone) <> '') / count(*) AS p, 100.0::DOUBLE * count(*) FILTER (trim(document) <> '') / count(*) AS d FROM people)
SELECT n AS total_customers, round(p, 6) AS phone_filled_pct, round(d, 6) AS document_filled_pct, round((p + d) / 2, 6) AS completeness_pct, (p + d) / 2 < 30 AS contingency_triggered FROM c""",
    "cpf_dedupe": f"""WITH {_CUSTOMERS}, k AS (SELECT DISTINCT customer_id, regexp_replace(document, '[^0-9]', '', 'g') AS key FROM people)
SELECT customer_id, min(customer_id) OVER (PARTITION BY key) AS canonical_id FROM k WHERE key <> '' QUALIFY count(*) OVER (PARTITION BY key) > 1""",
    "pseudonyms": f"""WITH {_SALES}, p AS (SELECT customer, round(sum(value), 4) AS v FROM sales WHERE customer IS NOT NULL GROUP BY 1), i AS (SELECT customer, row_number() OVER (ORDER BY v DESC, customer) AS i FROM p)
SELECT customer, 'Client_' || CASE WHEN i > 18278 THEN chr((65 + (i - 18279) // 17576 % 26)::INT) ELSE '' END || CASE WHEN i > 702 THEN chr((65 + (i - 703) // 676 % 26)::INT) ELSE '' END
  || CASE WHEN i > 26 THEN chr((65 + (i - 27) // 26 % 26)::INT) ELSE '' END || chr((65 + (i - 1) % 26)::INT) AS pseudonym FROM i""",
    "service_decomposition": f"""WITH {_SALES}, s AS (SELECT *, category IS NOT DISTINCT FROM 'PROMO' AS svc FROM sales),
mg AS (SELECT store, coalesce(sum(value * 0.85::DOUBLE - entry_cost) FILTER (NOT svc AND value > 0), 0) AS pm, coalesce(sum(value * 0.85::DOUBLE - entry_cost) FILTER (svc AND value > 0), 0) AS sm FROM s GROUP BY 1),
fc AS (SELECT store, customer, arg_min(category, (date, source_row, category)) AS c, coalesce(sum(value) FILTER (NOT svc), 0) AS b FROM s WHERE customer IS NOT NULL GROUP BY 1, 2), fo AS (SELECT store, sum(b) AS f FROM fc WHERE c = 'PROMO' GROUP BY 1)
SELECT store, round(pm, 6) AS product_margin, round(sm, 6) AS service_margin, round(pm + sm, 6) AS total_margin, pm < 0 AND pm + sm > 0 AS masks_negative_product_margin, round(coalesce(f, 0), 4) AS follow_on_effect FROM mg LEFT JOIN fo USING (store)""",
    "service_reconciliation": f"""WITH {_SALES}, a AS (SELECT store, strftime(date, '%Y-%m') AS period, sum(value) AS v FROM sales WHERE category = 'PROMO' GROUP BY 1, 2),
f AS (SELECT store, period, v, v + CASE WHEN period[6:7] = '12' THEN 1000.0::DOUBLE ELSE 0.25::DOUBLE END AS d FROM a)
SELECT store, period, round(d, 4) AS declared_revenue, round(v, 4) AS transactional_revenue, round(d - v, 4) AS gap, abs(d - v) > 1 AS has_gap FROM f""",
    "executive_totals": f"""WITH {_SALES}, {_STOCK}, {_DEAD}, {_MARGINS}, {_CHURN},
x AS (SELECT 'act-operational' AS id, 'operational' AS nature, 1 AS tier, coalesce(sum(abs(contribution_margin)) FILTER (NOT promotional), 0) AS impact FROM margins
  UNION ALL SELECT 'act-capital', 'capital', 2, coalesce(max(capital_frozen), 0) FROM frozen UNION ALL SELECT 'act-ltv', 'ltv_risk', 3, coalesce(sum(greatest(0, historical_value)), 0) FROM lost)
SELECT id, nature, tier, round(impact, 4) AS impact FROM x WHERE impact > 0""",
    "discarded_alarms": f"""WITH {_SALES}, {_PNL}, {_PEOPLE}
SELECT 'salesperson_ramp' AS category, salesperson AS entity, tenure_days::DOUBLE AS measure FROM sellers2 WHERE NOT ok UNION ALL SELECT 'store_cold_start', store, round(months_of_history, 6) FROM pnl2 WHERE NOT ok""",
    "winsorise": f"""WITH {_SALES}, c AS (SELECT product, quantile_cont(value, 0.5) * {T.outlier_ratio} AS cap FROM sales WHERE value > 0 GROUP BY 1 HAVING count(*) >= 2)
SELECT product, source_row, round(value, 4) AS original_value, round(cap, 4) AS capped_value FROM sales JOIN c USING (product) WHERE value > cap""",
    "silence_by_month": f"""WITH {_SALES}, {_CHURN} SELECT substr(last_purchase, 1, 7) AS period, count(*) AS customers, round(sum(historical_value), 4) AS value FROM lost GROUP BY 1""",
}

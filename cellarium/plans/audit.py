"""The whole audit: load, cap outliers, merge customer ids, run every detector, give pseudonyms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.operators import audit as A
from cellarium.operators import cleaning as C
from cellarium.operators.thresholds import Thresholds
from cellarium.session import cut
from cellarium.sources import tables, xlsx

# Sheets that hold side tables.
SIDE_SHEETS = {"estoque": "stock", "clientes": "customers", "financeiro": "finance"}
SIDE = {
    "stock": (C.STOCK_ROLES, ("cost", "qty_on_hand"), ("last_movement",)), "customers": (C.CUSTOMER_ROLES, (), ()), "finance": (C.FINANCE_ROLES, ("service_revenue",), ()),
}
#: How far frozen capital by item may be from its total.
TOLERANCE = 0.05


def with_canonical_customers(sales: DataFrame, customers: DataFrame) -> DataFrame:
    """sales in which ids that share a document are one customer."""
    ids = A.canonical_ids(customers).withColumnRenamed("customer_id", "customer")
    return sales.join(ids, "customer", "left").withColumn("customer", F.coalesce("canonical_id", "customer")).drop("canonical_id")


def run_audit(
    sales: DataFrame, stock: DataFrame | None = None, customers: DataFrame | None = None, finance: DataFrame | None = None,
    thresholds: Thresholds | None = None, anonymous: bool = False,
) -> dict[str, DataFrame]:
    """A frame for each kind of finding; those that need a missing table are left out.

    The cleaned sales are cut once, as all detectors read them. Pseudonyms replace customers in the findings if asked for;
    the frame "identities" says whose they are, and should be kept apart."""
    t = thresholds or Thresholds()
    if customers is not None:
        sales = with_canonical_customers(sales, customers)
    capped = cut(A.winsorised(sales, t))
    sales = capped.drop("original_value", "cap")
    out = {
        "outliers": capped.filter("original_value > cap").select("product", "source_file", "source_row", "original_value", "value"),
        "leaks_total": A.leaks_total(sales, t), "leaks_by_product": A.leaks_by_product(sales, t), "churn": A.churn(sales, t), "product_trends": A.product_trends(sales, t),
        "seasonality": A.seasonality(sales, t), "rfm_champions": A.rfm_champions(sales, t), "contribution_margin": A.contribution_margin(sales, t), "store_pnl": A.store_pnl(sales, t),
        "customer_concentration": A.customer_concentration(sales, t), "salesperson_performance": A.salesperson_performance(sales, t), "latent_revenue": A.latent_revenue(sales, t),
        "latent_customers": A.latent_customers(sales, t), "service_decomposition": A.service_decomposition(sales, t),
    }
    out["store_macro"] = A.store_macro(out["store_pnl"])
    out["discarded_alarms"] = A.discarded_alarms(out["salesperson_performance"], out["store_pnl"])
    dead = sales.sparkSession.createDataFrame([], "capital_frozen double")
    if stock is not None:
        out["dead_stock"], out["dead_skus"], out["gmroi"] = A.dead_stock(stock, t), A.dead_skus(stock, t), A.gmroi(sales, stock, t)
        dead = out["dead_stock"]
    if customers is not None:
        out["data_completeness"] = A.data_completeness(customers, t)
    if finance is not None:
        out["service_reconciliation"] = A.service_reconciliation(sales, finance, t)
    out["executive_totals"] = A.executive_totals(out["contribution_margin"], dead, out["churn"])
    if anonymous:
        names = cut(A.pseudonyms(sales))
        for key, df in out.items():
            if "customer" in df.columns:
                out[key] = df.join(names, "customer", "left").withColumn("customer", F.coalesce("pseudonym", "customer")).drop("pseudonym")
        out["identities"] = names
    return out


def frozen_capital(dead_skus: DataFrame, stock: DataFrame, by: list[str]) -> DataFrame:
    """Capital of dead items by columns of the stock; raises if an item is not in the stock."""
    if missing := dead_skus.join(stock, "sku", "left_anti").limit(1).count():
        raise ValueError(f"{missing} or more items are not in the stock")
    rows = stock.join(dead_skus.select("sku").distinct(), "sku", "left_semi")
    return rows.groupBy(*by).agg(F.sum(F.col("qty_on_hand") * F.col("cost")).alias("capital"), F.count("*").alias("items"))


def reconciled(dead: DataFrame, by_item: DataFrame) -> DataFrame:
    """total, by_item, difference and whether it is within TOLERANCE: frozen capital of dead_stock() beside that of frozen_capital()."""
    parts = by_item.agg(F.coalesce(F.sum("capital"), F.lit(0.0)).alias("by_item"))
    both = dead.agg(F.coalesce(F.sum("capital_frozen"), F.lit(0.0)).alias("total")).crossJoin(parts)  # two rows
    return both.withColumn("difference", F.col("by_item") - F.col("total")).withColumn("reconciled", F.abs("difference") <= TOLERANCE)


def folder(spark: SparkSession, path: str, mapping: dict[str, str] | None = None) -> tuple[C.Loaded, dict[str, DataFrame], list[tuple[str, str]]]:
    """Sales with their discards, side tables by name, and what was skipped with its reason, of the CSV files and workbooks
    under path. Sheets named as in SIDE_SHEETS are side tables, all others sales; sheets with the same side table are united."""
    files = sorted(r.path for r in spark.read.format("binaryFile").load(path).select("path").collect())  # names only
    loaded, skipped = tables.sales_folder(spark, [f for f in files if f.lower().endswith(".csv")], mapping)
    accepted, discarded, side = [loaded.accepted], [loaded.discarded], {}
    for file in files:
        if not file.lower().endswith(".xlsx"):
            skipped += [] if file.lower().endswith(".csv") else [(file, "neither csv nor xlsx")]
            continue
        cells = cut(xlsx.cells(spark, file))
        for sheet, width in sorted((r.sheet, r.width) for r in cells.groupBy("sheet").agg(F.max("col").alias("width")).collect()):
            raw = tables.named(*xlsx.grid(cells, sheet, width))
            name = SIDE_SHEETS.get(C.plain(sheet).strip())
            try:
                if name:
                    roles, numbers, dated = SIDE[name]
                    found = C.by_roles(_dated(raw.drop("row_no"), roles, dated), roles, C.REQUIRED[name], numbers, dated)
                    side[name] = side[name].unionByName(found, allowMissingColumns=True) if name in side else found
                else:
                    more = C.load_sales(_dated(raw, C.SALES_ROLES, ("date",)), f"{file}#{sheet}", mapping)
                    accepted.append(more.accepted)
                    discarded.append(more.discarded)
            except (C.MissingRole, C.AmbiguousDates) as e:
                skipped.append((f"{file}#{sheet}", str(e)))
    for df in accepted[1:]:
        accepted[0] = accepted[0].unionByName(df)
    for df in discarded[1:]:
        discarded[0] = discarded[0].unionByName(df)
    return C.Loaded(accepted[0], discarded[0]), side, skipped


def _dated(raw: DataFrame, words: dict[str, tuple[str, ...]], dated: tuple[str, ...]) -> DataFrame:
    """raw with serial numbers in columns of dates as ISO dates, as workbooks keep them."""
    role = C.roles([c for c in raw.columns if c != "row_no"], words, ())
    for column in (role[r] for r in dated if r in role):
        c = F.col(f"`{column}`")
        serial = F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), F.floor(c.try_cast("double")).cast("int")), "yyyy-MM-dd")
        raw = raw.withColumn(column, F.when(c.rlike(r"^[0-9]{4,5}([.][0-9]+)?$"), serial).otherwise(c))
    return raw


def audit_folder(spark: SparkSession, path: str, thresholds: Thresholds | None = None, mapping: dict[str, str] | None = None, anonymous: bool = False) -> dict[str, DataFrame]:
    """run_audit() over the CSV files and workbooks under path, with "discards" by reason and "skipped" sources beside it."""
    loaded, side, skipped = folder(spark, path, mapping)
    stock, customers = side.get("stock"), side.get("customers")
    if stock is not None and "category" not in stock.columns:
        stock = stock.withColumn("category", F.lit(None).cast("string"))
    for c in ("phone", "document"):
        if customers is not None and c not in customers.columns:
            customers = customers.withColumn(c, F.lit(None).cast("string"))
    out = run_audit(loaded.accepted, stock, customers, side.get("finance"), thresholds, anonymous)
    return out | {"discards": loaded.summary(), "skipped": spark.createDataFrame(skipped, "source string, reason string")}

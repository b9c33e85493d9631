"""The commercial detectors, one function each.

All take a sales frame (columns SALES) and a Thresholds. A detector is one plan: a grouped aggregate or two, windows over
what these have left, and joins with their small results; nothing is collected. Each returns its columns on empty
input, too. Null customers, stores and salespeople count as the placeholders of thresholds.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellarium.operators.ranges import quantiles, ranked
from cellarium.operators.thresholds import DAYS_PER_MONTH, NO_CUSTOMER, NO_SALESPERSON, NO_STORE, PLACEHOLDERS, Thresholds
from cellarium.session import cut

SALES = (
    "date timestamp_ntz, product string, customer string, value double, quantity double, entry_cost double, category string, "
    "store string, salesperson string, payment_method string, source_file string, source_row long"
)


def month(date: Column) -> Column:
    return F.trunc(date, "month")


def month_text(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def month_number(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date)


def known(name: Column, placeholder: str) -> Column:
    """True where the name is a person's or a place's own."""
    return ~F.coalesce(name, F.lit(placeholder)).isin(*PLACEHOLDERS)


def not_service(t: Thresholds) -> Column:
    """Rows of other categories than service; unknown ones stay."""
    return ~F.col("category").eqNullSafe(F.lit(t.service_category))


def priced(with_service: bool = True, t: Thresholds | None = None) -> Column:
    """Sales with a price and a cost: no refunds."""
    out = F.col("entry_cost").isNotNull() & (F.col("value") > 0)
    return out if with_service else out & not_service(t)


def _severity(sigma: Column, t: Thresholds) -> Column:
    return F.when(sigma >= t.leak_sigma * 1.5, "high").otherwise("medium")


def leaks_total(sales: DataFrame, t: Thresholds) -> DataFrame:
    """Months whose revenue fell by more than leak_sigma deviations of the series' own changes."""
    months = sales.groupBy(month(F.col("date")).alias("m")).agg(F.sum("value").alias("v"))
    # A row a month: ordering them all in one task is ordering the calendar.
    by_time, everything = Window.orderBy("m"), Window.partitionBy(F.lit(0))
    series = months.select("m", "v", F.lag("v").over(by_time).alias("before"), F.lag("m").over(by_time).alias("pm"))
    series = series.withColumns({"std": F.stddev_samp(F.col("v") - F.col("before")).over(everything), "n": F.count("*").over(everything)})
    sigma = F.col("sigma")
    found = series.filter("n >= 3 AND std > 0 AND add_months(pm, 1) = m").withColumn("sigma", -(F.col("v") - F.col("before")) / F.col("std"))
    return found.filter(sigma >= t.leak_sigma).select(
        F.lit("total").alias("entity"), month_text(F.col("m")).alias("period"), F.col("before").alias("expected_value"), F.col("v").alias("actual_value"),
        sigma.alias("drop_sigma"), _severity(sigma, t).alias("severity"),
    )


def leaks_by_product(sales: DataFrame, t: Thresholds) -> DataFrame:
    """Months of material products far below the same month of other years (leave-one-out)."""
    # Cut, so that sales are read once; the total is that of the groups.
    every = cut(sales.groupBy("product", month(F.col("date")).alias("m")).agg(F.sum("value").alias("v")))
    series, total = every.filter("product IS NOT NULL"), every.agg(F.sum("v").alias("total"))
    product, year = Window.partitionBy("product"), Window.partitionBy("product", F.month("m"))
    series = series.crossJoin(F.broadcast(total))  # one row
    series = series.withColumns({"own": F.sum("v").over(product), "months": F.count("*").over(product), "others": F.count("*").over(year) - 1, "same": F.sum("v").over(year)})
    series = series.filter(F.col("own") >= F.col("total") * t.materiality_pct / 100.0).filter("months >= 3 AND others > 0")
    rest = series.withColumn("residual", F.col("v") - (F.col("same") - F.col("v")) / F.col("others"))
    rest = rest.withColumns({"std": F.stddev_samp("residual").over(product), "n": F.count("*").over(product)})
    rest = rest.filter("n >= 2 AND std > 0").withColumn("sigma", -F.col("residual") / F.col("std"))
    low = F.col("others") < 2
    return rest.filter(F.col("sigma") >= t.leak_sigma).select(
        F.col("product").alias("entity"), month_text(F.col("m")).alias("period"), (F.col("v") - F.col("residual")).alias("expected_value"),
        F.col("v").alias("actual_value"), F.col("sigma").alias("drop_sigma"),
        F.when(low, "medium").otherwise(_severity(F.col("sigma"), t)).alias("severity"), low.alias("low_confidence"),
    )


def churn(sales: DataFrame, t: Thresholds) -> DataFrame:
    """Customers silent for longer than their own cadence allows."""
    # Sums by day first, as a customer buys several things a day. Cut, so that sales are read once: the last day of all is that of the
    # groups, those without a customer's name among them.
    days = sales.groupBy("customer", F.to_date("date").alias("day")).agg(F.sum("value").alias("value"))
    every = cut(days.groupBy("customer").agg(F.count("day").alias("purchase_count"), F.min("day").alias("first"), F.max("day").alias("last"), F.sum("value").alias("historical_value")))
    last_day = every.agg(F.max("last").alias("last_day"))
    people = every.filter(known(F.col("customer"), NO_CUSTOMER)).filter((F.col("purchase_count") >= t.churn_purchases) & (F.col("purchase_count") > 1)).crossJoin(F.broadcast(last_day))
    cadence = F.datediff("last", "first") / (F.col("purchase_count") - 1)
    silent = month_number(F.col("last_day")) - month_number(F.col("last"))
    people = people.withColumns({"avg_cadence_days": cadence, "months_silent": silent})
    gone = F.datediff("last_day", "last") > t.churn_cadence * F.col("avg_cadence_days")
    return people.filter(gone & (F.col("months_silent") >= t.churn_silent_months)).select(
        "customer", "purchase_count", "avg_cadence_days", F.date_format("last", "yyyy-MM-dd").alias("last_purchase"), "months_silent", "historical_value"
    )


def _growth(before: Column, after: Column) -> Column:
    return F.when(before == 0, F.lit(0.0)).otherwise((after - before) / before * 100.0)


def product_trends(sales: DataFrame, t: Thresholds) -> DataFrame:
    """Growth of each product from the first half of the months to the second, beside the company's in stores open in both."""
    # Cut, so that sales are read once; months, stores and products are sums of these groups.
    sums = cut(sales.groupBy("product", "store", month(F.col("date")).alias("m")).agg(F.sum("value").alias("value")))
    months = sums.select("m").distinct()
    numbered = months.withColumns({"i": F.row_number().over(Window.orderBy("m")) - 1, "n": F.count("*").over(Window.partitionBy(F.lit(0)))})
    middle = F.broadcast(numbered.filter(F.col("i") == F.floor(F.col("n") / 2)).select(F.col("m").alias("middle")))  # one row
    early = F.col("m") < F.col("middle")
    halves = [F.sum(F.when(early, F.col("value")).otherwise(0.0)).alias("before"), F.sum(F.when(~early, F.col("value")).otherwise(0.0)).alias("after")]
    split = sums.crossJoin(middle)
    stores = split.groupBy("store").agg(*halves, F.bool_or(early).alias("x"), F.bool_or(~early).alias("y"))
    company = stores.filter("x AND y").agg(F.coalesce(F.sum("before"), F.lit(0.0)).alias("b"), F.coalesce(F.sum("after"), F.lit(0.0)).alias("a"))
    company = company.select(_growth(F.col("b"), F.col("a")).alias("company_growth_pct"))
    products = split.filter("product IS NOT NULL").groupBy("product").agg(*halves, F.max("m").alias("last"))
    products = products.crossJoin(F.broadcast(company)).withColumn("product_growth_pct", _growth(F.col("before"), F.col("after")))
    apart = (F.col("company_growth_pct") - F.col("product_growth_pct") > t.decoupling_pct) & F.lit(t.decoupling_pct > 0)
    return products.select("product", "company_growth_pct", "product_growth_pct", apart.alias("decoupled"), month_text(F.col("last")).alias("last_sale_month"))


def seasonality(sales: DataFrame, t: Thresholds) -> DataFrame:
    """Index of each month of the year; one row that says so if there are too few months."""
    months = sales.groupBy(month(F.col("date")).alias("m")).agg(F.sum("value").alias("v")).filter("m IS NOT NULL")
    everything = Window.partitionBy(F.lit(0))
    months = months.withColumns({"n": F.count("*").over(everything), "mean": F.avg("v").over(everything)})
    enough = F.col("n") >= t.season_months
    grouped = months.groupBy(F.when(enough, F.month("m")).alias("month_of_year"), (~enough).alias("insufficient_data"), F.col("n").alias("months_available"))
    index = F.when(F.first("mean") == 0, 0.0).otherwise(F.avg("v") / F.first("mean"))
    return grouped.agg(index.alias("x")).select("month_of_year", F.when(~F.col("insufficient_data"), F.col("x")).alias("monthly_index"), "insufficient_data", "months_available")


def quantile_score(rank: Column, n: Column, bins: int) -> Column:
    """The bin of the rank-th of n values when they are cut at equal quantiles of their ranks."""
    return F.greatest(F.lit(1), F.ceil((rank - 1) * F.lit(bins) / (n - 1))).cast("int")


def rfm_champions(sales: DataFrame, t: Thresholds) -> DataFrame:
    """Active customers in the top bin by frequency and by money. Ranks are taken in ranges, so no task sorts all customers."""
    rows = sales.filter(known(F.col("customer"), NO_CUSTOMER) & not_service(t))
    people = rows.groupBy("customer").agg(
        F.min("date").alias("first"), F.max("date").alias("last"), F.count_distinct("date").alias("frequency"), F.sum("value").alias("monetary")
    )
    # Cut once: the newest day is the groups', and each ranking looks at its rows twice, for the bounds of the ranges and to deal them out.
    people = cut(people)
    people = people.crossJoin(F.broadcast(people.agg(F.max("last").alias("newest"))))
    people = people.withColumns({"recency_days": F.datediff("newest", "last"), "_r": -F.datediff("newest", "last")})
    for name, by in (("fs", "frequency"), ("ms", "monetary"), ("rs", "_r")):
        people = ranked(people, [by, "customer"], name)
    people = people.crossJoin(F.broadcast(people.agg(F.count("*").alias("n"))))
    people = people.withColumns({c: quantile_score(F.col(c), F.col("n"), t.rfm_bins) for c in ("fs", "ms", "rs")})
    active = (F.col("frequency") > 1) & (F.col("recency_days") <= F.datediff("last", "first") / (F.col("frequency") - 1) * t.churn_cadence)
    return people.filter((F.col("n") >= t.rfm_bins) & active & (F.col("fs") == t.rfm_bins) & (F.col("ms") == t.rfm_bins)).select(
        "customer", "recency_days", "frequency", "monetary", F.col("rs").alias("recency_score"), F.col("fs").alias("frequency_score"), F.col("ms").alias("monetary_score")
    )


def _unit_margin(t: Thresholds) -> Column:
    return F.col("avg_price") - F.col("avg_entry_cost") - F.col("avg_price") * t.variable_cost_pct / 100.0


def contribution_margin(sales: DataFrame, t: Thresholds) -> DataFrame:
    """Products sold at a loss on average; promotional if all their sales were."""
    promo = F.coalesce(F.lower(F.trim("payment_method")) == t.promo_payment.strip().lower(), F.lit(False))
    rows = sales.filter(priced(False, t)).filter("product IS NOT NULL").groupBy("product").agg(
        F.avg("value").alias("avg_price"), F.avg("entry_cost").alias("avg_entry_cost"), F.count("*").alias("sample_size"), F.bool_and(promo).alias("promotional")
    )
    return rows.withColumn("contribution_margin", _unit_margin(t)).filter("contribution_margin < 0").select(
        "product", "avg_price", "avg_entry_cost", "contribution_margin", "sample_size", "promotional"
    )


def store_pnl(sales: DataFrame, t: Thresholds) -> DataFrame:
    """Revenue, margin and length of history of each store, from one pass."""
    use = priced()
    rows = sales.groupBy(F.coalesce("store", F.lit(NO_STORE)).alias("store")).agg(
        F.sum("value").alias("gross_revenue"), F.count("*").alias("revenue_sample_size"), F.coalesce(F.avg(F.when(use, F.col("value"))), F.lit(0.0)).alias("avg_price"),
        F.coalesce(F.avg(F.when(use, F.col("entry_cost"))), F.lit(0.0)).alias("avg_entry_cost"), F.count_if(use).alias("margin_sample_size"),
        F.datediff(F.max("date"), F.min("date")).alias("days"), F.max("store").alias("named"),
    )
    rows = rows.withColumn("any", F.max("named").over(Window.partitionBy(F.lit(0)))).filter("any IS NOT NULL")
    rows = rows.withColumns({"contribution_margin_avg": _unit_margin(t), "months_of_history": F.col("days") / DAYS_PER_MONTH})
    return rows.withColumns({
        "contribution_margin_total": F.col("contribution_margin_avg") * F.col("margin_sample_size"),
        "has_sufficient_history": F.col("months_of_history") >= t.cold_start_months,
    }).drop("days", "named", "any")


def store_macro(pnl: DataFrame) -> DataFrame:
    """One row over the stores: rankings by revenue and margin, and the losses that the sum hides."""
    by = lambda c: F.transform(F.array_sort(F.collect_list(F.struct((-F.col(c)).alias("k"), "store"))), lambda x: x["store"])
    negative = (F.col("contribution_margin_total") < 0) & F.col("has_sufficient_history")
    out = pnl.agg(
        F.array_sort(F.collect_list(F.when(negative, F.col("store")))).alias("stores_with_negative_margin"),
        F.coalesce(F.sum(F.when(negative, -F.col("contribution_margin_total"))), F.lit(0.0)).alias("masked_amount"),
        F.sum("contribution_margin_total").alias("network_contribution_margin_total"), by("gross_revenue").alias("revenue_rank"),
        by("contribution_margin_total").alias("margin_rank"), F.count("*").alias("n"),
    )
    return out.filter("n > 0").drop("n").withColumn("rank_differs", F.col("revenue_rank") != F.col("margin_rank"))


def customer_concentration(sales: DataFrame, t: Thresholds) -> DataFrame:
    """Customers who make a large share of a store's whole revenue."""
    groups = sales.groupBy(F.coalesce("store", F.lit(NO_STORE)).alias("store"), F.coalesce("customer", F.lit(NO_CUSTOMER)).alias("customer")).agg(
        F.sum("value").alias("customer_revenue"), F.count("value").alias("sample_size")
    )
    groups = groups.join(groups.groupBy("store").agg(F.sum("customer_revenue").alias("store_revenue")), "store")  # a store may hold very many
    groups = groups.select("store", "customer", "customer_revenue", "sample_size", "store_revenue").filter(known(F.col("customer"), NO_CUSTOMER) & (F.col("store_revenue") != 0))
    return groups.withColumn("concentration_pct", 100.0 * F.col("customer_revenue") / F.col("store_revenue")).filter(F.col("concentration_pct") >= t.concentration_pct)


def salesperson_performance(sales: DataFrame, t: Thresholds) -> DataFrame:
    """Share of sales with a known customer, and volume beside the median of the experienced."""
    people = sales.groupBy(F.coalesce("salesperson", F.lit(NO_SALESPERSON)).alias("salesperson")).agg(
        F.count("*").alias("sales_count"), F.sum("value").alias("revenue"), F.count_if(known(F.col("customer"), NO_CUSTOMER)).alias("captured"), F.min("date").alias("first")
    )
    people = people.crossJoin(F.broadcast(sales.agg(F.max("date").alias("newest"))))
    people = people.withColumns({"capture_pct": 100.0 * F.col("captured") / F.col("sales_count"), "tenure_days": F.datediff("newest", "first")})
    people = people.withColumn("has_sufficient_tenure", F.col("tenure_days") >= t.ramp_days)
    peers = people.filter(F.col("has_sufficient_tenure") & known(F.col("salesperson"), NO_SALESPERSON)).agg(F.median("sales_count").alias("median_sales"))
    people = people.crossJoin(F.broadcast(peers))
    return people.select(
        "salesperson", "sales_count", "revenue", "capture_pct", "tenure_days", "has_sufficient_tenure", (F.col("capture_pct") < t.capture_pct).alias("low_capture"),
        F.coalesce(F.col("has_sufficient_tenure") & (F.col("sales_count") < F.col("median_sales")), F.lit(False)).alias("low_volume"),
    )


def latent_customers(sales: DataFrame, t: Thresholds) -> DataFrame:
    """Customers of the anchor category who never bought the target category: customer."""
    rows = sales.filter(known(F.col("customer"), NO_CUSTOMER))
    flags = rows.groupBy("customer").agg(
        F.bool_or(F.coalesce(F.col("category") == t.anchor_category, F.lit(False))).alias("anchor"),
        F.bool_or(F.coalesce(F.col("category") == t.target_category, F.lit(False))).alias("target"),
    )
    return flags.filter("anchor AND NOT target").select("customer")


def latent_revenue(sales: DataFrame, t: Thresholds) -> DataFrame:
    """What non-buyers of the target category would bring at the assumed conversion."""
    rows = sales.filter(known(F.col("customer"), NO_CUSTOMER))
    target = F.coalesce(F.col("category") == t.target_category, F.lit(False))
    flags = rows.groupBy("customer").agg(
        F.bool_or(F.coalesce(F.col("category") == t.anchor_category, F.lit(False))).alias("anchor"), F.bool_or(target).alias("target"),
        F.sum(F.when(target, F.col("value"))).alias("s"), F.count(F.when(target, F.col("value"))).alias("n"),
    )
    out = flags.agg(
        F.count_if("anchor").alias("eligible_customers"), F.count_if(F.col("anchor") & ~F.col("target")).alias("non_buyers"),
        F.count_if(F.col("anchor") & F.col("target")).alias("buyers"), F.coalesce(F.try_divide(F.sum("s"), F.sum("n")), F.lit(0.0)).alias("avg_ticket"),
    )
    return out.filter("non_buyers > 0").select(
        F.lit(t.anchor_category).alias("anchor_category"), F.lit(t.target_category).alias("target_category"), "eligible_customers", "non_buyers",
        (100.0 * F.col("buyers") / F.col("eligible_customers")).alias("attach_rate_pct"), "avg_ticket",
        (F.col("non_buyers") * t.conversion_pct / 100.0 * F.col("avg_ticket")).alias("estimated_latent_revenue"),
    )


def dead_stock(stock: DataFrame, t: Thresholds) -> DataFrame:
    """One row on stock(sku, cost, qty_on_hand, last_movement) without movement for too many months."""
    rows = stock.select("sku", "cost", "qty_on_hand", "last_movement").dropna()
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("last_movement").alias("newest"))))
    dead = month_number(F.col("newest")) - month_number(F.col("last_movement")) >= t.dead_stock_months
    capital = F.col("qty_on_hand") * F.col("cost")
    out = rows.agg(F.count_if(dead).alias("sku_count"), F.sum(F.when(dead, capital)).alias("capital_frozen"), F.sum(capital).alias("total_inventory_value"))
    share = F.coalesce(F.try_divide(F.col("capital_frozen") * 100.0, F.col("total_inventory_value")), F.lit(0.0))
    return out.filter("sku_count > 0").withColumn("dead_stock_pct", share)


def dead_skus(stock: DataFrame, t: Thresholds) -> DataFrame:
    """The items themselves, which may be many: rows of stock."""
    rows = stock.dropna(subset=["sku", "cost", "qty_on_hand", "last_movement"])
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("last_movement").alias("newest"))))
    return rows.filter(month_number(F.col("newest")) - month_number(F.col("last_movement")) >= t.dead_stock_months).drop("newest")


def gmroi(sales: DataFrame, stock: DataFrame, t: Thresholds) -> DataFrame:
    """Gross margin over inventory value by category; directional only if no category reaches 1."""
    value = stock.dropna(subset=["category", "cost", "qty_on_hand"]).groupBy("category").agg(F.sum(F.col("qty_on_hand") * F.col("cost")).alias("avg_inventory_value"))
    value = value.filter(F.lower("category") != "servico")
    margin = sales.dropna(subset=["category", "entry_cost"]).groupBy("category").agg(F.sum(F.col("value") - F.col("entry_cost")).alias("m"), F.count("*").alias("n"))
    out = value.join(margin, "category", "left").select(
        "category", F.coalesce("m", F.lit(0.0)).alias("gross_margin"), "avg_inventory_value", F.coalesce("n", F.lit(0).cast("long")).alias("sample_size")
    )
    out = out.withColumn("gmroi", F.try_divide("gross_margin", "avg_inventory_value"))
    best = F.max("gmroi").over(Window.partitionBy(F.lit(0)))
    return out.withColumn("is_directional_only", F.coalesce(best < 1.0, F.lit(True)))


def data_completeness(customers: DataFrame, t: Thresholds) -> DataFrame:
    """One row on how many of customers(phone, document) have both."""
    filled = lambda c: 100.0 * F.count_if(F.coalesce(F.trim(c) != "", F.lit(False))) / F.count("*")
    out = customers.agg(F.count("*").alias("total_customers"), filled("phone").alias("phone_filled_pct"), filled("document").alias("document_filled_pct"))
    out = out.filter("total_customers > 0").withColumn("completeness_pct", (F.col("phone_filled_pct") + F.col("document_filled_pct")) / 2)
    return out.withColumn("contingency_triggered", F.col("completeness_pct") < t.completeness_pct)


def canonical_ids(customers: DataFrame) -> DataFrame:
    """customer_id, canonical_id of ids that share the digits of a document with another id."""
    rows = customers.select("customer_id", F.regexp_replace("document", r"\D", "").alias("key")).filter("customer_id IS NOT NULL AND key <> ''").distinct()
    shared = rows.groupBy("key").agg(F.min("customer_id").alias("canonical_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return rows.join(shared, "key").groupBy("customer_id").agg(F.min("canonical_id").alias("canonical_id"))


def pseudonyms(sales: DataFrame) -> DataFrame:
    """customer, pseudonym (Client_A, ... Client_Z, Client_AA, ...) by falling revenue, then name."""
    people = sales.filter(known(F.col("customer"), NO_CUSTOMER)).groupBy("customer").agg(F.round(F.sum("value"), 4).alias("v"))
    numbered = ranked(people, [F.desc("v"), "customer"], "i")
    letters = F.lit("")
    digits, left = [], F.col("i")
    for _ in range(7):  # 26**7 customers
        digits.append(F.when(left > 0, F.chr(65 + (left - 1) % 26)).otherwise(""))
        left = F.floor((left - 1) / 26)
    for d in digits:
        letters = F.concat(d, letters)
    return numbered.select("customer", F.concat(F.lit("Client_"), letters).alias("pseudonym"))


def service_decomposition(sales: DataFrame, t: Thresholds) -> DataFrame:
    """Product and service margin of each store, and what customers who began with service went on to buy."""
    rows = sales.withColumns({"store": F.coalesce("store", F.lit(NO_STORE)), "service": F.col("category").eqNullSafe(F.lit(t.service_category))})
    own = known(F.col("customer"), NO_CUSTOMER)
    when = F.struct("date", "source_file", "source_row", "category")  # a full order: equal rows do not matter

    def total(use: Column) -> Column:
        price = lambda c: F.coalesce(F.sum(F.when(use & priced(), F.col(c))), F.lit(0.0))
        return price("value") * (1 - t.variable_cost_pct / 100.0) - price("entry_cost")

    # By customer first, known or not, and cut, so that sales are read once.
    people = cut(rows.groupBy("store", "customer").agg(
        total(~F.col("service")).alias("product_margin"), total(F.col("service")).alias("service_margin"),
        F.min_by(F.when(F.col("category").isNotNull(), F.col("category")), F.when(F.col("category").isNotNull(), when)).alias("first_category"),
        F.sum(F.when(~F.col("service"), F.col("value")).otherwise(0.0)).alias("bought"),
    ))
    margins = people.groupBy("store").agg(F.sum("product_margin").alias("product_margin"), F.sum("service_margin").alias("service_margin"))
    follow = people.filter(own & (F.col("first_category") == t.service_category)).groupBy("store").agg(F.sum("bought").alias("follow"))
    out = margins.join(follow, "store", "left").withColumn("total_margin", F.col("product_margin") + F.col("service_margin"))
    return out.select(
        "store", "product_margin", "service_margin", "total_margin", ((F.col("product_margin") < 0) & (F.col("total_margin") > 0)).alias("masks_negative_product_margin"),
        F.coalesce("follow", F.lit(0.0)).alias("follow_on_effect"),
    )


def service_reconciliation(sales: DataFrame, finance: DataFrame, t: Thresholds) -> DataFrame:
    """Declared service revenue of finance(store, period, service_revenue) beside what sales hold."""
    actual = sales.filter(F.col("category") == t.service_category).groupBy(F.coalesce("store", F.lit(NO_STORE)).alias("store"), month_text(F.col("date")).alias("period")).agg(F.sum("value").alias("v"))
    declared = finance.filter("service_revenue IS NOT NULL").select("store", F.trim("period").alias("period"), F.col("service_revenue").alias("declared_revenue"))
    out = declared.join(actual, ["store", "period"], "left").withColumn("transactional_revenue", F.coalesce("v", F.lit(0.0))).drop("v")
    out = out.withColumn("gap", F.col("declared_revenue") - F.col("transactional_revenue"))
    return out.withColumn("has_gap", F.abs("gap") > t.reconciliation_tolerance)


def executive_totals(margins: DataFrame, dead: DataFrame, lost: DataFrame) -> DataFrame:
    """Up to three action items, by tier; their amounts are of different kinds and are never added up."""
    loss = margins.agg(F.coalesce(F.sum(F.when(~F.col("promotional"), F.abs("contribution_margin"))), F.lit(0.0)).alias("impact"))
    frozen = dead.agg(F.coalesce(F.max("capital_frozen"), F.lit(0.0)).alias("impact"))
    risk = lost.agg(F.coalesce(F.sum(F.greatest(F.lit(0.0), F.col("historical_value"))), F.lit(0.0)).alias("impact"))
    parts = [(loss, "act-operational", "operational", 1), (frozen, "act-capital", "capital", 2), (risk, "act-ltv", "ltv_risk", 3)]
    items = [df.select(F.lit(i).alias("id"), F.lit(nature).alias("nature"), F.lit(tier).alias("tier"), "impact") for df, i, nature, tier in parts]
    return items[0].unionByName(items[1]).unionByName(items[2]).filter("impact > 0").orderBy("tier", F.desc("impact"))


def discarded_alarms(people: DataFrame, stores: DataFrame) -> DataFrame:
    """Alarms that weren't raised, as a salesperson or a store is too new."""
    a = people.filter("NOT has_sufficient_tenure").select(F.lit("salesperson_ramp").alias("category"), F.col("salesperson").alias("entity"), F.col("tenure_days").cast("double").alias("measure"))
    b = stores.filter("NOT has_sufficient_history").select(F.lit("store_cold_start").alias("category"), F.col("store").alias("entity"), F.col("months_of_history").alias("measure"))
    return a.unionByName(b)


def winsorised(sales: DataFrame, t: Thresholds) -> DataFrame:
    """sales with original_value, and value capped at outlier_ratio medians of the product's positive values (two at least).

    The medians are joined back, so that a product with a third of all rows is split by AQE, not sorted in one task."""
    medians = quantiles(sales.filter("value > 0 AND product IS NOT NULL"), "value", {"median": 0.5}, ["product"], size="n")
    caps = medians.filter("n >= 2").select("product", (F.col("median") * t.outlier_ratio).alias("cap"))
    out = sales.join(caps, "product", "left").withColumn("original_value", F.col("value"))
    return out.withColumn("value", F.when(F.col("value") > F.col("cap"), F.col("cap")).otherwise(F.col("value")))


def capped_values(sales: DataFrame, t: Thresholds) -> DataFrame:
    return winsorised(sales, t).filter("original_value > cap").select("product", "source_row", "original_value", F.col("value").alias("capped_value"))


def silence_by_month(lost: DataFrame) -> DataFrame:
    """Lost customers and their value by month of the last purchase."""
    return lost.groupBy(F.substring("last_purchase", 1, 7).alias("period")).agg(F.count("*").alias("customers"), F.sum("historical_value").alias("value"))

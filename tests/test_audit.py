"""Detectors on planted cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cellarium.operators import audit as A
from cellarium.operators.thresholds import Thresholds
from cellarium.plans.audit import frozen_capital, run_audit
from cellarium.plans.dashboard import views

T = Thresholds()


def day(y, m, d=10):
    return dt.datetime(y, m, d)


@pytest.fixture
def sales(spark):
    def make(rows):
        names = [c.split()[0] for c in A.SALES.split(", ")]
        full = [tuple({"source_file": "f", "source_row": i} .get(n, r.get(n)) for n in names) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, A.SALES)

    return make


def one(store="S", value=100.0, cost=40.0, date=None, **more):
    return {"date": date or day(2024, 1), "product": "P", "customer": "C", "value": value, "entry_cost": cost, "store": store, "category": "x"} | more


def test_store_margins(sales):
    df = sales([one("Good", 100.0, 40.0)] * 10 + [one("Bad", 50.0, 60.0)] * 10 + [one("Good", -30.0, 40.0), one(None, 10.0, None)])
    rows = {r.store: r for r in A.store_pnl(df, T).collect()}
    assert rows["Good"].contribution_margin_avg == 45 and rows["Good"].contribution_margin_total == 450 and rows["Good"].gross_revenue == 970
    assert rows["Bad"].contribution_margin_total == -175 and rows["LOJA_NAO_IDENTIFICADA"].margin_sample_size == 0
    macro = A.store_macro(A.store_pnl(df, Thresholds(cold_start_months=0))).first()
    assert macro.stores_with_negative_margin == ["Bad"] and macro.masked_amount == 175 and macro.revenue_rank[0] == "Good"
    assert A.store_macro(A.store_pnl(df, T)).first().masked_amount == 0  # one day of history


def test_leak_in_total(sales):
    rows = [one(value=1000.0 + 10 * (i % 3), date=day(2023 + i // 12, i % 12 + 1)) for i in range(24) if i != 19] + [one(value=150.0, date=day(2024, 8))]
    found = A.leaks_total(sales(rows), T).collect()
    assert [(r.period, r.severity) for r in found] == [("2024-08", "medium" if found[0].drop_sigma < 3 else "high")]
    assert A.leaks_total(sales(rows[:2]), T).count() == 0


def test_regular_season_is_no_leak_but_a_fall_is(sales):
    rows = [one(value=1000.0 if i % 12 else 100.0, date=day(2021 + i // 12, i % 12 + 1)) for i in range(48)]
    assert A.leaks_by_product(sales(rows), T).count() == 0
    rows[30] = one(value=50.0, date=day(2023, 7))
    found = A.leaks_by_product(sales(rows), T).collect()
    assert [(r.period, r.low_confidence) for r in found] == [("2023-07", False)]


def test_churn_and_pseudo_customers(sales):
    rows = [one(customer="Gone", date=day(2023, m)) for m in range(1, 7)] + [one(customer="Here", date=day(2023, m)) for m in range(1, 13)]
    rows += [one(customer=None, date=day(2023, 1, d)) for d in range(1, 9)] + [one(customer="Once", date=day(2023, 1))]
    found = A.churn(sales(rows), T).collect()
    assert [(r.customer, r.purchase_count, r.months_silent, r.last_purchase) for r in found] == [("Gone", 6, 6, "2023-06-10")]


def test_service_parts_add_up_and_masks(sales):
    rows = [one("S", 50.0, 60.0, category="x", customer="A", date=day(2024, 2))] * 3 + [one("S", 100.0, 10.0, category="servico", customer="A", date=day(2024, 1))] * 3
    df = sales(rows)
    r = A.service_decomposition(df, T).first()
    assert r.total_margin == pytest.approx(A.store_pnl(df, T).first().contribution_margin_total) and r.masks_negative_product_margin and r.follow_on_effect == 150
    assert not A.service_decomposition(df.filter("category <> 'servico'"), T).first().masks_negative_product_margin


def test_margin_alerts_know_promotions(sales):
    rows = [one(product="Promo", value=10.0, cost=20.0, payment_method="PROMOCAO ")] * 2 + [one(product="Loss", value=10.0, cost=20.0, payment_method="promocao"), one(product="Loss", value=10.0, cost=20.0)]
    assert {r["product"]: r.promotional for r in A.contribution_margin(sales(rows), T).collect()} == {"Promo": True, "Loss": False}


def test_concentration_counts_all_revenue(sales):
    rows = [one(customer="Big", value=300.0), one(customer=None, value=600.0), one(customer="Small", value=100.0)]
    assert [(r.customer, r.concentration_pct) for r in A.customer_concentration(sales(rows), T).collect()] == [("Big", 30.0)]


def test_people_and_stock(sales, spark):
    rows = [one(salesperson="Old", date=day(2023, 1), customer=None)] + [one(salesperson="Old", date=day(2024, 1))] * 4 + [one(salesperson="New", date=day(2024, 1))]
    found = {r.salesperson: r for r in A.salesperson_performance(sales(rows), T).collect()}
    assert found["Old"].capture_pct == 80 and found["Old"].has_sufficient_tenure and not found["New"].has_sufficient_tenure and not found["New"].low_volume
    stock = spark.createDataFrame([("a", 10.0, 5.0, day(2024, 9), "x"), ("b", 4.0, 5.0, day(2024, 1), "x"), ("c", None, 1.0, day(2020, 1), "y")], "sku string, cost double, qty_on_hand double, last_movement timestamp, category string")
    r = A.dead_stock(stock, T).first()
    assert (r.sku_count, r.capital_frozen, r.total_inventory_value) == (1, 20.0, 70.0)
    assert frozen_capital(A.dead_skus(stock, T), stock, ["category"]).first().capital == 20.0
    with pytest.raises(ValueError, match="not in the stock"):
        frozen_capital(spark.createDataFrame([("zz",)], "sku string"), stock, ["category"])
    people = spark.createDataFrame([("c1", "1", "111.222"), ("c2", "", "111222"), ("c3", None, None)], "customer_id string, phone string, document string")
    assert {r.customer_id: r.canonical_id for r in A.canonical_ids(people).collect()} == {"c1": "c1", "c2": "c1"}
    assert A.data_completeness(people, T).first().completeness_pct == pytest.approx(50)


def test_quantile_scores(spark):
    import pandas as pd

    for n in (5, 7, 23, 100):
        got = [r.s for r in spark.range(1, n + 1).select(A.quantile_score(F.col("id"), F.lit(n), 5).alias("s"), "id").orderBy("id").collect()]
        assert got == (pd.qcut(pd.Series(range(1, n + 1)), 5, labels=False) + 1).tolist()


def test_whole_audit_and_empty_input(sales, spark):
    rows = [one(customer=f"C{i % 9}", product=f"P{i % 4}", date=day(2022 + i // 48, i // 4 % 12 + 1), value=100.0 + i) for i in range(120)] + [one(product="P1", value=1e6)]
    stock = spark.createDataFrame([("a", 10.0, 5.0, day(2024, 9), "x"), ("b", 4.0, 5.0, day(2024, 1), "x")], "sku string, cost double, qty_on_hand double, last_movement timestamp, category string")
    people = spark.createDataFrame([("C1", "1", "11"), ("C2", "2", "11")], "customer_id string, phone string, document string")
    finance = spark.createDataFrame([("S", "2022-01", 5.0)], "store string, period string, service_revenue double")
    full = run_audit(sales(rows), stock, people, finance, anonymous=True)
    assert full["outliers"].first().original_value == 1e6
    assert {r.id for r in full["executive_totals"].collect()} <= {"act-operational", "act-capital", "act-ltv"}
    assert all(r.customer.startswith("Client_") for r in full["customer_concentration"].collect())
    shown = views(full)
    assert [r.store for r in shown["ranked_stores"].collect()] == full["store_macro"].first().revenue_rank
    money = [r.monetary for r in shown["rfm_champions"].collect()]
    assert money == sorted(money, reverse=True) and shown["dead_skus"].count() == full["dead_skus"].count() and shown["masked_stores"].filter("NOT masks_negative_product_margin").count() == 0
    for name, df in run_audit(sales([]), stock.limit(0), people.limit(0), finance.limit(0)).items():
        assert df.count() == 0, name

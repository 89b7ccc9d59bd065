"""Sales, returns, and comparisons against hand-computed values."""

from __future__ import annotations

from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tillwise.errors import ConfigError, GateError, RetailDataError
from tillwise.operators import comparisons, filters, joins, sales
from tillwise.operators.returns import returns_analytics, returns_with_attributes


def test_kpis(orders, returns):
    # Lines of 27.00, 24.00 less a quarter, and 35.00 less a tenth; one cup came back.
    row = sales.sales_kpis(sales.sales_lines(orders, returns)).first()
    assert row.asDict() == {
        "gross_revenue": D("86.00"), "discount_amount": D("9.50"), "refund_amount": D("6.00"),
        "net_revenue": D("70.50"), "cost_of_goods_sold": D("36.50"), "gross_profit": D("34.00"),
        "gross_margin_percent": D("48.23"), "orders": 3, "units_sold": 10,
        "average_order_value": D("23.50"), "returned_quantity": 1,
        "return_rate_percent": D("10.00"),
    }


def test_tables(orders, returns):
    result = sales.sales_analytics(orders, returns)
    assert [(r["date"], r["net_revenue"]) for r in result.daily.collect()] == [
        (date(2031, 3, 4), D("39.00")), (date(2031, 3, 12), D("31.50")),
    ]
    assert [r["week_start"] for r in result.weekly.collect()] == [date(2031, 3, 3), date(2031, 3, 10)]
    assert [r["product_id"] for r in result.top_by_revenue.collect()] == ["POT", "TEA", "CUP"]
    assert {r["country"]: r["net_revenue"] for r in result.countries.collect()} == {
        "Chile": D("31.50"), "Norway": D("39.00"),
    }
    total = result.categories.agg(F.sum("net_revenue")).first()[0]
    assert total == result.kpis.first()["net_revenue"]


def test_empty_result_is_zero(orders, returns):
    chosen = filters.SalesFilters(country="Nowhere")
    row = sales.sales_kpis(sales.sales_lines(orders, returns, chosen)).first()
    assert set(row.asDict().values()) == {0, D("0.00")}
    assert sales.country_performance(sales.sales_lines(orders, returns, chosen)).isEmpty()


def test_half_up_and_full_refund(orders, returns, table):
    one = table(
        "order_id string, order_date string, product_id string, quantity bigint, "
        "unit_price decimal(18,4)",
        ("A", "2031-03-01", "TEA", 1, D("2.345")),
    )
    assert sales.sales_kpis(sales.sales_lines(one)).first()["gross_revenue"] == D("2.35")
    whole = returns.withColumn("refund_amount", F.lit(18.0))
    cups = filters.SalesFilters(date_to="2031-03-08", product_category="Kitchen")
    row = sales.sales_kpis(sales.sales_lines(orders, whole, cups)).first()
    assert (row["net_revenue"], row["gross_margin_percent"]) == (D("0.00"), D("0.00"))


def test_filters(orders):
    def ids(**choice):
        found = filters.filter_orders(orders, filters.SalesFilters(**choice))
        return sorted(r["order_id"] for r in found.collect())

    assert ids(date_from="2031-03-05", date_to="2031-03-12") == ["A-72", "A-73"]
    assert ids(start_date="2031-03-10") == ["A-72"]
    assert ids(country=("Norway",), order_status="pending") == ["A-73"]
    assert ids(product_category="Kitchen") == ["A-71", "A-72"]
    assert ids(country=()) == []
    bare = orders.drop("country")
    assert filters.filter_orders(bare, filters.SalesFilters(country="Norway")).isEmpty()


def test_refunds_count_by_return_date_and_line(orders, returns):
    late = filters.SalesFilters(date_from="2031-03-05")
    row = sales.sales_kpis(sales.sales_lines(orders, returns, late)).first()
    assert row["refund_amount"] == D("0.00")  # its order line is out of scope
    early = filters.SalesFilters(date_to="2031-03-05")
    row = sales.sales_kpis(sales.sales_lines(orders, returns, early)).first()
    assert row["refund_amount"] == D("0.00")  # it came back later


def test_missing_columns_fail(orders):
    with pytest.raises(RetailDataError):
        sales.sales_lines(orders.drop("quantity"))


def test_returns(orders, returns):
    result = returns_analytics(orders, returns)
    assert result.kpis.first().asDict() == {
        "returned_quantity": 1, "refund_amount": D("6.00"), "return_rate_percent": D("10.00"),
    }
    assert result.reasons.first()["return_reason"] == "Broken"
    rates = {r["product_id"]: r["return_rate"] for r in result.products.collect()}
    assert rates == {"CUP": D("33.33"), "POT": D("0.00"), "TEA": D("0.00")}
    enriched, _ = returns_with_attributes(orders, returns)
    assert enriched.first()["country"] == "Norway"
    pending = returns.withColumns({"order_id": F.lit("A-73"), "product_id": F.lit("TEA")})
    assert returns_analytics(orders, pending).returns.isEmpty()


def test_comparisons(spark):
    rows = [("a", 120, 100, False), ("b", 25, 20, True), ("c", 10, 0, False), ("d", 0, 0, False),
            ("e", -5, -10, False)]
    frame = spark.createDataFrame(rows, "m string, now int, old int, rate boolean")
    found = {
        r["m"]: (r["absolute_difference"], r["percentage_difference"], r["percentage_point_difference"])
        for r in comparisons.compare_values(frame, "now", "old", F.col("rate")).collect()
    }
    assert found["a"] == (D("20.0000"), D("20.00"), None)
    assert found["b"] == (D("5.0000"), D("25.00"), D("5.00"))
    assert found["c"][1] is None
    assert found["d"][1] == D("0.00")
    assert found["e"][1] == D("50.00")


def test_lower_return_rate_is_positive(spark):
    now = spark.createDataFrame([(D("5.00"),)], "return_rate_percent decimal(18,2)")
    old = spark.createDataFrame([(D("10.00"),)], "return_rate_percent decimal(18,2)")
    card = comparisons.kpi_cards(spark, now, comparisons.compare_periods(now, old)).first()
    assert (card["direction"], card["change"]) == ("positive", D("-5.00"))
    assert card["comparison_text"] == "-5.0 pp vs previous period"


def test_aligned_days(spark):
    schema = "date date, net_revenue decimal(18,2)"
    long = [(date(2025, 1, d), D(d)) for d in (1, 3, 4)]
    now, old = spark.createDataFrame(long, schema), spark.createDataFrame(long[:2], schema)
    rows = [tuple(r) for r in comparisons.current_vs_previous(old, now).collect()]
    assert rows == [(1, D(1), D(1)), (2, D(3), D(3)), (3, None, D(4))]
    assert comparisons.comparison_long(comparisons.current_vs_previous(old, now)).count() == 5
    assert comparisons.daily_with_previous(old, now).count() == 2


def test_periods(orders):
    assert filters.reporting_period("2024-02", orders) == filters.Period(date(2024, 2, 1), date(2024, 2, 29))
    assert filters.reporting_period(None, orders).days == 9
    previous = filters.previous_period(filters.Period(date(2025, 1, 1), date(2025, 1, 10)))
    assert previous == filters.Period(date(2024, 12, 22), date(2024, 12, 31))
    assert filters.previous_period(filters.Period(None, None)) == filters.Period(None, None)
    for bad in ("2025-13", "2025-02-01:2025-01-01", "yesterday", "2025/01"):
        with pytest.raises(ConfigError):
            filters.reporting_period(bad, orders)
    with pytest.raises(GateError):
        filters.reporting_period(None, orders.filter("false"))


def test_safe_join_rejects_repeated_keys(spark):
    facts = spark.createDataFrame([("P-1",), ("P-2",), (None,)], "product_id string")
    good = spark.createDataFrame([("P-1", "One"), (None, "None")], "product_id string, name string")
    joined = joins.safe_left_join(facts, good, "product_id", "products")
    assert {tuple(r) for r in joined.collect()} == {("P-1", "One"), ("P-2", None), (None, "None")}
    with pytest.raises(RetailDataError, match="join keys are not unique"):
        joins.safe_left_join(facts, good.union(good), "product_id", "products")
    with pytest.raises(RetailDataError, match="join columns are missing"):
        joins.safe_left_join(facts, good, "other", "products")


def test_targets(spark, orders, returns):
    targets = spark.createDataFrame(
        [("2031-03", D(70)), ("2031-04", D(10)), ("2031-05", D(0))],
        "month string, revenue_target decimal(22,6)",
    )
    achieved = comparisons.target_achievement(targets, sales.sales_lines(orders, returns))
    bands = {r["month"]: r["target_band"] for r in comparisons.target_bands(achieved).collect()}
    assert bands == {"2031-03": "met", "2031-04": "missed", "2031-05": None}

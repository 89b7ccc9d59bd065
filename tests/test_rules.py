"""Business rules over untyped and typed tables."""

from __future__ import annotations

from tillwise.operators.issues import issue_rows
from tillwise.operators.rules import validate_all, validate_dataset
from tillwise.plans.validation import validate_tables


def codes(annotated, kind):
    return [r["issue_code"] for r in issue_rows(annotated, kind).collect()]


def valid_products(table):
    return table(
        "product_id string, product_name string, purchase_cost double, recommended_price double",
        ("MUG", "Mug", 2.5, 6.0),
    )


def valid_orders(table):
    return table(
        "order_id string, order_date string, product_id string, quantity bigint, unit_price double",
        ("A-1", "2031-06-15", "MUG", 4, 6.0),
    )


def by_row(annotated, kind):
    found = {}
    for row in issue_rows(annotated, kind).collect():
        found.setdefault(row["row_number"], []).append(row["issue_code"])
    return {number: sorted(names) for number, names in found.items()}


def test_orders(table):
    again = ("A-4", "2031-06-03", "MUG", "1", "6", "0", "CHF")
    frame = table(
        "order_id string, order_date string, product_id string, quantity string, "
        "unit_price string, discount string, currency string",
        ("", "2031-06-01", "MUG", "3.5", "6", "0.2", "GBP"),
        ("A-2", None, None, "4", "free", "-0.1", "JPY"),
        ("A-3", "2031-06-02", "MUG", "-4", "-6", "0.5", "USD"),
        again, again, again,
    )
    annotated = validate_dataset(frame, "orders")
    assert by_row(annotated, "orders") == {
        2: ["invalid_quantity", "missing_order_id"],
        3: ["discount_out_of_range", "invalid_unit_price", "missing_order_date", "missing_product_id", "unsupported_currency"],
        4: ["negative_unit_price", "quantity_not_positive"],
        **{number: ["duplicated_order_row"] for number in (5, 6, 7)},
    }
    (odd,) = issue_rows(annotated, "orders").filter("issue_code = 'unsupported_currency'").collect()
    assert (odd["message"], odd["original_value"]) == ("Currency 'JPY' is not supported.", "JPY")
    assert odd["recommended_action"] == "Use one of: CHF, EUR, GBP, USD."


def test_products(table):
    frame = table(
        "product_id string, product_name string, purchase_cost string, recommended_price string, "
        "vat_rate string",
        ("MUG", "Mug", "-2", "6", "0.25"),
        ("JUG", "  ", "4", "9", "0.1"),
        ("PAN", "Pan", "cheap", "9", "-0.1"),
        ("PAN", "Pan again", "9", "9", "2"),
        ("LID", "Lid", "7", "6.99", None),
    )
    annotated = validate_dataset(frame, "products")
    assert by_row(annotated, "products") == {
        2: ["negative_purchase_cost"],
        3: ["missing_product_name"],
        4: ["duplicated_product_id", "invalid_purchase_cost", "invalid_vat_rate"],
        5: ["duplicated_product_id", "invalid_vat_rate"],
        6: ["recommended_price_below_cost"],
    }
    goes_on = [r["issue_code"] for r in issue_rows(annotated, "products").collect() if r["row_can_continue"]]
    assert goes_on == ["recommended_price_below_cost"]


def test_inventory(table):
    frame = table(
        "product_id string, warehouse string, stock_quantity bigint, reserved_quantity bigint, "
        "reorder_level bigint, last_restock_date string",
        ("JUG", "Oslo", 3, 0, -1, "2031-01-05"),
        ("MUG", "Oslo", -2, 5, 0, "32/01/2031"),
        ("MUG", "Bergen", 9, -3, 2, None),
        (None, "Bergen", 1, 0, 0, None),
    )
    assert by_row(validate_dataset(frame, "inventory", valid_products(table)), "inventory") == {
        2: ["negative_reorder_level", "unknown_product_id"],
        3: ["invalid_restock_date", "negative_stock", "reserved_quantity_exceeds_stock"],
        4: ["negative_reserved_quantity"],
        5: ["unknown_product_id"],
    }


def test_returns(table):
    frame = table(
        "return_id string, order_id string, product_id string, return_date string, "
        "quantity string, refund_amount double",
        ("B-1", "A-1", "MUG", "2031-06-20", "5", 12.0),
        ("B-2", "A-9", "MUG", "2031-06-20", "1", -0.5),
        ("B-3", "A-1", "JUG", "2031-06-20", "none", 0.0),
        ("B-4", "A-1", "MUG", "2031-06-14", "1", 3.0),
        ("B-5", "A-1", "MUG", "2031-06-15", "4", 24.0),
    )
    annotated = validate_dataset(frame, "returns", valid_products(table), valid_orders(table))
    assert by_row(annotated, "returns") == {
        2: ["returned_quantity_exceeds_sold"],
        3: ["negative_refund_amount", "unknown_order_id"],
        4: ["invalid_return_quantity", "unknown_product_id"],
        5: ["return_date_before_order_date"],
    }


def test_targets(table):
    frame = table(
        "month string, revenue_target double, profit_target double, orders_target bigint",
        ("2031-00", 5.0, -1.0, 3), ("2031-07", -2.0, -2.0, 1), ("2031-07", 1.0, 1.0, -1), ("2031-08", 0.0, 0.0, 0),
    )
    assert by_row(validate_dataset(frame, "targets"), "monthly_targets") == {
        2: ["invalid_month", "negative_target"],
        3: ["duplicate_target_month", "negative_target", "negative_target"],
        4: ["duplicate_target_month", "negative_target"],
    }


def test_valid_tables_have_no_issues(table):
    tables = {"orders": valid_orders(table), "products": valid_products(table)}
    assert all(codes(frame, kind) == [] for kind, frame in validate_all(tables).items())


def test_missing_columns_block_a_table(table):
    report = validate_tables(
        {"orders": table("order_id string", ("A-7",)), "products": valid_products(table)},
        filenames={"orders": "june.csv"},
    )
    found = report.issues.collect()
    assert {r["field"] for r in found} == {"order_date", "product_id", "quantity", "unit_price"}
    assert all(r["row_number"] is None and r["source_filename"] == "june.csv" for r in found)
    scores = {r["dataset"]: r["quality_score"] for r in report.scores.collect()}
    assert scores == {"orders": 0.0, "products": 100.0}
    assert report.combined.first()["quality_score"] == 50.0
    assert not report.can_continue()

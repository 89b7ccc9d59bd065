"""Business rules.

A rule is a predicate with the text of its issue. All rules of a dataset are evaluated in
one projection; a rule that needs another table or a repeat count reads a marker column
that was joined before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.dates import parse_date, parse_text_date
from tillwise.functions.numeric import strict_number
from tillwise.functions.text import is_blank, plain, strip
from tillwise.operators.duplicates import with_repeat_flag, with_repeated_rows
from tillwise.operators.issues import (
    ERROR,
    VALIDATION,
    WARNING,
    blocks,
    col,
    issue,
    no_issues,
    raised,
)
from tillwise.sources.schemas import (
    INVENTORY,
    ORDERS,
    PRODUCTS,
    RETURNS,
    TARGETS,
    TRACE_COLUMNS,
    schema_of,
)

# Currency codes accepted when no rates are configured, month pattern.
DEFAULT_CURRENCIES = ("CHF", "EUR", "GBP", "USD")
MONTH_PATTERN = r"^\d{4}-(0[1-9]|1[0-2])$"


class Cells:
    """Typed views of the columns of one table, whatever their storage type."""

    def __init__(self, frame: DataFrame, currencies: Iterable[str]) -> None:
        self.types = dict(frame.dtypes)
        self.currencies = sorted(code.strip().upper() for code in currencies)

    def raw(self, name: str) -> Column:
        return F.col(name)

    def text(self, name: str) -> Column:
        return strip(F.col(name).cast("string"))

    def shown(self, name: str) -> Column:
        return plain(F.col(name), self.types[name])

    def blank(self, name: str) -> Column:
        if self.types[name] == "string":
            return is_blank(F.col(name))
        return F.col(name).isNull()

    def number(self, name: str, whole: bool = False) -> Column:
        return strict_number(F.col(name), self.types[name], whole)

    def date(self, name: str) -> Column:
        if self.types[name] == "string":
            value = F.col(name)
            return F.coalesce(parse_text_date(value, True), parse_text_date(value))
        return parse_date(F.col(name), self.types[name])

    def outside_unit(self, name: str) -> Column:
        """Present but not a number from zero to one."""
        inside = F.coalesce(self.number(name).between(0, 1), F.lit(False))
        return ~self.blank(name) & ~inside


@dataclass(frozen=True)
class Rule:
    kind: str
    code: str
    field: str | None
    broken: Callable[[Cells], Column]
    message: str
    action: str
    needs: tuple[str, ...] = ()
    severity: str = ERROR
    may_continue: bool = False
    shows: Callable[[Cells], Column] | None = None

    def usable(self, columns: Iterable[str]) -> bool:
        wanted = set(self.needs) | ({self.field} if self.field else set())
        return wanted <= set(columns)

    def check(self, cells: Cells) -> Column:
        value = self.shows(cells) if self.shows else cells.shown(self.field)
        message: str | Column = self.message
        if "{}" in self.message:
            before, after = self.message.split("{}")
            message = F.concat(F.lit(before), F.upper(cells.text(self.field)), F.lit(after))
        action = self.action.replace("[]", ", ".join(cells.currencies))
        found = issue(
            self.code, self.field, message, value, action, self.severity, self.may_continue
        )
        return F.when(self.broken(cells), found)


def _required(field: str, label: str) -> Rule:
    return Rule(
        ORDERS, f"missing_{field}", field, lambda c: c.blank(field),
        f"The {label} is missing.", f"Provide a valid {label}.",
    )


def _not_negative(kind: str, field: str, code: str, message: str, action: str) -> Rule:
    return Rule(kind, code, field, lambda c: c.number(field) < 0, message, action)


def _stock(field: str, code: str, label: str) -> Rule:
    return _not_negative(
        INVENTORY, field, code, f"{label} cannot be negative.",
        f"Enter a {label.lower()} greater than or equal to zero.",
    )


def _target(field: str, label: str) -> Rule:
    return _not_negative(
        TARGETS, field, "negative_target", f"{label} cannot be negative.",
        "Enter a target greater than or equal to zero.",
    )


# Issue codes and texts. Markers starting with an underscore are joined in.
RULES = (
    _required("order_id", "order ID"),
    _required("order_date", "order date"),
    _required("product_id", "product ID"),
    Rule(
        ORDERS, "invalid_quantity", "quantity",
        lambda c: c.number("quantity", whole=True).isNull(),
        "Quantity must be a whole number.",
        "Replace the value with a positive whole number.",
    ),
    Rule(
        ORDERS, "quantity_not_positive", "quantity",
        lambda c: c.number("quantity", whole=True) <= 0,
        "Quantity must be greater than zero.",
        "Enter a quantity greater than zero.",
    ),
    Rule(
        ORDERS, "invalid_unit_price", "unit_price",
        lambda c: c.number("unit_price").isNull(),
        "Unit price must be numeric.",
        "Replace the value with a numeric unit price.",
    ),
    _not_negative(
        ORDERS, "unit_price", "negative_unit_price", "Unit price cannot be negative.",
        "Enter a unit price greater than or equal to zero.",
    ),
    Rule(
        ORDERS, "discount_out_of_range", "discount", lambda c: c.outside_unit("discount"),
        "Discount must be between 0 and 1.",
        "Enter the discount as a decimal between 0 and 1.",
    ),
    Rule(
        ORDERS, "unsupported_currency", "currency",
        lambda c: ~c.blank("currency") & ~F.upper(c.text("currency")).isin(*c.currencies),
        "Currency '{}' is not supported.",
        "Use one of: [].",
    ),
    Rule(
        ORDERS, "duplicated_order_row", None, lambda c: F.col("_repeated_row"),
        "This order row is duplicated.",
        "Remove the duplicate row or correct the differing line details.",
        needs=("_repeated_row",),
        shows=lambda c: F.to_json(
            F.struct(
                *[
                    col(name)
                    for name in c.types
                    if not name.startswith("_") and name not in TRACE_COLUMNS
                ]
            ),
            {"ignoreNullFields": "false"},
        ),
    ),
    Rule(
        ORDERS, "unknown_product_id", "product_id", lambda c: ~F.col("_known_product"),
        "Order references an unknown product ID.",
        "Correct the product ID or add the referenced product.",
        needs=("_known_product",),
    ),
    Rule(
        PRODUCTS, "duplicated_product_id", "product_id",
        lambda c: F.col("_repeated_key") & F.col("product_id").isNotNull(),
        "Product ID must be unique.",
        "Keep one product row for this ID or assign a unique ID.",
        needs=("_repeated_key",),
    ),
    Rule(
        PRODUCTS, "missing_product_name", "product_name", lambda c: c.blank("product_name"),
        "Product name is missing.", "Provide a product name.",
    ),
    Rule(
        PRODUCTS, "invalid_purchase_cost", "purchase_cost",
        lambda c: c.number("purchase_cost").isNull(),
        "Purchase cost must be numeric.",
        "Replace the value with a numeric purchase cost.",
    ),
    _not_negative(
        PRODUCTS, "purchase_cost", "negative_purchase_cost", "Purchase cost cannot be negative.",
        "Enter a purchase cost greater than or equal to zero.",
    ),
    Rule(
        PRODUCTS, "recommended_price_below_cost", "recommended_price",
        lambda c: c.number("recommended_price") < c.number("purchase_cost"),
        "Recommended price is below purchase cost.",
        "Review pricing or confirm that the product is intentionally sold at a loss.",
        needs=("purchase_cost",), severity=WARNING, may_continue=True,
    ),
    Rule(
        PRODUCTS, "invalid_vat_rate", "vat_rate", lambda c: c.outside_unit("vat_rate"),
        "VAT rate must be between 0 and 1.",
        "Enter VAT as a decimal between 0 and 1.",
    ),
    Rule(
        INVENTORY, "unknown_product_id", "product_id", lambda c: ~F.col("_known_product"),
        "Inventory references an unknown product ID.",
        "Add the product to the catalogue or correct the product ID.",
        needs=("_known_product",),
    ),
    _stock("stock_quantity", "negative_stock", "Stock quantity"),
    _stock("reserved_quantity", "negative_reserved_quantity", "Reserved quantity"),
    _stock("reorder_level", "negative_reorder_level", "Reorder level"),
    Rule(
        INVENTORY, "reserved_quantity_exceeds_stock", "reserved_quantity",
        lambda c: c.number("reserved_quantity") > c.number("stock_quantity"),
        "Reserved quantity is greater than available stock.",
        "Reduce the reserved quantity or correct the stock quantity.",
        needs=("stock_quantity",),
    ),
    Rule(
        INVENTORY, "invalid_restock_date", "last_restock_date",
        lambda c: ~c.blank("last_restock_date") & c.date("last_restock_date").isNull(),
        "Last restock date is invalid.",
        "Use a valid date such as YYYY-MM-DD.",
    ),
    Rule(
        RETURNS, "unknown_order_id", "order_id", lambda c: ~F.col("_known_order"),
        "Return references an unknown order ID.",
        "Correct the order ID or add the referenced order.",
        needs=("_known_order",),
    ),
    Rule(
        RETURNS, "unknown_product_id", "product_id", lambda c: ~F.col("_known_product"),
        "Return references an unknown product ID.",
        "Correct the product ID or add the referenced product.",
        needs=("_known_product",),
    ),
    Rule(
        RETURNS, "invalid_return_quantity", "quantity",
        lambda c: ~F.coalesce(c.number("quantity", whole=True) > 0, F.lit(False)),
        "Return quantity must be a positive whole number.",
        "Enter a positive whole-number return quantity.",
    ),
    _not_negative(
        RETURNS, "refund_amount", "negative_refund_amount", "Refund amount cannot be negative.",
        "Enter a refund amount greater than or equal to zero.",
    ),
    Rule(
        RETURNS, "return_date_before_order_date", "return_date",
        lambda c: c.date("return_date") < F.col("_sold_on"),
        "Return date is before the matching order date.",
        "Correct the return date or matching order reference.",
        needs=("_sold_on",),
    ),
    Rule(
        RETURNS, "returned_quantity_exceeds_sold", "quantity",
        lambda c: c.number("quantity", whole=True) > F.col("_sold_units"),
        "Returned quantity is greater than the sold quantity.",
        "Reduce the return quantity or correct the matching order.",
        needs=("_sold_units",),
    ),
    Rule(
        TARGETS, "invalid_month", "month",
        lambda c: c.blank("month") | ~c.text("month").rlike(MONTH_PATTERN),
        "Target month must use YYYY-MM format.",
        "Enter a valid month such as 2025-01.",
    ),
    _target("revenue_target", "Revenue Target"),
    _target("profit_target", "Profit Target"),
    _target("orders_target", "Orders Target"),
    Rule(
        TARGETS, "duplicate_target_month", "month",
        lambda c: F.col("_repeated_key") & F.col("month").isNotNull(),
        "Target month must be unique.",
        "Keep one target row for this month.",
        needs=("_repeated_key",),
    ),
)


def check_rules(
    frame: DataFrame, kind: str, currencies: Iterable[str] = DEFAULT_CURRENCIES
) -> DataFrame:
    """Append the issues of every usable rule to the rows that are still active."""
    cells = Cells(frame, currencies)
    rules = [rule for rule in RULES if rule.kind == kind and rule.usable(frame.columns)]
    found = raised(*[rule.check(cells) for rule in rules])
    if "_issues" not in frame.columns:
        frame = frame.withColumns(
            {"_issues": no_issues(), "_step": F.lit(None).cast("string")}
        )
    active = F.col("_step").isNull()
    return (
        frame.withColumn("_found", F.when(active, found).otherwise(no_issues()))
        .withColumn("_issues", F.concat("_issues", "_found"))
        .withColumn(
            "_step", F.when(active & blocks(F.col("_found")), VALIDATION).otherwise(F.col("_step"))
        )
        .drop("_found")
    )


def missing_column_issues(columns: Iterable[str], kind: str) -> list[tuple[str, str, str, str]]:
    """Dataset-level findings for required columns that a table lacks."""
    present = set(columns)
    return [
        (
            name,
            "missing_required_column",
            f"Required column '{name}' is missing.",
            f"Map or add the required '{name}' column.",
        )
        for name in schema_of(kind).required
        if name not in present
    ]


def known_ids(frame: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct trimmed identifiers that are not blank, as column ``name``."""
    value = strip(F.col(column).cast("string"))
    return frame.select(value.alias(name)).filter(F.col(name) != "").distinct()


def mark_known(frame: DataFrame, column: str, ids: DataFrame, marker: str) -> DataFrame:
    """Flag rows whose identifier is listed.

    Blank text is not looked up and counts as known; a null identifier is unknown.
    """
    key = ids.columns[0]
    listed = ids.withColumn("_listed", F.lit(True))
    value = strip(F.col(column).cast("string"))
    return (
        frame.withColumn("_lookup", value)
        .join(listed, F.col("_lookup") == listed[key], "left")
        .withColumn(
            marker,
            F.coalesce(F.col("_listed"), F.col("_lookup") == "", F.lit(False)),
        )
        .drop("_lookup", "_listed", key)
    )


def order_references(orders: DataFrame) -> DataFrame:
    """Per (order, product): positive units sold and the date of the first line."""
    cells = Cells(orders, ())
    units = cells.number("quantity")
    return (
        orders.filter(~cells.blank("order_id") & ~cells.blank("product_id"))
        .groupBy(
            cells.text("order_id").alias("order_id"), cells.text("product_id").alias("product_id")
        )
        .agg(
            F.sum(F.when(units > 0, units)).alias("sold_units"),
            F.min_by(cells.date("order_date"), F.struct("source_file", "source_row_number")).alias(
                "sold_on"
            ),
        )
        .filter(F.col("sold_units").isNotNull())
    )


def _with_order_references(returns: DataFrame, orders: DataFrame) -> DataFrame:
    cells = Cells(returns, ())
    references = order_references(orders).select(
        F.col("order_id").alias("_ref_order"),
        F.col("product_id").alias("_ref_product"),
        F.col("sold_units").alias("_sold_units"),
        F.col("sold_on").alias("_sold_on"),
    )
    match = (cells.text("order_id") == F.col("_ref_order")) & (
        cells.text("product_id") == F.col("_ref_product")
    )
    return returns.join(references, match, "left").drop("_ref_order", "_ref_product")


def validate_dataset(
    frame: DataFrame,
    kind: str,
    products: DataFrame | None = None,
    orders: DataFrame | None = None,
    currencies: Iterable[str] = DEFAULT_CURRENCIES,
) -> DataFrame:
    """Annotate one canonical table (with trace columns) with its business-rule issues."""
    kind = schema_of(kind).kind
    columns = [name for name in frame.columns if name not in TRACE_COLUMNS]
    marked = frame
    if kind == ORDERS and columns:
        marked = with_repeated_rows(marked, columns, "_repeated_row")
    if kind == PRODUCTS and "product_id" in columns:
        marked = with_repeat_flag(marked, [F.col("product_id")], "_repeated_key")
    if kind == TARGETS and "month" in columns:
        marked = with_repeat_flag(marked, [strip(F.col("month").cast("string"))], "_repeated_key")
    if kind in (INVENTORY, RETURNS) and products is not None and "product_id" in columns:
        listed = known_ids(products, "product_id", "_product")
        marked = mark_known(marked, "product_id", listed, "_known_product")
    if kind == RETURNS and orders is not None and {"order_id", "product_id"} <= set(columns):
        listed = known_ids(orders, "order_id", "_order")
        marked = mark_known(marked, "order_id", listed, "_known_order")
        marked = _with_order_references(marked, orders)
    return check_rules(marked, kind, currencies)


def validate_all(
    frames: dict[str, DataFrame], currencies: Iterable[str] = DEFAULT_CURRENCIES
) -> dict[str, DataFrame]:
    """Annotate every given table, checking references against the given tables."""
    tables = {schema_of(name).kind: frame for name, frame in frames.items()}
    return {
        kind: validate_dataset(
            frame, kind, tables.get(PRODUCTS), tables.get(ORDERS), currencies
        )
        for kind, frame in tables.items()
    }

"""Many-to-one joins that cannot multiply fact rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.errors import RetailDataError
from tillwise.operators.issues import col, same_key
from tillwise.sources.schemas import TRACE_COLUMNS


def require_unique(right: DataFrame, keys: list[str], name: str) -> None:
    """Fail when a join key occurs twice. Only one offending key is ever fetched."""
    repeated = right.groupBy(*keys).count().filter("count > 1").limit(1)
    if not repeated.isEmpty():
        raise RetailDataError(f"Cannot merge '{name}'; its join keys are not unique.")


def safe_left_join(
    left: DataFrame,
    right: DataFrame,
    on: str | list[str],
    name: str,
    known_unique: bool = False,
) -> DataFrame:
    """Left join on keys that must be unique on the right.

    ``known_unique`` skips the check for tables that were just reduced to one row per key.
    The join itself is left to Spark: it broadcasts the right side when that is small by
    its file size, and otherwise splits skewed keys of the fact side at run time.
    """
    keys = [on] if isinstance(on, str) else list(on)
    absent = [key for key in keys if key not in left.columns or key not in right.columns]
    if absent:
        raise RetailDataError(f"Cannot merge '{name}'; join columns are missing: {absent}")
    clash = sorted((set(left.columns) & set(right.columns)) - set(keys))
    if clash:
        raise RetailDataError(f"Cannot merge '{name}'; columns occur on both sides: {clash}")
    if not known_unique:
        require_unique(right, keys, name)
    lookup = right.withColumnsRenamed({key: f"_right_{key}" for key in keys})
    match = same_key([left[key] for key in keys], [lookup[f"_right_{key}"] for key in keys])
    return left.join(lookup, match, "left").drop(*[f"_right_{key}" for key in keys])


def dimension(frame: DataFrame, keys: list[str], prefix: str = "") -> DataFrame:
    """Columns of a lookup table, without trace columns, prefixed unless they are keys."""
    return frame.select(
        *[
            col(name).alias(name if name in keys else f"{prefix}{name}")
            for name in frame.columns
            if name not in TRACE_COLUMNS and not name.startswith("_")
        ]
    )


def orders_with_products(
    orders: DataFrame, products: DataFrame, known_unique: bool = False
) -> DataFrame:
    return safe_left_join(
        orders, dimension(products, ["product_id"]), "product_id", "products", known_unique
    )


def with_reporting_month(orders: DataFrame) -> DataFrame:
    return orders.withColumn("reporting_month", F.date_format("order_date", "yyyy-MM"))


def orders_with_targets(
    orders: DataFrame, targets: DataFrame | None, known_unique: bool = False
) -> DataFrame:
    """Add the reporting month and, when targets are given, that month's ``target_`` columns."""
    monthly = with_reporting_month(orders)
    if targets is None:
        return monthly
    lookup = dimension(targets, ["month"], "target_").withColumnRenamed("month", "reporting_month")
    return safe_left_join(monthly, lookup, "reporting_month", "monthly targets", known_unique)


def inventory_with_products(
    inventory: DataFrame, products: DataFrame, known_unique: bool = False
) -> DataFrame:
    lookup = dimension(products, ["product_id"], "product_")
    return safe_left_join(inventory, lookup, "product_id", "products", known_unique)


def returns_with_orders_and_products(
    returns: DataFrame, orders: DataFrame, products: DataFrame, known_unique: bool = False
) -> DataFrame:
    names = {
        "order_date": "original_order_date",
        "quantity": "sold_quantity",
        "unit_price": "original_unit_price",
    }
    keys = ["order_id", "product_id"]
    sold = orders.select(
        *keys, *[F.col(name).alias(new) for name, new in names.items() if name in orders.columns]
    )
    merged = safe_left_join(returns, sold, keys, "orders", known_unique)
    lookup = dimension(products, ["product_id"], "product_")
    return safe_left_join(merged, lookup, "product_id", "products", known_unique)

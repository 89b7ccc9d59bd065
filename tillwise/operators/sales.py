"""Sales lines, KPIs, and performance tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.errors import RetailDataError
from tillwise.functions.numeric import (
    EXACT,
    GROSS,
    MONEY,
    RATE,
    count_percentage,
    money_per,
    or_zero,
    percentage,
    round_money,
)
from tillwise.operators.filters import (
    SalesFilters,
    completed_only,
    filter_orders,
    filter_returns,
    first_column,
)
from tillwise.staging import Stage

LINE_KEY = ["order_id", "product_id"]
REQUIRED = ("order_id", "order_date", "product_id", "quantity", "unit_price")
KPI_COLUMNS = (
    "gross_revenue", "discount_amount", "net_revenue", "cost_of_goods_sold", "gross_profit",
    "gross_margin_percent", "orders", "units_sold", "average_order_value", "returned_quantity",
    "refund_amount", "return_rate_percent",
)
PERFORMANCE_COLUMNS = (
    "gross_revenue", "discount_amount", "refund_amount", "net_revenue", "cost_of_goods_sold",
    "gross_profit", "gross_margin", "gross_margin_percent", "orders", "units_sold",
    "returned_quantity", "return_rate", "return_rate_percent",
)


def refunds_by_line(returns: DataFrame, filters: SalesFilters | None = None) -> DataFrame:
    """Returned units and refunds per (order, product), for returns dated in the period."""
    return (
        filter_returns(returns, filters)
        .groupBy(*LINE_KEY)
        .agg(
            F.sum(or_zero(F.col("quantity"), "bigint")).alias("returned_quantity"),
            F.sum(or_zero(F.col("refund_amount"), MONEY)).cast(GROSS).alias("refund_amount"),
        )
    )


def sales_lines(
    orders: DataFrame, returns: DataFrame | None = None, filters: SalesFilters | None = None
) -> DataFrame:
    """Completed lines in scope with exact revenue, refund, cost, and profit columns.

    Nothing is rounded here. A refund reaches a line through its key, so returns of lines
    out of scope drop out of the join by themselves.
    """
    missing = [name for name in REQUIRED if name not in orders.columns]
    if missing:
        raise RetailDataError(f"Sales analytics needs canonical order data; missing: {missing}")
    lines = completed_only(filter_orders(orders, filters))
    needed = {*LINE_KEY, "quantity", "refund_amount"}
    if returns is not None and needed <= set(returns.columns):
        lines = lines.join(refunds_by_line(returns, filters), LINE_KEY, "left")
    else:
        lines = lines.withColumns(
            {
                "returned_quantity": F.lit(0).cast("bigint"),
                "refund_amount": F.lit(0).cast(GROSS),
            }
        )

    def optional(name: str, data_type: str) -> Column:
        present = name in orders.columns
        return or_zero(F.col(name), data_type) if present else F.lit(0).cast(data_type)

    units = or_zero(F.col("quantity"), "bigint")
    priced = lines.withColumns(
        {
            "returned_quantity": F.coalesce("returned_quantity", F.lit(0).cast("bigint")),
            "refund_amount": or_zero(F.col("refund_amount"), GROSS),
            "gross_revenue": (units * optional("unit_price", MONEY)).cast(GROSS),
            "cost_of_goods_sold": (units * optional("purchase_cost", MONEY)).cast(GROSS),
        }
    )
    priced = priced.withColumn(
        "discount_amount", (F.col("gross_revenue") * optional("discount", RATE)).cast(EXACT)
    )
    net = F.col("gross_revenue") - F.col("discount_amount") - F.col("refund_amount")
    return priced.withColumn("net_revenue", net.cast(EXACT)).withColumn(
        "gross_profit", (F.col("net_revenue") - F.col("cost_of_goods_sold")).cast(EXACT)
    )


def _sums() -> list[Column]:
    """Aggregates from which every KPI follows; net and profit are sums of these."""
    return [
        *[
            F.coalesce(F.sum(name), F.lit(0)).alias(f"_{name}")
            for name in ("gross_revenue", "discount_amount", "refund_amount", "cost_of_goods_sold")
        ],
        F.countDistinct("order_id").alias("orders"),
        F.coalesce(F.sum(F.col("quantity").cast("bigint")), F.lit(0)).alias("units_sold"),
        F.coalesce(F.sum("returned_quantity"), F.lit(0)).alias("returned_quantity"),
    ]


def _kpis(sums: DataFrame) -> DataFrame:
    net = F.col("_gross_revenue") - F.col("_discount_amount") - F.col("_refund_amount")
    exact = sums.withColumn("_net", net.cast("decimal(38,12)")).withColumn(
        "_profit", (F.col("_net") - F.col("_cost_of_goods_sold")).cast("decimal(38,12)")
    )
    margin = percentage(F.col("_profit"), F.col("_net"))
    rate = count_percentage(F.col("returned_quantity"), F.col("units_sold"))
    return exact.withColumns(
        {
            "gross_revenue": round_money(F.col("_gross_revenue")),
            "discount_amount": round_money(F.col("_discount_amount")),
            "refund_amount": round_money(F.col("_refund_amount")),
            "net_revenue": round_money(F.col("_net")),
            "cost_of_goods_sold": round_money(F.col("_cost_of_goods_sold")),
            "gross_profit": round_money(F.col("_profit")),
            "gross_margin": margin,
            "gross_margin_percent": margin,
            "average_order_value": money_per(F.col("_net"), F.col("orders")),
            "return_rate": rate,
            "return_rate_percent": rate,
        }
    )


def sales_kpis(lines: DataFrame) -> DataFrame:
    """One row of KPIs; all zero when there are no lines."""
    return _kpis(lines.agg(*_sums())).select(*KPI_COLUMNS)


def performance(lines: DataFrame, dimensions: dict[str, Column | str]) -> DataFrame:
    """KPIs per group. A null dimension value is a group of its own."""
    groups = [
        (F.col(value) if isinstance(value, str) else value).alias(name)
        for name, value in dimensions.items()
    ]
    return _kpis(lines.groupBy(*groups).agg(*_sums())).select(*dimensions, *PERFORMANCE_COLUMNS)


def _empty_performance(lines: DataFrame, name: str) -> DataFrame:
    return performance(lines.filter(F.lit(False)), {name: F.lit(None).cast("string")})


def daily_revenue(lines: DataFrame) -> DataFrame:
    return performance(lines, {"date": F.col("order_date").cast("date")}).orderBy("date")


def weekly_revenue(lines: DataFrame) -> DataFrame:
    """Weeks start on Monday."""
    monday = F.date_trunc("week", F.col("order_date").cast("date")).cast("date")
    return performance(lines, {"week_start": monday}).orderBy("week_start")


def _by_column(lines: DataFrame, name: str, *columns: str) -> DataFrame:
    column = first_column(lines, *columns)
    if column is None:
        return _empty_performance(lines, name)
    return performance(lines, {name: column}).orderBy(name)


def category_performance(lines: DataFrame) -> DataFrame:
    return _by_column(lines, "category", "category", "product_category")


def country_performance(lines: DataFrame) -> DataFrame:
    return _by_column(lines, "country", "country")


def channel_performance(lines: DataFrame) -> DataFrame:
    return _by_column(lines, "sales_channel", "sales_channel")


def product_performance(lines: DataFrame) -> DataFrame:
    """KPIs per product, left unsorted because this table grows with the catalogue."""
    dimensions = {"product_id": "product_id"}
    if "product_name" in lines.columns:
        dimensions["product_name"] = "product_name"
    return performance(lines, dimensions)


def top_products(products: DataFrame, by: str, limit: int = 10) -> DataFrame:
    """Highest products by a measure; equal values are ordered by product."""
    return products.orderBy(F.desc(by), "product_id").limit(limit)


def by_net_revenue(table: DataFrame) -> DataFrame:
    """A performance table in chart order."""
    return table.orderBy(F.desc("net_revenue"), table.columns[0])


@dataclass(frozen=True)
class SalesResult:
    kpis: DataFrame
    lines: DataFrame
    daily: DataFrame
    weekly: DataFrame
    categories: DataFrame
    countries: DataFrame
    channels: DataFrame
    top_by_revenue: DataFrame
    top_by_profit: DataFrame
    products: DataFrame


def sales_analytics(
    orders: DataFrame,
    returns: DataFrame | None = None,
    filters: SalesFilters | None = None,
    top_n: int = 10,
    stage: Stage | None = None,
    name: str = "sales-lines",
) -> SalesResult:
    """All sales tables. With a stage, lines and product totals are computed once."""
    lines = sales_lines(orders, returns, filters)
    if stage is not None:
        lines = stage.write(lines, name)
    products = product_performance(lines)
    if stage is not None:
        products = stage.write(products, f"{name}-products")
    return SalesResult(
        sales_kpis(lines),
        lines,
        daily_revenue(lines),
        weekly_revenue(lines),
        category_performance(lines),
        country_performance(lines),
        channel_performance(lines),
        top_products(products, "net_revenue", top_n),
        top_products(products, "gross_profit", top_n),
        products,
    )

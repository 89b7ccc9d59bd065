"""Returns of completed order lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.numeric import (
    GROSS,
    MONEY,
    MONEY_OUT,
    count_percentage,
    or_zero,
    round_money,
)
from tillwise.operators.duplicates import drop_duplicates
from tillwise.operators.filters import SalesFilters, filter_returns
from tillwise.operators.sales import LINE_KEY, sales_lines
from tillwise.staging import Stage

# Order attributes a return may inherit.
ATTRIBUTES = (
    "product_name", "category", "country", "sales_channel", "currency", "order_status",
)


def matched_returns(returns: DataFrame, lines: DataFrame) -> DataFrame:
    """Returns whose (order, product) is one of the lines."""
    return returns.join(lines.select(*LINE_KEY), LINE_KEY, "left_semi")


def first_lines(lines: DataFrame) -> DataFrame:
    """One line per (order, product): the earliest in its source."""
    if {"source_file", "source_row_number"} <= set(lines.columns):
        return drop_duplicates(lines, LINE_KEY)
    return lines.dropDuplicates(LINE_KEY)


def returns_with_attributes(
    orders: DataFrame, returns: DataFrame, filters: SalesFilters | None = None
) -> tuple[DataFrame, DataFrame]:
    """Returns in scope with the attributes of their order line, and the lines sold.

    One inner join both keeps the matching returns and adds the attributes, because the
    line side holds each key once.
    """
    sold = sales_lines(orders, None, filters)
    dated = filter_returns(returns, filters)
    inherited = [
        name for name in ATTRIBUTES if name in sold.columns and name not in returns.columns
    ]
    trace = [c for c in ("source_file", "source_row_number") if c in sold.columns]
    lookup = first_lines(sold.select(*LINE_KEY, *inherited, *trace)).drop(*trace)
    enriched = dated.join(lookup, LINE_KEY).withColumns(
        {
            "returned_quantity": or_zero(F.col("quantity"), "bigint"),
            "refund_amount": or_zero(F.col("refund_amount"), MONEY),
        }
    )
    return enriched, sold


def _total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0))


def returns_kpis(enriched: DataFrame, sold: DataFrame) -> DataFrame:
    """Returned units, refunds, and their share of the units sold."""
    back = enriched.select(
        "returned_quantity", "refund_amount", F.lit(0).cast("bigint").alias("sold")
    )
    out = sold.select(
        F.lit(0).cast("bigint").alias("returned_quantity"),
        F.lit(0).cast(MONEY).alias("refund_amount"),
        F.col("quantity").cast("bigint").alias("sold"),
    )
    totals = back.unionByName(out).agg(
        _total("returned_quantity").alias("returned_quantity"),
        _total("refund_amount").alias("refund_amount"),
        _total("sold").alias("sold"),
    )
    return totals.select(
        "returned_quantity",
        round_money(F.col("refund_amount")).alias("refund_amount"),
        count_percentage(F.col("returned_quantity"), F.col("sold")).alias("return_rate_percent"),
    )


def return_reasons(enriched: DataFrame) -> DataFrame:
    """Returns per reason, most returned units first."""
    if "return_reason" not in enriched.columns:
        enriched = enriched.filter(F.lit(False)).withColumn(
            "return_reason", F.lit(None).cast("string")
        )
    counted = "return_id" in enriched.columns
    returns = F.countDistinct("return_id") if counted else F.count("*")
    return (
        enriched.groupBy("return_reason")
        .agg(
            returns.alias("returns"),
            F.sum("returned_quantity").alias("returned_quantity"),
            round_money(F.sum("refund_amount")).alias("refund_amount"),
        )
        .orderBy(F.desc("returned_quantity"), F.asc_nulls_last("return_reason"))
    )


def product_return_rates(enriched: DataFrame, sold: DataFrame) -> DataFrame:
    """Return rate of every product sold, returned or not."""
    name = F.min("product_name") if "product_name" in sold.columns else F.lit(None).cast("string")
    units = (
        sold.filter("product_id is not null")
        .groupBy("product_id")
        .agg(name.alias("product_name"), _total("quantity").cast("bigint").alias("units_sold"))
    )
    back = enriched.groupBy("product_id").agg(
        F.sum("returned_quantity").alias("returned_quantity"),
        F.sum("refund_amount").cast(GROSS).alias("refund_amount"),
    )
    rate = count_percentage(F.col("returned_quantity"), F.col("units_sold"))
    return (
        units.join(back, "product_id", "left")
        .withColumn("returned_quantity", F.coalesce("returned_quantity", F.lit(0).cast("bigint")))
        .select(
            "product_id",
            "product_name",
            "units_sold",
            "returned_quantity",
            round_money(F.col("refund_amount")).cast(MONEY_OUT).alias("refund_amount"),
            rate.alias("return_rate"),
            rate.alias("return_rate_percent"),
        )
    )


def products_by_return_rate(enriched: DataFrame, sold: DataFrame, limit: int = 10) -> DataFrame:
    return (
        product_return_rates(enriched, sold)
        .orderBy(F.desc("return_rate_percent"), F.desc("returned_quantity"), "product_id")
        .limit(limit)
    )


@dataclass(frozen=True)
class ReturnsResult:
    kpis: DataFrame
    returns: DataFrame
    reasons: DataFrame
    products: DataFrame


def returns_analytics(
    orders: DataFrame,
    returns: DataFrame,
    filters: SalesFilters | None = None,
    top_n: int = 10,
    stage: Stage | None = None,
    name: str = "returns",
) -> ReturnsResult:
    enriched, sold = returns_with_attributes(orders, returns, filters)
    if stage is not None:
        enriched = stage.write(enriched, name)
    return ReturnsResult(
        returns_kpis(enriched, sold),
        enriched,
        return_reasons(enriched),
        products_by_return_rate(enriched, sold, top_n),
    )

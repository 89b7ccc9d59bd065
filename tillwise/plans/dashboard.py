"""The dashboard: scoped sales, returns, inventory, comparison, and recommendations."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.operators.comparisons import (
    compare_periods,
    current_vs_previous,
    kpi_cards,
)
from tillwise.operators.filters import (
    DashboardFilters,
    Period,
    catalogue_scope,
    date_bounds,
    filter_orders,
    previous_period,
    warehouse_scope,
)
from tillwise.operators.inventory import (
    Thresholds,
    available_stock_total,
    inventory_exceptions,
    inventory_metrics,
    status_distribution,
    thresholds_of,
)
from tillwise.operators.recommendations import recommendations
from tillwise.operators.returns import ReturnsResult, returns_analytics
from tillwise.operators.sales import (
    SalesResult,
    by_net_revenue,
    daily_revenue,
    sales_analytics,
    sales_kpis,
    sales_lines,
)
from tillwise.staging import Stage


@dataclass(frozen=True)
class Dashboard:
    period: Period
    sales: SalesResult
    returns: ReturnsResult
    comparison: DataFrame
    cards: DataFrame
    inventory: DataFrame
    recommendations: DataFrame
    charts: Mapping[str, DataFrame]
    tables: Mapping[str, DataFrame]
    summary: DataFrame


def effective_period(orders: DataFrame, filters: DashboardFilters) -> Period:
    """Chosen dates, each falling back to the bounds of the scoped orders."""
    if filters.date_from is not None and filters.date_to is not None:
        return Period(filters.date_from, filters.date_to)
    bounds = date_bounds(orders)
    return Period(filters.date_from or bounds.start, filters.date_to or bounds.end)


def dashboard_summary(
    sales_lines_: DataFrame,
    metrics: DataFrame,
    returns: DataFrame,
    period: Period,
    filters: DashboardFilters,
    default_currency: str,
) -> DataFrame:
    """Row counts, period, and the single currency of the lines (else the default)."""
    has_currency = "currency" in sales_lines_.columns
    code = F.col("currency") if has_currency else F.lit(None).cast("string")
    counted = (
        sales_lines_.select(F.lit("orders").alias("part"), code.alias("currency"))
        .unionAll(metrics.select(F.lit("inventory"), F.lit(None).cast("string")))
        .unionAll(returns.select(F.lit("returns"), F.lit(None).cast("string")))
    )
    single = F.min("currency") == F.max("currency")
    return counted.agg(
        F.count_if(F.col("part") == "orders").alias("filtered_order_rows"),
        F.count_if(F.col("part") == "inventory").alias("filtered_inventory_rows"),
        F.count_if(F.col("part") == "returns").alias("filtered_return_rows"),
        F.when(single, F.min("currency"))
        .otherwise(F.lit(default_currency.upper()))
        .alias("currency"),
    ).select(
        _day(period.start).alias("date_from"),
        _day(period.end).alias("date_to"),
        "filtered_order_rows",
        "filtered_inventory_rows",
        "filtered_return_rows",
        F.lit(filters.active_count).alias("active_filter_count"),
        "currency",
    )


def _day(value: date | None):
    return F.lit(None if value is None else str(value)).cast("date")


def dashboard(
    orders: DataFrame,
    inventory: DataFrame,
    returns: DataFrame,
    filters: DashboardFilters | None = None,
    thresholds: Thresholds | Mapping[str, object] | None = None,
    default_currency: str = "USD",
    stage: Stage | None = None,
) -> Dashboard:
    """All dashboard tables from one set of scoped inputs.

    Intermediate line tables are staged, because each feeds several outputs.
    """
    chosen = filters or DashboardFilters()
    limits = thresholds_of(thresholds)
    stage = stage or Stage(orders.sparkSession)
    scoped = catalogue_scope(orders, inventory, returns, chosen.suppliers, chosen.products)
    orders, inventory, returns = warehouse_scope(*scoped, chosen.warehouses)

    period = effective_period(orders, chosen)
    current = chosen.sales_filters()
    sales = sales_analytics(orders, returns, current, stage=stage, name="current-lines")
    back = returns_analytics(orders, returns, current, stage=stage, name="current-returns")
    earlier = previous_period(period)
    before = stage.write(
        sales_lines(orders, returns, chosen.sales_filters(earlier)), "previous-lines"
    )
    comparison = compare_periods(sales.kpis, sales_kpis(before))

    metrics = stage.write(
        inventory_metrics(
            inventory,
            filter_orders(orders, current),
            returns,
            limits,
            period.start,
            period.end,
            period.end,
            stage,
            "current-velocity",
        ),
        "inventory-metrics",
    )
    findings = recommendations(metrics, limits)
    exceptions = inventory_exceptions(metrics, min(limits.dead_stock_days))
    return Dashboard(
        period=period,
        sales=sales,
        returns=back,
        comparison=comparison,
        cards=kpi_cards(
            orders.sparkSession, sales.kpis, comparison, available_stock_total(metrics)
        ),
        inventory=metrics,
        recommendations=findings,
        charts={
            "revenue_over_time": sales.daily,
            "current_vs_previous": current_vs_previous(sales.daily, daily_revenue(before)),
            "revenue_by_category": by_net_revenue(sales.categories),
            "top_products_by_profit": sales.top_by_profit,
            "sales_by_country": by_net_revenue(sales.countries),
            "sales_by_channel": by_net_revenue(sales.channels),
            "inventory_risk": status_distribution(metrics),
            "return_reasons": back.reasons,
        },
        tables={
            "top_products": sales.top_by_revenue,
            "highest_return_rates": back.products,
            **exceptions,
        },
        summary=dashboard_summary(
            sales.lines, metrics, back.returns, period, chosen, default_currency
        ),
    )

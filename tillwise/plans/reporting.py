"""Report analytics and report folders of named section tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise import __version__
from tillwise.functions.text import nested_text, safe_settings
from tillwise.operators.comparisons import (
    compare_periods,
    daily_with_previous,
    kpi_cards,
    product_bands,
    target_achievement,
    target_bands,
)
from tillwise.operators.filters import SalesFilters, reporting_period
from tillwise.operators.inventory import (
    Thresholds,
    available_stock_total,
    inventory_metrics,
    status_distribution,
)
from tillwise.operators.quality import issue_export, no_actions
from tillwise.operators.recommendations import findings, in_order, priority_alerts
from tillwise.operators.returns import ReturnsResult, returns_analytics
from tillwise.operators.sales import (
    SalesResult,
    daily_revenue,
    sales_analytics,
    sales_kpis,
)
from tillwise.plans.processing import ProcessingResult
from tillwise.plans.publishing import publish
from tillwise.staging import Stage, at_once

# Words in a column name that allow or forbid a column total.
TOTAL_WORDS = ("revenue", "amount", "profit", "cost", "quantity", "orders", "units")
NO_TOTAL_WORDS = ("average", "margin", "rate", "price")
WHOLE_NUMBERS = ("bigint", "int", "smallint", "tinyint")
NUMERIC = (*WHOLE_NUMBERS, "double", "float")
# Digits before the point that a total has at least: those of money shown.
TOTAL_DIGITS = 26


@dataclass(frozen=True)
class ReportAnalytics:
    period: str
    sales: SalesResult
    returns: ReturnsResult
    inventory: DataFrame
    findings: DataFrame

    @property
    def recommendations(self) -> DataFrame:
        return in_order(self.findings)


def report_analytics(
    result: ProcessingResult,
    period: str | None = None,
    thresholds: Thresholds | Mapping[str, object] | None = None,
    stage: Stage | None = None,
) -> ReportAnalytics:
    """Sales, returns, inventory, and recommendations of one reporting period.

    Last sales are looked up over all history, and stock is judged as of the last day
    known to either the period or the restock dates.
    """
    stage = stage or result.stage
    days = reporting_period(period, result.orders)
    filters = SalesFilters(date_from=days.start, date_to=days.end)
    metrics = stage.write(
        inventory_metrics(
            result.inventory,
            result.orders,
            result.returns,
            thresholds,
            days.start,
            days.end,
            stage=stage,
            name=f"velocity-{days.start}-{days.end}",
        ),
        f"inventory-metrics-{days.start}-{days.end}",
    )
    return ReportAnalytics(
        f"{days.start} to {days.end}",
        sales_analytics(result.orders, result.returns, filters, stage=stage, name="report-lines"),
        returns_analytics(
            result.orders, result.returns, filters, stage=stage, name="report-returns"
        ),
        metrics,
        findings(metrics, thresholds),
    )


def supports_total(name: str) -> bool:
    lowered = name.lower()
    return any(word in lowered for word in TOTAL_WORDS) and not any(
        word in lowered for word in NO_TOTAL_WORDS
    )


def _wide_enough(kind: str) -> str:
    """The type of a column's total: the column's own, or one with more digits before the point."""
    if kind in WHOLE_NUMBERS:
        return "bigint"
    if not kind.startswith("decimal"):
        return kind
    digits, places = map(int, kind[len("decimal(") : -1].split(","))
    return f"decimal({min(38, max(digits, places + TOTAL_DIGITS))},{places})"


def section_totals(table: DataFrame) -> DataFrame:
    """The table followed by a row of sums; its first column reads "Total".

    Columns whose type is too narrow for the sum of very many rows become wider.
    """
    first = table.columns[0]
    types = dict(table.dtypes)

    def total(name: str):
        summable = types[name] in NUMERIC or types[name].startswith("decimal")
        if supports_total(name) and summable:
            return F.sum(name).cast(_wide_enough(types[name])).alias(name)
        if name == first:
            return F.lit("Total").alias(name)
        return F.lit(None).cast(types[name]).alias(name)

    body = table
    if not supports_total(first):
        body = table.withColumn(first, F.col(first).cast("string"))
    return body.unionByName(table.agg(*[total(name) for name in table.columns]))


def flat_table(table: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats without nested types."""
    return table.select(
        *[
            nested_text(F.col(f"`{name}`")).alias(name)
            if kind.startswith(("map", "array", "struct"))
            else F.col(f"`{name}`")
            for name, kind in table.dtypes
        ]
    )


def write_table(table: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write one table as CSV with a heading line per file."""
    mode = "overwrite" if overwrite else "errorifexists"
    flat_table(table).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_sections(
    sections: Mapping[str, DataFrame], path: str, overwrite: bool = False
) -> list[str]:
    """Publish the sections as one report below ``path``; never replace by accident."""
    return [section.name for section in publish(sections, path, overwrite).sections]


def metadata_section(
    result: ProcessingResult,
    analytics: ReportAnalytics,
    report_id: str,
    currency: str,
    generated_at: datetime | None = None,
) -> DataFrame:
    """Report facts as key and value, counts taken from the statistics table."""
    moment = (generated_at or datetime.now(UTC)).isoformat(sep=" ", timespec="seconds")
    counted = result.statistics.agg(
        F.sum("input_rows").alias("total_source_rows"),
        F.sum("processed_rows").alias("total_processed_rows"),
        F.sum("excluded_rows").alias("total_excluded_rows"),
        F.sum("issue_count").alias("validation_issues"),
    )
    facts = counted.select(
        F.lit(report_id).alias("report_id"),
        F.lit(moment).alias("generated_at"),
        F.lit(__version__).alias("version"),
        F.lit(analytics.period).alias("reporting_period"),
        F.lit(currency).alias("default_currency"),
        *[F.col(name).cast("string").alias(name) for name in counted.columns],
    )
    return facts.unpivot([], facts.columns, "key", "value")


def revenue_trend(current: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Net revenue a day, beside that of the same ordinal day of an earlier period."""
    daily = current if previous is None else daily_with_previous(current, previous)
    earlier = [] if previous is None else ["previous_period_revenue"]
    return daily.select("date", F.col("net_revenue").alias("current_period_revenue"), *earlier)


def report_sections(
    result: ProcessingResult,
    analytics: ReportAnalytics,
    previous: DataFrame | None = None,
    report_id: str = "report",
    include_inventory: bool = True,
    include_returns: bool = True,
    include_quality: bool = True,
    include_processed: bool = True,
    include_recommendations: bool = True,
    summary_recommendations: int = 10,
    summary_rows: int = 10,
    profiles: DataFrame | None = None,
    generated_at: datetime | None = None,
) -> dict[str, DataFrame]:
    """Section tables of a management report; ``previous`` holds the earlier sales lines.

    The summary shows so many recommendations, and so many rows of other tables; their own sections
    have all of them. ``profiles`` describes the source files. With earlier lines there are also the
    compared KPIs, and the cards say what changed. Tables that several sections show are staged.
    """
    stage = result.stage

    def kpis() -> DataFrame:
        return stage.write(analytics.sales.kpis, "report-kpis")

    def days() -> DataFrame:
        return stage.write(analytics.sales.daily, "report-daily").orderBy("date")

    def categories() -> DataFrame:
        return stage.write(analytics.sales.categories, "report-categories").orderBy("category")

    def found_in_order() -> DataFrame:
        return in_order(stage.write(analytics.findings, "report-findings"))

    steps = {"kpis": kpis, "daily": days, "categories": categories}
    if include_recommendations:
        steps["found"] = found_in_order
    shared = at_once(stage.spark, steps)
    found = shared.pop("found", None)
    sales = replace(analytics.sales, **shared)
    daily, earlier = sales.daily, None
    nothing = sales_kpis(sales.lines.limit(0))
    compared = compare_periods(sales.kpis, nothing).limit(0)
    if previous is not None:
        earlier = daily_revenue(previous)
        daily = daily_with_previous(daily, earlier)
        compared = compare_periods(sales.kpis, sales_kpis(previous))
    stock = available_stock_total(analytics.inventory) if include_inventory else None
    sections = {
        "summary_kpis": sales.kpis,
        "summary_cards": kpi_cards(sales.lines.sparkSession, sales.kpis, compared, stock),
        "summary_trend": revenue_trend(sales.daily, earlier),
        "summary_categories": sales.categories.limit(summary_rows),
        "summary_top_products": sales.top_by_revenue.limit(summary_rows),
        "sales_daily": section_totals(daily),
        "sales_weekly": section_totals(sales.weekly),
        "sales_countries": section_totals(sales.countries),
        "sales_channels": section_totals(sales.channels),
        "products_categories": section_totals(sales.categories),
        "products_top_revenue": section_totals(sales.top_by_revenue),
        "products_top_profit": section_totals(sales.top_by_profit),
        "products_bands": product_bands(sales.products),
        "metadata": metadata_section(result, analytics, report_id, result.currency, generated_at),
    }
    if previous is not None:
        sections["summary_comparison"] = compared
    if profiles is not None:
        sections["sources"] = section_totals(profiles)
    if result.targets is not None:
        achieved = target_achievement(result.targets, sales.lines)
        sections["summary_targets"] = target_bands(achieved)
    if include_recommendations:
        sections["summary_alerts"] = priority_alerts(found)
        sections["summary_recommendations"] = found.limit(summary_recommendations)
        sections["recommendations"] = found
    if include_inventory:
        sections["inventory"] = analytics.inventory
        sections["inventory_status"] = status_distribution(analytics.inventory)
    if include_returns:
        sections["returns_reasons"] = section_totals(analytics.returns.reasons)
        sections["returns_products"] = section_totals(analytics.returns.products)
    if include_quality:
        sections["quality_issues"] = result.issues
        sections["quality_excluded"] = result.excluded_rows
    if include_processed:
        sections["processed_orders"] = section_totals(result.orders)
    return sections


def settings_table(spark: SparkSession, settings: Mapping[str, object]) -> DataFrame:
    """Settings as key and value without private keys."""
    values = {key: str(value) for key, value in settings.items()}
    frame = spark.createDataFrame([(values,)], "settings map<string,string>")
    return frame.select(F.explode(safe_settings(F.col("settings"))).alias("key", "value"))


def validation_sections(
    result: ProcessingResult,
    settings: Mapping[str, object],
    actions: DataFrame | None = None,
    include_excluded: bool = True,
) -> dict[str, DataFrame]:
    """Summary, issues, excluded rows, and configuration of a validation report."""
    spark = result.issues.sparkSession
    numbers = result.summary.select(
        *[F.col(name).cast("double").alias(name) for name in result.summary.columns]
    )
    found = (
        result.issues if actions is None else issue_export(result.issues, actions)
    )
    sections = {
        "summary": numbers.unpivot([], numbers.columns, "metric", "value"),
        "issues": found,
        "configuration": settings_table(spark, settings),
    }
    if include_excluded:
        sections["excluded_rows"] = result.excluded_rows
    return sections


def quality_report_sections(
    result: ProcessingResult, settings: Mapping[str, object], actions: DataFrame | None = None
) -> dict[str, DataFrame]:
    """The reviewer's variant: issues with safe values and the action taken."""
    spark = result.issues.sparkSession
    recorded = actions if actions is not None else no_actions(spark)
    include = bool(settings.get("exclude_invalid_rows", True))
    return validation_sections(result, settings, recorded, include)

"""Comparison of two periods and the KPI cards built from it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillwise.functions.numeric import PERCENT_OUT

RATE_METRICS = ("gross_margin_percent", "return_rate_percent", "gross_margin", "return_rate")
_VALUE = "decimal(28,4)"
# Card order, labels, captions, and whether a card is money or a rate.
CARDS = (
    ("net_revenue", "Net Revenue", True, False, "Revenue after discounts and refunds."),
    ("gross_profit", "Gross Profit", True, False, "Net revenue less cost of goods sold."),
    (
        "gross_margin_percent", "Gross Margin", False, True,
        "Gross profit as a percentage of net revenue.",
    ),
    ("orders", "Orders", False, False, "Distinct completed orders."),
    (
        "units_sold", "Units Sold", False, False,
        "Completed units sold in the selected reporting period.",
    ),
    (
        "average_order_value", "Average Order Value", True, False,
        "Net revenue divided by completed orders.",
    ),
    (
        "return_rate_percent", "Return Rate", False, True,
        "Returned units as a percentage of units sold; lower is better.",
    ),
    (
        "available_stock", "Available Stock", False, False,
        "Current stock less reserved quantity across filtered inventory rows.",
    ),
)


def difference(current: Column, previous: Column) -> Column:
    return (current - previous).cast(_VALUE)


def percentage_difference(current: Column, previous: Column) -> Column:
    """Change in percent of the previous size; undefined growth from zero is null."""
    base = F.when(previous != 0, F.abs(previous))
    change = F.round((current - previous).cast(_VALUE) / base * 100, 2)
    grown = F.when(current == 0, F.lit(0)).cast(PERCENT_OUT)
    return F.when(previous == 0, grown).otherwise(change.cast(PERCENT_OUT))


def point_difference(current: Column, previous: Column, is_rate: Column) -> Column:
    return F.when(is_rate, F.round(current - previous, 2).cast(PERCENT_OUT))


def compare_values(frame: DataFrame, current: str, previous: str, is_rate: Column) -> DataFrame:
    """Add the three differences to a table of value pairs; null counts as zero."""
    zero = F.lit(0).cast(_VALUE)
    now = F.coalesce(F.col(current).cast(_VALUE), zero)
    before = F.coalesce(F.col(previous).cast(_VALUE), zero)
    return frame.withColumns(
        {
            current: now,
            previous: before,
            "absolute_difference": difference(now, before),
            "percentage_difference": percentage_difference(now, before),
            "percentage_point_difference": point_difference(now, before, is_rate),
        }
    )


def metrics_long(kpis: DataFrame, value: str) -> DataFrame:
    """One row per metric of a one-row KPI table."""
    numbers = kpis.select(*[F.col(name).cast(_VALUE).alias(name) for name in kpis.columns])
    return numbers.unpivot([], numbers.columns, "metric", value)


def compare_periods(
    current: DataFrame, previous: DataFrame, rates: Iterable[str] = RATE_METRICS
) -> DataFrame:
    """Compare the metrics that two KPI rows share, one row per metric."""
    pairs = metrics_long(current, "current").join(metrics_long(previous, "previous"), "metric")
    is_rate = F.col("metric").isin(*rates)
    return compare_values(pairs, "current", "previous", is_rate).orderBy("metric")


def _direction(change: Column, inverse: Column) -> Column:
    improved = F.when(inverse, change < 0).otherwise(change > 0)
    return (
        F.when(change.isNull() | (change == 0), "neutral")
        .when(improved, "positive")
        .otherwise("negative")
    )


def comparison_text(found: Column, change: Column, suffix: Column) -> Column:
    """Signed change to one place with its unit."""
    signed = F.format_string("%+.1f", change.cast("double"))
    return (
        F.when(~found, "No previous-period data is available for comparison.")
        .when(change.isNull(), "Previous period was zero")
        .otherwise(F.concat(signed, suffix, F.lit(" vs previous period")))
    )


def kpi_cards(
    spark: SparkSession,
    kpis: DataFrame,
    comparison: DataFrame,
    available_stock: DataFrame | None = None,
) -> DataFrame:
    """Cards in display order with value, change, direction, and text."""
    cards = spark.createDataFrame(
        [(place, *card) for place, card in enumerate(CARDS, start=1)],
        "position int, field string, label string, monetary boolean, rate boolean, caption string",
    )
    values = metrics_long(kpis, "value")
    if available_stock is not None:
        values = values.union(metrics_long(available_stock, "value"))
    joined = (
        cards.join(values, F.col("field") == F.col("metric"))
        .drop("metric")
        .join(comparison, F.col("field") == F.col("metric"), "left")
    )
    change = F.when(F.col("rate"), F.col("percentage_point_difference")).otherwise(
        F.col("percentage_difference")
    )
    unit = F.when(F.col("rate"), "percentage points").otherwise("percentage")
    suffix = F.when(F.col("rate"), F.lit(" pp")).otherwise(F.lit("%"))
    return joined.select(
        "position",
        "field",
        "label",
        "value",
        change.alias("change"),
        unit.alias("comparison_type"),
        _direction(change, F.col("field") == "return_rate_percent").alias("direction"),
        comparison_text(F.col("metric").isNotNull(), change, suffix).alias("comparison_text"),
        "caption",
        "monetary",
        "rate",
    ).orderBy("position")


def _ordinal(daily: DataFrame, value: str) -> DataFrame:
    """Days numbered from one. A daily table has at most one row per calendar day."""
    number = F.row_number().over(Window.orderBy("date"))
    return daily.select(number.alias("period_day"), F.col("net_revenue").alias(value))


def current_vs_previous(current: DataFrame, previous: DataFrame) -> DataFrame:
    """The i-th day of one period beside the i-th day of the other, padded to the longer."""
    return (
        _ordinal(current, "current_period")
        .join(_ordinal(previous, "previous_period"), "period_day", "full")
        .orderBy("period_day")
    )


def comparison_long(aligned: DataFrame) -> DataFrame:
    """Aligned days in long form, without the padding."""
    return aligned.unpivot(
        ["period_day"], ["current_period", "previous_period"], "period", "net_revenue"
    ).filter("net_revenue is not null")


def daily_with_previous(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Daily table with the previous period's revenue of the same ordinal day."""
    number = F.row_number().over(Window.orderBy("date"))
    return (
        current.withColumn("period_day", number)
        .join(_ordinal(previous, "previous_period_revenue"), "period_day", "left")
        .drop("period_day")
        .orderBy("date")
    )


def monthly_revenue(lines: DataFrame) -> DataFrame:
    return lines.groupBy(F.date_format("order_date", "yyyy-MM").alias("month")).agg(
        F.sum("net_revenue").cast("decimal(38,12)").alias("actual_revenue")
    )


def target_achievement(targets: DataFrame, lines: DataFrame) -> DataFrame:
    """Targets with the month's actual revenue and its ratio to the target."""
    actual = F.coalesce(F.col("actual_revenue"), F.lit(0).cast("decimal(38,12)"))
    joined = targets.join(monthly_revenue(lines), "month", "left")
    goal = F.when(F.col("revenue_target") != 0, F.col("revenue_target").cast("decimal(28,8)"))
    return joined.withColumn("actual_revenue", actual).withColumn(
        "target_achievement", F.round(F.col("actual_revenue").cast("decimal(28,8)") / goal, 6)
    )


def target_bands(
    achieved: DataFrame, close_ratio: float = 0.9, exceeded_ratio: float = 1.05
) -> DataFrame:
    """Band of each target ratio: exceeded, met, close, missed."""
    ratio = F.col("target_achievement")
    return achieved.withColumn(
        "target_band",
        F.when(ratio >= exceeded_ratio, "exceeded")
        .when(ratio >= 1, "met")
        .when(ratio >= close_ratio, "close")
        .when(ratio.isNotNull(), "missed"),
    )


def product_bands(
    products: DataFrame, low_margin: float = 10.0, high_return_rate: float = 10.0
) -> DataFrame:
    """Profit, margin, and return-rate highlights of a performance table."""
    return products.withColumns(
        {
            "profit_band": F.when(F.col("gross_profit") < 0, "loss").when(
                F.col("gross_profit") > 0, "profit"
            ),
            "margin_band": F.when(F.col("gross_margin_percent") < low_margin, "low"),
            "return_band": F.when(F.col("return_rate_percent") > high_return_rate, "high"),
        }
    )



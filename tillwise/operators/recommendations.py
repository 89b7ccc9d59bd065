"""Rule-based recommendations from inventory metrics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.text import plain
from tillwise.operators.inventory import CRITICAL, OUT_OF_STOCK, Thresholds, thresholds_of

COLUMNS = (
    "recommendation_type", "severity", "product_id", "explanation", "supporting_metrics",
    "recommended_action", "rule_identifier",
)
_PRIORITY = ("critical", "warning", "info")


def _text(frame: DataFrame, name: str) -> Column:
    return plain(F.col(name), dict(frame.dtypes)[name])


def _finding(
    kind: str,
    severity: str | Column,
    rule: str | Column,
    explanation: str | Column,
    metrics: dict[str, Column],
    action: str | Column,
) -> Column:
    def column(value: str | Column) -> Column:
        return F.lit(value) if isinstance(value, str) else value

    pairs = [part for name, value in metrics.items() for part in (F.lit(name), value)]
    return F.struct(
        F.lit(kind).alias("recommendation_type"),
        column(severity).alias("severity"),
        column(explanation).alias("explanation"),
        F.create_map(F.lit("warehouse"), F.col("warehouse"), *pairs).alias("supporting_metrics"),
        column(action).alias("recommended_action"),
        column(rule).alias("rule_identifier"),
    )


def _row_findings(metrics: DataFrame, limits: Thresholds) -> tuple[list[Column], Column]:
    """Rules that apply to each product and warehouse."""
    available = F.col("available_stock").cast("string")
    coverage = F.col("stock_coverage_days")
    reorder = F.col("suggested_reorder_quantity").cast("string")
    action = F.when(
        F.col("suggested_reorder_quantity") > 0,
        F.concat(F.lit("Reorder "), reorder, F.lit(" units.")),
    ).otherwise("Schedule replenishment before the next sale.")

    def coverage_finding(severity: str, days: int, rule: str, words: tuple[str, str], act) -> Column:
        return _finding(
            "inventory",
            severity,
            rule,
            F.concat(F.lit(words[0]), coverage.cast("string"), F.lit(words[1])),
            {"stock_coverage_days": coverage.cast("string"), "threshold_days": F.lit(str(days))},
            act,
        )

    low, short = limits.critical_coverage_days, limits.low_coverage_days
    over = limits.overstock_coverage_days
    idle = F.col("days_since_last_sale")
    reached = F.lit(None).cast("int")
    for days in limits.dead_stock_days:
        reached = F.when(idle >= days, F.lit(days)).otherwise(reached)
    top = max(limits.dead_stock_days)
    return [
        F.when(
            F.col("inventory_status") == OUT_OF_STOCK,
            _finding(
                "inventory", "critical", "INV_OUT_OF_STOCK",
                "Available stock is zero or negative.", {"available_stock": available}, action,
            ),
        ),
        F.when(
            F.col("available_stock") <= F.col("reorder_level"),
            _finding(
                "inventory", "warning", "INV_BELOW_REORDER_LEVEL",
                "Available stock is at or below the configured reorder level.",
                {
                    "available_stock": available,
                    "reorder_level": F.col("reorder_level").cast("string"),
                    "suggested_reorder_quantity": reorder,
                },
                action,
            ),
        ),
        F.when(
            coverage < low,
            coverage_finding(
                "critical", low, f"INV_COVERAGE_LT_{low}",
                ("Stock coverage is only ", " days, below the critical threshold."), action,
            ),
        )
        .when(
            coverage < short,
            coverage_finding(
                "warning", short, f"INV_COVERAGE_LT_{short}",
                ("Stock coverage is ", " days, below the low-stock threshold."), action,
            ),
        )
        .when(
            coverage > over,
            coverage_finding(
                "warning", over, f"INV_COVERAGE_GT_{over}",
                ("Stock coverage is ", " days, above the overstock threshold."),
                "Review excess stock.",
            ),
        ),
        F.when(
            (F.col("available_stock") > 0) & reached.isNotNull(),
            _finding(
                "inventory",
                F.when(reached == top, "critical").otherwise("warning"),
                F.concat(F.lit("INV_DEAD_STOCK_"), reached.cast("string")),
                F.concat(
                    F.lit("The product has not sold for "), idle.cast("string"), F.lit(" days.")
                ),
                {
                    "days_since_last_sale": idle.cast("string"),
                    "threshold_days": reached.cast("string"),
                    "available_stock": available,
                },
                "Review excess stock and consider a markdown or transfer.",
            ),
        ),
    ], action


def _product_findings(metrics: DataFrame, limits: Thresholds, action: Column) -> list[Column]:
    """Rules reported once per product, for its first warehouse that meets them."""
    rate = F.col("return_rate_percent")
    return [
        F.when(
            F.col("is_high_revenue") & F.col("inventory_status").isin(OUT_OF_STOCK, CRITICAL),
            _finding(
                "inventory", "critical", "INV_HIGH_REVENUE_CRITICAL",
                "A high-revenue product has critically low stock.",
                {
                    "net_revenue": _text(metrics, "net_revenue"),
                    "stock_coverage_days": F.col("stock_coverage_days").cast("string"),
                },
                action,
            ),
        ),
        F.when(
            rate > F.lit(limits.high_return_rate_percent),
            _finding(
                "returns", "warning", "RET_HIGH_RETURN_RATE",
                F.concat(F.lit("The product return rate is "), rate.cast("string"), F.lit("%.")),
                {"return_rate_percent": rate.cast("string")},
                F.concat(F.lit("Investigate the "), rate.cast("string"), F.lit("% return rate.")),
            ),
        ),
        F.when(
            F.col("purchase_cost") > F.col("selling_price"),
            _finding(
                "pricing", "critical", "PRICING_COST_ABOVE_SELLING",
                "Purchase cost is higher than the configured selling price.",
                {
                    "purchase_cost": _text(metrics, "purchase_cost"),
                    "selling_price": _text(metrics, "selling_price"),
                },
                "Review supplier cost and update the selling price.",
            ),
        ),
        F.when(
            F.col("units_sold") == 0,
            _finding(
                "sales", "warning", "SALES_NO_SALES",
                "The product generated no completed sales in the analysis period.",
                {
                    "units_sold": F.lit("0"),
                    "period_days": F.col("period_days").cast("string"),
                    "available_stock": F.col("available_stock").cast("string"),
                },
                "Review demand, listing visibility, and stocking strategy.",
            ),
        ),
        F.when(
            F.col("catalogue_data_missing"),
            _finding(
                "catalogue", "critical", "CATALOGUE_MISSING_DATA",
                "Required catalogue attributes are missing for this product.",
                {"catalogue_data_missing": F.lit("true")},
                "Update the product catalogue before including these orders.",
            ),
        ),
    ]


def recommendations(
    metrics: DataFrame, thresholds: Thresholds | Mapping[str, object] | None = None
) -> DataFrame:
    """All findings, by severity, rule, product, and warehouse."""
    return in_order(findings(metrics, thresholds))


def findings(
    metrics: DataFrame, thresholds: Thresholds | Mapping[str, object] | None = None
) -> DataFrame:
    """All findings, in no order.

    The first warehouse of a product-level rule is taken by a partial aggregate, so a
    product held in very many warehouses is not gathered in one task.
    """
    limits = thresholds_of(thresholds)
    per_row, action = _row_findings(metrics, limits)
    per_product = _product_findings(metrics, limits, action)
    rows = metrics.select("product_id", F.inline(F.array_compact(F.array(*per_row))))
    place = F.struct(F.col("warehouse").isNull().alias("unnamed"), "warehouse")
    candidates = metrics.select(
        "product_id",
        place.alias("_place"),
        F.inline(F.array_compact(F.array(*per_product))),
    )
    details = [name for name in COLUMNS if name not in ("product_id", "rule_identifier")]
    firsts = (
        candidates.groupBy("product_id", "rule_identifier")
        .agg(F.min_by(F.struct(*details), "_place").alias("first"))
        .select("product_id", "rule_identifier", "first.*")
    )
    return rows.select(*COLUMNS).unionByName(firsts.select(*COLUMNS))


def in_order(found: DataFrame) -> DataFrame:
    """Findings by severity, rule, product, and warehouse."""
    rank = F.array_position(F.array(*[F.lit(name) for name in _PRIORITY]), F.col("severity"))
    return found.orderBy(
        rank,
        "rule_identifier",
        F.asc_nulls_first("product_id"),
        F.coalesce(F.col("supporting_metrics")["warehouse"], F.lit("")),
    )


def filter_recommendations(
    found: DataFrame,
    severities: tuple[str, ...] | None = None,
    types: tuple[str, ...] | None = None,
    top_priority: bool = False,
) -> DataFrame:
    if severities is not None:
        found = found.filter(F.col("severity").isin(*severities))
    if types is not None:
        found = found.filter(F.col("recommendation_type").isin(*types))
    return found.filter("severity = 'critical'") if top_priority else found


def recommendation_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count("*").alias("recommendations"))


def priority_alerts(found: DataFrame, limit: int = 8) -> DataFrame:
    """First critical and warning findings in recommendation order."""
    return found.filter(F.col("severity").isin("critical", "warning")).limit(limit)

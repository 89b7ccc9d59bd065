"""Named queries over a folder of sample tables.

Sales, returns, and inventory queries read the typed sample datasets, whose enriched orders
are staged once per folder and session.
Cleaning, validation, and pipeline queries read the raw ones; the pipeline runs once per
folder and session, and its staged tables serve every query that reports on them.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.functions import dates, numeric, text
from tillwise.operators import (
    cleaning,
    comparisons,
    duplicates,
    filters,
    inventory,
    issues,
    joins,
    quality,
    recommendations,
    returns,
    rules,
    sales,
)
from tillwise.plans import dashboard, processing, publishing, reporting, runlog
from tillwise.sources import files, pages
from tillwise.sources.sample import Sample
from tillwise.sources.schemas import INVENTORY, KINDS, ORDERS, PRODUCTS, RETURNS, TARGETS
from tillwise.staging import CLUSTER_SETTINGS, SESSION_SETTINGS, Stage, broadcast_by_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
RATES = {"EUR": "1.1", "GBP": "1.25"}
YEAR = filters.SalesFilters(date_from="1998-01-01", date_to="1998-12-31")
CHOICE = filters.SalesFilters(
    date_from="1997-01-01",
    date_to="1999-12-31",
    country=("NATION_1", "NATION_2", "NATION_4", "NATION_8"),
    sales_channel=("2-HIGH", "5-LOW"),
    currency="USD",
    order_status="completed",
)
BOARD = filters.DashboardFilters(date_from=date(1998, 1, 1), date_to=date(1998, 12, 31))
_RUNS: dict[tuple[str, str], Run] = {}


class Run:
    """Datasets of one folder, and what the pipeline made of them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.sample = Sample(spark, folder)
        self._raw: dict[str, DataFrame] = {}
        self.report_folder: str | None = None

    @cached_property
    def stage(self) -> Stage:
        return Stage(self.spark)

    def clean(self, kind: str) -> DataFrame:
        return self.sample.clean(kind)

    def raw(self, kind: str) -> DataFrame:
        """A raw dataset, landed once, as the tasks that make its rows write them."""
        if kind not in self._raw:
            self._raw[kind] = self.stage.write(self.sample.raw(kind), f"raw-{kind}")
        return self._raw[kind]

    def mapped(self, kind: str) -> DataFrame:
        return processing.map_dataset(self.raw(kind), kind, kind).frame

    @cached_property
    def orders(self) -> DataFrame:
        """Typed order lines, one per order and product, with product attributes.

        Staged, because every sales query starts from it: the shuffles of the duplicate check
        and of the product join are paid once, and a query reads only its columns.
        """
        first = duplicates.drop_duplicates(self.clean(ORDERS), ["order_id", "product_id"])
        enriched = joins.orders_with_products(first, self.clean(PRODUCTS), known_unique=True)
        return self.stage.write(enriched, "typed-orders")

    @cached_property
    def returns(self) -> DataFrame:
        return self.stage.write(self.clean(RETURNS), "typed-returns")

    @cached_property
    def inventory(self) -> DataFrame:
        enriched = joins.inventory_with_products(
            self.clean(INVENTORY), self.clean(PRODUCTS), known_unique=True
        )
        return self.stage.write(enriched, "typed-inventory")

    def lines(self, chosen: filters.SalesFilters | None = None) -> DataFrame:
        return sales.sales_lines(self.orders, self.returns, chosen)

    def returned(self, chosen: filters.SalesFilters | None = None) -> tuple[DataFrame, DataFrame]:
        return returns.returns_with_attributes(self.orders, self.returns, chosen)

    @cached_property
    def metrics(self) -> DataFrame:
        """Inventory metrics of 1998, staged."""
        found = inventory.inventory_metrics(
            self.inventory, self.orders, self.returns, None, YEAR.date_from, YEAR.date_to,
            stage=self.stage, name="catalog-velocity",
        )
        return self.stage.write(found, "catalog-metrics")

    @cached_property
    def recommendations(self) -> DataFrame:
        return self.stage.write(recommendations.recommendations(self.metrics), "catalog-findings")

    def cleaned(self, kind: str, strategy: str = "keep_first") -> DataFrame:
        options = cleaning.CleaningOptions("USD", RATES, strategy)
        return cleaning.clean_dataset(self.mapped(kind), kind, options, stage=Stage(self.spark))

    @cached_property
    def result(self) -> processing.ProcessingResult:
        return processing.process_datasets(
            # Each dataset is read once, by the job that cleans it, so it is not landed first.
            {kind: self.sample.raw(kind) for kind in KINDS},
            processing.PipelineOptions("USD", RATES),
            stage=Stage(self.spark),
        )

    @cached_property
    def board(self) -> dashboard.Dashboard:
        return dashboard.dashboard(
            self.result.orders, self.result.inventory, self.result.returns,
            stage=Stage(self.spark),
        )

    @cached_property
    def report(self) -> reporting.ReportAnalytics:
        return reporting.report_analytics(self.result, stage=Stage(self.spark))


def run_of(spark: SparkSession, folder: str) -> Run:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _RUNS:
        # Wide projections of parsers are slow as one method that the JVM does not compile, and
        # packed tables need more tasks than their bytes suggest.
        for name in SESSION_SETTINGS:
            spark.conf.set(name, CLUSTER_SETTINGS[name])
        broadcast_by_rows(spark)
        _RUNS[key] = Run(spark, folder)
    return _RUNS[key]


def query(build: Callable[[Run], DataFrame]) -> Callable[[Run], DataFrame]:
    """Register a query under the name of its function, less a final underscore."""
    name = build.__name__.removesuffix("_")
    QUERIES[name] = lambda spark, folder: build(run_of(spark, folder))
    return build


TRACE = ("source_file", "processing_status", "exclusion_reason")


# Filters, lines, and KPIs ---------------------------------------------------------------


@query
def filter_orders(run: Run) -> DataFrame:
    return filters.filter_orders(run.clean(ORDERS), CHOICE).drop(*TRACE)


@query
def filter_returns(run: Run) -> DataFrame:
    return filters.filter_returns(run.clean(RETURNS), YEAR).drop(*TRACE)


@query
def completed_lines(run: Run) -> DataFrame:
    return filters.completed_only(run.clean(ORDERS)).drop(*TRACE)


@query
def matched_returns(run: Run) -> DataFrame:
    sold = filters.completed_only(run.clean(ORDERS))
    return returns.matched_returns(run.clean(RETURNS), sold).drop(*TRACE)


@query
def line_refunds(run: Run) -> DataFrame:
    return sales.refunds_by_line(run.clean(RETURNS))


@query
def sales_lines(run: Run) -> DataFrame:
    return run.lines().select(
        "order_id", "product_id", "order_date", "quantity", "unit_price", "discount",
        "gross_revenue", "discount_amount", "returned_quantity", "refund_amount", "net_revenue",
        "cost_of_goods_sold", "gross_profit",
    )


@query
def sales_kpis(run: Run) -> DataFrame:
    return sales.sales_kpis(run.lines())


@query
def sales_kpis_filtered(run: Run) -> DataFrame:
    return sales.sales_kpis(run.lines(CHOICE))


@query
def daily_revenue(run: Run) -> DataFrame:
    return sales.daily_revenue(run.lines())


@query
def weekly_revenue(run: Run) -> DataFrame:
    return sales.weekly_revenue(run.lines())


@query
def category_performance(run: Run) -> DataFrame:
    return sales.category_performance(run.lines())


@query
def country_performance(run: Run) -> DataFrame:
    return sales.country_performance(run.lines())


@query
def channel_performance(run: Run) -> DataFrame:
    return sales.channel_performance(run.lines())


@query
def product_performance(run: Run) -> DataFrame:
    return sales.product_performance(run.lines())


@query
def top_products_by_revenue(run: Run) -> DataFrame:
    return sales.top_products(sales.product_performance(run.lines()), "net_revenue", 10)


@query
def top_products_by_profit(run: Run) -> DataFrame:
    return sales.top_products(sales.product_performance(run.lines()), "gross_profit", 10)


@query
def category_chart(run: Run) -> DataFrame:
    return sales.by_net_revenue(sales.category_performance(run.lines()))


@query
def country_chart(run: Run) -> DataFrame:
    return sales.by_net_revenue(sales.country_performance(run.lines()))


@query
def channel_chart(run: Run) -> DataFrame:
    return sales.by_net_revenue(sales.channel_performance(run.lines()))


@query
def sales_analytics(run: Run) -> DataFrame:
    """The dimension tables of one result, stacked with the name of their dimension."""
    result = sales.sales_analytics(run.orders, run.returns, stage=Stage(run.spark), name="lines")
    tables = {
        "date": result.daily, "week_start": result.weekly, "category": result.categories,
        "country": result.countries, "sales_channel": result.channels,
    }
    return issues.union_all(
        [
            table.select(
                F.lit(name).alias("dimension"),
                F.col(name).cast("string").alias("member"),
                *sales.PERFORMANCE_COLUMNS,
            )
            for name, table in tables.items()
        ]
    )


# Returns --------------------------------------------------------------------------------


@query
def returns_with_order_attrs(run: Run) -> DataFrame:
    return run.returned()[0].drop(*TRACE)


@query
def returns_kpis(run: Run) -> DataFrame:
    return returns.returns_kpis(*run.returned())


@query
def return_reasons(run: Run) -> DataFrame:
    return returns.return_reasons(run.returned()[0])


@query
def product_return_rates(run: Run) -> DataFrame:
    return returns.product_return_rates(*run.returned())


@query
def products_by_return_rate(run: Run) -> DataFrame:
    return returns.products_by_return_rate(*run.returned(), 25)


@query
def returns_analytics(run: Run) -> DataFrame:
    result = returns.returns_analytics(run.orders, run.returns, stage=Stage(run.spark), name="returns")
    reasons = result.reasons.select(
        F.lit("reason").alias("part"), F.col("return_reason").alias("member"),
        "returned_quantity", "refund_amount",
    )
    products = result.products.select(
        F.lit("product").alias("part"), F.col("product_id").alias("member"),
        "returned_quantity", "refund_amount",
    )
    total = result.kpis.select(
        F.lit("total").alias("part"), F.lit(None).cast("string").alias("member"),
        "returned_quantity", "refund_amount",
    )
    return issues.union_all([reasons, products, total])


# Joins ----------------------------------------------------------------------------------


@query
def safe_left_join(run: Run) -> DataFrame:
    products = run.clean(PRODUCTS).select("product_id", "product_name", "category")
    orders = run.clean(ORDERS).select("order_id", "product_id", "quantity", "source_row_number")
    return joins.safe_left_join(orders, products, "product_id", "products")


@query
def orders_enriched(run: Run) -> DataFrame:
    first = duplicates.drop_duplicates(run.clean(ORDERS), ["order_id", "product_id"])
    return joins.orders_with_products(first, run.clean(PRODUCTS)).drop(*TRACE)


@query
def orders_with_targets(run: Run) -> DataFrame:
    enriched = joins.orders_with_targets(run.clean(ORDERS), run.clean(TARGETS))
    return enriched.select(
        "source_row_number", "order_id", "product_id", "reporting_month",
        "target_revenue_target", "target_profit_target", "target_orders_target",
    )


@query
def inventory_enriched(run: Run) -> DataFrame:
    return joins.inventory_with_products(run.clean(INVENTORY), run.clean(PRODUCTS)).drop(*TRACE)


@query
def returns_enriched(run: Run) -> DataFrame:
    first = duplicates.drop_duplicates(run.clean(ORDERS), ["order_id", "product_id"])
    merged = joins.returns_with_orders_and_products(
        run.clean(RETURNS), first, run.clean(PRODUCTS), known_unique=True
    )
    return merged.drop(*TRACE)


def _without_some_products(run: Run) -> DataFrame:
    return run.clean(PRODUCTS).filter("category <> 'PROMO'")


@query
def orphan_orders(run: Run) -> DataFrame:
    ids = rules.known_ids(_without_some_products(run), "product_id", "_product")
    marked = rules.mark_known(run.clean(ORDERS), "product_id", ids, "known")
    return marked.filter("not known").select("order_id", "product_id", "source_row_number")


@query
def orphan_inventory(run: Run) -> DataFrame:
    ids = rules.known_ids(_without_some_products(run), "product_id", "_product")
    marked = rules.mark_known(run.clean(INVENTORY), "product_id", ids, "known")
    return marked.filter("not known").select("product_id", "warehouse", "source_row_number")


@query
def orphan_returns(run: Run) -> DataFrame:
    orders = run.clean(ORDERS).filter("order_status = 'completed'")
    ids = rules.known_ids(orders, "order_id", "_order")
    marked = rules.mark_known(run.clean(RETURNS), "order_id", ids, "known")
    return marked.filter("not known").select("return_id", "order_id", "source_row_number")


@query
def order_references(run: Run) -> DataFrame:
    found = rules.order_references(run.clean(ORDERS))
    return found.withColumn("sold_units", F.col("sold_units").cast("bigint"))


@query
def monthly_actual(run: Run) -> DataFrame:
    return comparisons.monthly_revenue(run.lines())


@query
def target_achievement(run: Run) -> DataFrame:
    achieved = comparisons.target_achievement(run.clean(TARGETS), run.lines())
    return achieved.select(
        "month", "revenue_target", "actual_revenue",
        F.col("target_achievement").cast("decimal(18,6)").alias("target_achievement"),
    )


@query
def target_bands(run: Run) -> DataFrame:
    achieved = comparisons.target_achievement(run.clean(TARGETS), run.lines())
    scaled = achieved.withColumn("target_achievement", F.col("target_achievement") * 1.6)
    return comparisons.target_bands(scaled).select("month", "target_band")


@query
def product_bands(run: Run) -> DataFrame:
    table = comparisons.product_bands(
        sales.product_performance(run.lines()), low_margin=32.0, high_return_rate=6.0
    )
    return table.select("product_id", "profit_band", "margin_band", "return_band")


# Periods and comparisons ----------------------------------------------------------------


def _period_table(run: Run, period: filters.Period) -> DataFrame:
    return run.spark.createDataFrame(
        [(period.start, period.end, period.days)], "start date, end date, days int"
    )


@query
def resolve_period(run: Run) -> DataFrame:
    return _period_table(run, filters.reporting_period(None, run.clean(ORDERS)))


@query
def previous_period(run: Run) -> DataFrame:
    period = filters.reporting_period(None, filters.filter_orders(run.clean(ORDERS), CHOICE))
    return _period_table(run, filters.previous_period(period))


def _two_years(run: Run) -> tuple[DataFrame, DataFrame]:
    earlier = filters.previous_period(filters.Period(date(1998, 1, 1), date(1998, 12, 31)))
    before = filters.SalesFilters(date_from=earlier.start, date_to=earlier.end)
    return run.lines(YEAR), run.lines(before)


@query
def period_comparison(run: Run) -> DataFrame:
    now, before = (sales.sales_kpis(lines) for lines in _two_years(run))
    return comparisons.compare_periods(now, before)


@query
def compare_values(run: Run) -> DataFrame:
    """Year over year per country, where a country may have no earlier sales."""
    now, before = (sales.country_performance(lines) for lines in _two_years(run))
    pairs = now.select("country", F.col("return_rate_percent").alias("current")).join(
        before.filter("country <> 'NATION_7'").select(
            "country", F.col("return_rate_percent").alias("previous")
        ),
        "country",
        "left",
    )
    return comparisons.compare_values(pairs, "current", "previous", F.lit(True))


@query
def kpi_cards(run: Run) -> DataFrame:
    now, before = (sales.sales_kpis(lines) for lines in _two_years(run))
    stock = run.clean(INVENTORY).agg(
        F.sum(F.col("stock_quantity") - F.col("reserved_quantity")).alias("available_stock")
    )
    cards = comparisons.kpi_cards(
        run.spark, now, comparisons.compare_periods(now, before), stock
    )
    return cards.select(
        "position", "field", "label", "value", "change", "comparison_type", "direction",
        "monetary", "rate",
    )


@query
def current_vs_previous(run: Run) -> DataFrame:
    return comparisons.current_vs_previous(*(sales.daily_revenue(x) for x in _two_years(run)))


@query
def daily_with_previous(run: Run) -> DataFrame:
    table = comparisons.daily_with_previous(*(sales.daily_revenue(x) for x in _two_years(run)))
    return table.select("date", "net_revenue", "previous_period_revenue")


@query
def comparison_long(run: Run) -> DataFrame:
    now, before = _two_years(run)
    short = filters.filter_orders(before, filters.SalesFilters(date_to="1997-09-30"))
    return comparisons.comparison_long(
        comparisons.current_vs_previous(sales.daily_revenue(now), sales.daily_revenue(short))
    )


# Inventory and recommendations ----------------------------------------------------------


def _velocity(run: Run) -> DataFrame:
    return inventory.product_velocity(
        run.orders, run.returns, date(1998, 1, 1), date(1998, 12, 31)
    )


@query
def product_velocity(run: Run) -> DataFrame:
    return _velocity(run).drop("first_day", "last_day")


@query
def revenue_cutoff(run: Run) -> DataFrame:
    velocity = Stage(run.spark).write(_velocity(run), "velocity")
    return inventory.revenue_cutoff(velocity, 0.75)


@query
def inventory_period(run: Run) -> DataFrame:
    velocity = inventory.product_velocity(run.orders, None, None, None)
    return inventory.inventory_period(velocity, run.clean(INVENTORY))


@query
def inventory_metrics(run: Run) -> DataFrame:
    return run.metrics


@query
def inventory_distribution(run: Run) -> DataFrame:
    return inventory.status_distribution(run.metrics)


@query
def available_stock_total(run: Run) -> DataFrame:
    return inventory.available_stock_total(run.metrics)


@query
def inventory_exceptions(run: Run) -> DataFrame:
    found = inventory.inventory_exceptions(run.metrics, 45)
    return issues.union_all(
        [
            table.select(F.lit(name).alias("exception"), "product_id", "warehouse")
            for name, table in found.items()
        ]
    )


@query
def inventory_top(run: Run) -> DataFrame:
    by_revenue = inventory.inventory_top(run.metrics, "net_revenue").withColumn(
        "ranking", F.lit("net_revenue")
    )
    by_returns = inventory.inventory_top(run.metrics, "return_rate_percent").withColumn(
        "ranking", F.lit("return_rate_percent")
    )
    return by_revenue.union(by_returns).select(
        "ranking", "product_id", "warehouse", "net_revenue", "return_rate_percent"
    )


def _flat(found: DataFrame) -> DataFrame:
    metrics = text.nested_text(F.col("supporting_metrics"))
    return found.withColumn("supporting_metrics", metrics)


@query
def recommendations_(run: Run) -> DataFrame:
    return _flat(run.recommendations)


@query
def filter_recommendations(run: Run) -> DataFrame:
    found = recommendations.filter_recommendations(
        run.recommendations, ("critical", "warning"), ("returns", "pricing", "sales")
    )
    return found.select("severity", "product_id", "rule_identifier")


@query
def recommendation_counts(run: Run) -> DataFrame:
    return recommendations.recommendation_counts(run.recommendations)


@query
def priority_alerts(run: Run) -> DataFrame:
    found = recommendations.recommendations(run.metrics)
    return _flat(recommendations.priority_alerts(found))


# Dashboard ------------------------------------------------------------------------------


def _scope(run: Run) -> filters.Tables:
    scoped = filters.catalogue_scope(
        run.orders, run.inventory, run.returns, ("Brand#3", "Brand#5"), ()
    )
    return filters.warehouse_scope(*scoped, ("W1", "W2", "W3", "W5", "W8"))


def _counted(tables: filters.Tables) -> DataFrame:
    return issues.union_all(
        [
            table.groupBy("product_id").agg(F.count("*").alias("rows")).select(
                F.lit(name).alias("dataset"), "product_id", "rows"
            )
            for name, table in zip(("orders", "inventory", "returns"), tables, strict=True)
        ]
    )


@query
def catalogue_scope(run: Run) -> DataFrame:
    return _counted(
        filters.catalogue_scope(
            run.orders, run.inventory, run.returns, ("Brand#3", "Brand#5"),
            tuple(f"P{n}" for n in range(0, 200, 3)),
        )
    )


@query
def warehouse_scope(run: Run) -> DataFrame:
    return _counted(_scope(run))


@query
def filter_options(run: Run) -> DataFrame:
    return filters.filter_options(run.orders, run.inventory)


@query
def dashboard_kpis(run: Run) -> DataFrame:
    return run.board.sales.kpis


@query
def dashboard_summary(run: Run) -> DataFrame:
    return run.board.summary


@query
def dashboard_inventory_risk(run: Run) -> DataFrame:
    return run.board.charts["inventory_risk"]


@query
def dashboard_comparison(run: Run) -> DataFrame:
    """Days of one year beside those of the year before, by place."""
    result = run.result
    board = dashboard.dashboard(
        result.orders, result.inventory, result.returns, BOARD, stage=Stage(run.spark)
    )
    return board.charts["current_vs_previous"]


@query
def dashboard_recommendations(run: Run) -> DataFrame:
    return run.board.recommendations.groupBy("rule_identifier", "severity").agg(
        F.count("*").alias("recommendations")
    )


@query
def dashboard_(run: Run) -> DataFrame:
    """Row counts of the dashboard's tables and charts."""
    board = run.board
    sections = {
        name: board.tables[name]
        for name in (
            "out_of_stock_and_critical", "below_reorder_level", "dead_stock", "overstock",
            "no_sales",
        )
    }
    sections["recommendations"] = board.recommendations
    for name in ("revenue_over_time", "sales_by_country", "sales_by_channel"):
        sections[name] = board.charts[name]
    return issues.union_all(
        [
            table.agg(F.count("*").alias("rows")).select(F.lit(name).alias("section"), "rows")
            for name, table in sections.items()
        ]
    )


# Cleaning -------------------------------------------------------------------------------


def _kept(annotated: DataFrame) -> DataFrame:
    return issues.kept_rows(annotated).drop(*TRACE)


@query
def clean_orders(run: Run) -> DataFrame:
    return _kept(run.cleaned(ORDERS))


@query
def clean_products(run: Run) -> DataFrame:
    return _kept(run.cleaned(PRODUCTS))


@query
def clean_inventory(run: Run) -> DataFrame:
    return _kept(run.cleaned(INVENTORY))


@query
def clean_returns(run: Run) -> DataFrame:
    return _kept(run.cleaned(RETURNS))


@query
def clean_targets(run: Run) -> DataFrame:
    return _kept(run.cleaned(TARGETS))


@query
def cleaning_issues(run: Run) -> DataFrame:
    return issues.issue_rows(run.cleaned(ORDERS), ORDERS)


@query
def cleaning_stats(run: Run) -> DataFrame:
    return issues.union_all(
        [
            cleaning.cleaning_stats(run.cleaned(kind), kind)
            for kind in (ORDERS, PRODUCTS, INVENTORY, RETURNS, TARGETS)
        ]
    )


@query
def default_currency(run: Run) -> DataFrame:
    code = cleaning.default_currency(run.mapped(ORDERS))
    return run.spark.createDataFrame([(code,)], "default_currency string")


@query
def dedupe_keep_first(run: Run) -> DataFrame:
    keys = ["order_id", "product_id"]
    return duplicates.drop_duplicates(run.clean(ORDERS), keys).drop(*TRACE)


@query
def dedupe_keep_latest(run: Run) -> DataFrame:
    """Latest return per order and product, some dates blanked out."""
    dated = run.clean(RETURNS).withColumn(
        "return_date", F.when(F.col("source_row_number") % 3 != 0, F.col("return_date"))
    )
    keys = ["product_id", "return_reason"]
    kept = duplicates.drop_duplicates(dated, keys, "keep_latest", "return_date", Stage(run.spark))
    return kept.drop(*TRACE)


@query
def dedupe_exclude_all(run: Run) -> DataFrame:
    keys = ["order_id", "product_id"]
    kept = duplicates.drop_duplicates(
        run.clean(ORDERS), keys, "exclude_all", stage=Stage(run.spark)
    )
    return kept.drop(*TRACE)


@query
def dedupe_keep_last_row(run: Run) -> DataFrame:
    """Products have no date, so the last copy of an identifier is the latest."""
    annotated = run.cleaned(PRODUCTS, "keep_latest")
    return _kept(annotated).select("product_id", "product_name", "source_row_number")


@query
def normalized_values(run: Run) -> DataFrame:
    """Scalar normalisers over the raw order cells."""
    raw = run.mapped(ORDERS)
    return raw.select(
        "source_row_number",
        text.squeeze(F.col("order_id")).alias("order_id"),
        text.country_name(F.col("country")).alias("country"),
        text.order_status(F.col("order_status")).alias("order_status"),
        text.sales_channel(F.col("sales_channel")).alias("sales_channel"),
        text.currency_code(F.col("currency")).alias("currency"),
    )


@query
def parsed_values(run: Run) -> DataFrame:
    """Number and date parsers over the raw order cells."""
    raw = run.mapped(ORDERS)
    return raw.select(
        "source_row_number",
        numeric.parse_integer(F.col("quantity")).alias("quantity"),
        numeric.parse_number(F.col("unit_price"), numeric.MONEY).alias("unit_price"),
        numeric.parse_number(F.col("discount"), numeric.RATE).alias("discount"),
        dates.parse_text_date(F.col("order_date")).alias("order_date"),
        numeric.strict_number(F.col("quantity"), "string", True)
        .cast("bigint")
        .alias("strict_quantity"),
    )


@query
def converted_currency(run: Run) -> DataFrame:
    options = cleaning.CleaningOptions("USD", RATES)
    orders = run.mapped(ORDERS).select("source_row_number", "currency", "unit_price")
    amount = numeric.parse_number(F.col("unit_price"), numeric.MONEY)
    return orders.select(
        "source_row_number",
        cleaning.convert_currency(amount, F.col("currency"), options).alias("unit_price"),
    )


# Validation and pipeline ----------------------------------------------------------------


@query
def validate_all(run: Run) -> DataFrame:
    """Issues of the typed tables checked on their own, against a reduced catalogue."""
    tables = {kind: run.clean(kind) for kind in KINDS}
    tables[PRODUCTS] = _without_some_products(run)
    checked = rules.validate_all(tables)
    return issues.union_all([issues.issue_rows(checked[kind], kind) for kind in KINDS])


def _planted(run: Run) -> dict[str, DataFrame]:
    """The whole typed tables as text, with errors that cleaning would have caught before."""
    place = F.col("source_row_number")

    def text(kind: str, **cells: Column) -> DataFrame:
        table = run.clean(kind)
        typed = {n: F.col(n).cast("string") for n, _ in table.dtypes if n not in (*TRACE, "source_row_number")}
        return table.select(*[typed.get(n, F.col(n)).alias(n) for n in table.columns]).withColumns(cells)

    def where(every: int, value: str | None, column: str) -> Column:
        return F.when(place % every == 3, F.lit(value)).otherwise(F.col(column))

    products = text(PRODUCTS, vat_rate=where(29, "1.2", "vat_rate"), product_name=where(31, " ", "product_name"))
    again = products.filter(place % 37 == 3).withColumn("source_row_number", place + 1_000_000_000)
    targets = text(
        TARGETS,
        month=where(7, "2031-13", "month"), revenue_target=where(11, "-1", "revenue_target"),
        profit_target=where(13, "-0.5", "profit_target"), orders_target=where(5, "-2", "orders_target"),
    )
    return {
        ORDERS: text(
            ORDERS,
            order_id=where(89, "", "order_id"), order_date=where(97, None, "order_date"),
            currency=where(101, "doge", "currency"), discount=where(103, "1500", "discount"),
            quantity=where(107, "1.5", "quantity"), unit_price=where(109, "free", "unit_price"),
        ),
        PRODUCTS: products.unionByName(again),
        INVENTORY: text(
            INVENTORY,
            last_restock_date=where(113, "soon", "last_restock_date"), stock_quantity=where(127, "-1", "stock_quantity"),
            reorder_level=where(131, "-7", "reorder_level"),
        ),
        RETURNS: text(
            RETURNS,
            return_date=where(137, "12/31/1989", "return_date"), quantity=where(139, "0", "quantity"),
            refund_amount=where(149, "-0.01", "refund_amount"), order_id=where(151, "O-NONE", "order_id"),
        ),
        TARGETS: targets.unionByName(
            targets.filter("source_row_number % 17 = 4").withColumn("source_row_number", place + 1_000_000_000)
        ),
    }


@query
def validate_planted(run: Run) -> DataFrame:
    """Codes that typed values cannot raise, counted by table, field and code."""
    checked = rules.validate_all(_planted(run))
    found = issues.union_all([issues.issue_rows(checked[kind], kind) for kind in KINDS])
    return found.groupBy("source_dataset", "field", "issue_code", "severity", "message").agg(
        F.count("*").alias("issues"), F.sum("row_number").alias("row_total"),
        F.min("original_value").alias("least_value"),
    )


@query
def duplicated_rows(run: Run) -> DataFrame:
    """Full copies of raw orders, planted beside copies that differ in one column."""
    names = [c for c in run.raw(ORDERS).columns if c not in (*TRACE, "source_row_number")]
    raw, place = run.raw(ORDERS), F.col("source_row_number")
    copies = raw.filter(place % 101 == 5).withColumn("source_row_number", place + 1_000_000_000)
    near = raw.filter(place % 103 == 6).withColumns(
        {"source_row_number": place + 2_000_000_000, "Note": F.concat("Note", F.lit("!"))}
    )
    marked = duplicates.with_repeated_rows(raw.unionByName(copies).unionByName(near), names, "repeated")
    return marked.filter("repeated").select("source_row_number", *names)


@query
def structural_issues(run: Run) -> DataFrame:
    """Raw returns read as orders: some required columns cannot be mapped."""
    mapped = processing.map_dataset(run.raw(RETURNS), ORDERS, "returns")
    rows = mapped.frame.agg(F.count("*").alias("blocked_rows"))
    counted = issues.union_all(
        [
            processing.structural_issues(mapped).select("field", "issue_code"),
            rows,
        ]
    )
    return counted


@query
def mapping_report(run: Run) -> DataFrame:
    return run.result.mapping


@query
def all_issues(run: Run) -> DataFrame:
    return run.result.issues


@query
def excluded_rows(run: Run) -> DataFrame:
    return run.result.excluded_rows.select(
        "source_dataset", "source_row_number", "processing_status", "exclusion_reason",
        "product_id", "order_id", "quantity", "unit_price", "currency", "month",
    )


@query
def exclusion_reasons(run: Run) -> DataFrame:
    return run.result.excluded_rows.groupBy("source_dataset", "exclusion_reason").agg(
        F.count("*").alias("rows")
    )


@query
def split_blocked(run: Run) -> DataFrame:
    return _kept(run.result.annotated[RETURNS])


@query
def processed_orders(run: Run) -> DataFrame:
    return run.result.orders.drop("source_file", "exclusion_reason")


@query
def processed_inventory(run: Run) -> DataFrame:
    return run.result.inventory.drop("source_file", "exclusion_reason")


@query
def processed_returns(run: Run) -> DataFrame:
    return run.result.returns.drop("source_file", "exclusion_reason")


@query
def processing_stats(run: Run) -> DataFrame:
    return run.result.statistics


@query
def row_health(run: Run) -> DataFrame:
    return run.result.health


@query
def quality_score(run: Run) -> DataFrame:
    return run.result.scores.select("dataset", "quality_score")


@query
def combined_quality(run: Run) -> DataFrame:
    return run.result.quality


@query
def score_label(run: Run) -> DataFrame:
    return run.result.scores.select(
        "dataset", text.score_label(F.col("quality_score")).alias("label")
    )


@query
def quality_summary(run: Run) -> DataFrame:
    return run.result.summary


@query
def categorize_issues(run: Run) -> DataFrame:
    found = quality.categorize_issues(run.result.issues)
    return found.groupBy("source_dataset", "issue_code", "category").agg(
        F.count("*").alias("issues")
    )


@query
def issue_groups(run: Run) -> DataFrame:
    return quality.group_issues(run.result.issues).select(
        "category", "affected_rows", "issue_count", "highest_severity"
    )


def _decisions(run: Run) -> DataFrame:
    """Every blocking order and product issue is marked; other datasets are left open."""
    found = run.result.issues.filter(F.col("source_dataset").isin(ORDERS, PRODUCTS))
    return quality.mark_excluded(found)


@query
def issue_views(run: Run) -> DataFrame:
    views = quality.issue_views(run.result.issues, _decisions(run))
    return views.select("issue_id", "category", "action", "processing_status")


@query
def filter_issues(run: Run) -> DataFrame:
    chosen = quality.IssueFilters(
        datasets=(ORDERS, RETURNS), severities=("error",),
        categories=("Relationship Errors", "Invalid Types"), search="PRODUCT",
    )
    views = quality.issue_views(run.result.issues, _decisions(run))
    return quality.filter_issue_views(views, chosen).select("issue_id", "issue_code")


@query
def issue_export(run: Run) -> DataFrame:
    return quality.issue_export(run.result.issues, _decisions(run))


@query
def generation_gate(run: Run) -> DataFrame:
    return quality.generation_gate(run.result.issues, strict=True)


@query
def review_gate(run: Run) -> DataFrame:
    return quality.review_gate(run.result.issues, _decisions(run), warnings_confirmed=True)


@query
def accepted_actions(run: Run) -> DataFrame:
    actions = quality.accept_and_continue(run.result.issues, _decisions(run))
    return actions.groupBy("action").agg(F.count("*").alias("issues"))


@query
def process_datasets(run: Run) -> DataFrame:
    """Whole pipeline followed by the KPIs of what it accepted."""
    result = run.result
    return sales.sales_kpis(sales.sales_lines(result.orders, result.returns))


@query
def report_analytics(run: Run) -> DataFrame:
    return sales.by_net_revenue(run.report.sales.categories)


@query
def report_inventory(run: Run) -> DataFrame:
    return run.report.inventory.select(
        "product_id", "warehouse", "available_stock", "stock_coverage_days", "inventory_status",
        "suggested_reorder_quantity", "days_since_last_sale", "units_sold", "is_high_revenue",
        "as_of_date",
    )


# Sources, sinks, and the run log --------------------------------------------------------


def _landed(run: Run, kind: str) -> str:
    """Write a raw table's data columns as semicolon CSV and return its folder."""
    folder = f"{Stage(run.spark).path}/{kind}.csv"
    table = run.raw(kind).drop("source_row_number", *TRACE)
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    table.write.options(header=True, sep=";", **kept).csv(folder)
    return folder


def _landed_in_dialects(run: Run) -> str:
    """Write the raw returns in three ways, a folder each, with accents, short rows and ``n/a`` cells."""
    root = f"{Stage(run.spark).path}/returns.csv"
    table = run.raw(RETURNS)
    names = [c for c in table.columns if c not in ("source_row_number", *TRACE)]
    accented = table.withColumn("Reason", F.concat("Reason", F.lit(" é")))
    raw = {"quote": "", "sep": "\u0001", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    for part, (sep, encoding) in enumerate(((";", "UTF-8"), (",", "ISO-8859-1"), ("\t", "UTF-16"))):
        cells = [
            F.when(F.col(n).isNull(), F.lit("n/a"))
            .when(F.col(n).contains(sep), F.concat(F.lit('"'), n, F.lit('"')))
            .otherwise(F.col(n))
            for n in names
        ]
        short = F.concat_ws(sep, *cells[:-1])
        line = F.when(F.col("Reason").isNull(), short).otherwise(F.concat_ws(sep, *cells))
        rows = accented.filter(F.col("source_row_number") % 3 == part)
        written = rows.select(line.alias(sep.join(names)))
        written.write.options(header=True, encoding=encoding, **raw).csv(f"{root}/{part}")
    return root


@query
def read_csv_source(run: Run) -> DataFrame:
    return files.read_csv_source(run.spark, _landed(run, RETURNS)).frame


@query
def read_mixed_csv(run: Run) -> DataFrame:
    """Files in three encodings with three delimiters, short rows and spelled-out nulls."""
    return files.load_source(run.spark, _landed_in_dialects(run)).frame


@query
def mixed_row_numbers(run: Run) -> DataFrame:
    """Rows of files in several dialects, numbered per file: totals, and whether numbers have gaps."""
    source = files.load_source(run.spark, _landed_in_dialects(run))
    per_file = files.traced(source, Stage(run.spark)).groupBy("source_file").agg(
        F.count("*").alias("rows"),
        F.countDistinct("source_row_number").alias("numbers"),
        F.max("source_row_number").alias("high"),
    )
    dense = (F.col("numbers") == F.col("rows")) & (F.col("high") == F.col("rows") + 1)
    folder = F.substring_index("source_file", "/", 1).alias("folder")
    return per_file.groupBy(folder).agg(F.sum("rows").alias("rows"), F.bool_and(dense).alias("dense"))


@query
def with_trace(run: Run) -> DataFrame:
    """Rows of a CSV folder numbered per file: totals, and whether numbering has gaps."""
    folder = f"{Stage(run.spark).path}/orders.csv"
    orders = run.sample.table("orders").select("o_orderkey", "o_orderstatus")
    orders.repartition(4, "o_orderstatus").write.option("header", True).csv(folder)
    numbered = files.number_rows(files.load_source(run.spark, folder).frame, Stage(run.spark))
    per_file = numbered.groupBy("source_file").agg(
        F.count("*").alias("rows"),
        F.countDistinct("source_row_number").alias("numbers"),
        F.min("source_row_number").alias("low"),
        F.max("source_row_number").alias("high"),
        F.sum(F.col("o_orderkey").cast("bigint")).alias("keys"),
    )
    dense = (F.col("numbers") == F.col("rows")) & (F.col("high") - F.col("low") + 1 == F.col("rows"))
    return per_file.agg(
        F.sum("rows").alias("rows"),
        F.sum("keys").alias("key_total"),
        F.bool_and(dense & (F.col("low") == 2)).alias("dense"),
    )


@query
def source_profile(run: Run) -> DataFrame:
    profile = files.source_profile(files.load_source(run.spark, _landed_in_dialects(run)), RETURNS)
    return profile.groupBy("dataset", "file_type", "column_count", "columns",
                           "detected_delimiter", "detected_encoding").agg(
        F.sum("row_count").alias("row_count"), F.bool_and(F.col("file_size") > 0).alias("sized")
    )


def _landed_pages(run: Run, size: int = 500) -> str:
    """Write the typed orders as page envelopes and return their folder."""
    columns = ["order_id", "order_date", "product_id", "quantity", "unit_price"]
    orders = run.clean(ORDERS)
    total = orders.count()
    cells = [part for c in columns for part in (F.lit(c), F.col(c).cast("string"))]
    page = F.floor((F.col("source_row_number") - 2) / size) + 1
    last = (total + size - 1) // size
    envelopes = (
        orders.groupBy(page.cast("bigint").alias("page"))
        .agg(F.collect_list(F.create_map(*cells)).alias("items"))
        .select(
            "items",
            F.array(*[F.lit(c) for c in columns]).alias("columns"),
            "page",
            F.lit(size).alias("page_size"),
            F.lit(total).alias("total"),
            F.when(F.col("page") < last, F.col("page") + 1).alias("next_page"),
        )
    )
    folder = f"{Stage(run.spark).path}/orders-pages"
    envelopes.write.option("ignoreNullFields", False).json(folder)
    return folder


@query
def read_api_pages(run: Run) -> DataFrame:
    return pages.read_api_pages(run.spark, _landed_pages(run), ORDERS)


@query
def load_sources(run: Run) -> DataFrame:
    """Four datasets from files and one from pages, each counted."""
    stage = Stage(run.spark)
    folders = {}
    for kind in (PRODUCTS, INVENTORY, RETURNS, TARGETS):
        folders[kind] = f"{stage.path}/{kind}.parquet"
        run.raw(kind).write.parquet(folders[kind])
    loaded = files.load_sources(
        run.spark, folders, {ORDERS: _landed_pages(run)}, allow_mixed=True
    )
    return issues.union_all(
        [
            source.frame.agg(F.count("*").alias("rows")).select(
                F.lit(kind).alias("dataset"), F.lit(source.file_type).alias("file_type"), "rows"
            )
            for kind, source in loaded.items()
        ]
    )


@query
def write_table(run: Run) -> DataFrame:
    """A dashboard table written as CSV and read back as text."""
    folder = f"{Stage(run.spark).path}/channels.csv"
    reporting.write_table(sales.channel_performance(run.lines()), folder)
    return files.load_source(run.spark, folder).frame.select(
        "sales_channel", "net_revenue", "orders", "units_sold"
    )


@query
def section_totals(run: Run) -> DataFrame:
    return reporting.section_totals(sales.country_performance(run.lines()))


def _published(run: Run) -> str:
    """Publish the whole report, once a run; a smaller report is published over by it."""
    if run.report_folder is None:
        folder = f"{Stage(run.spark).path}/report"
        sections = reporting.report_sections(run.result, run.report)
        reporting.write_sections({"stale": sections["summary_kpis"]}, folder)
        reporting.write_sections(sections, folder, overwrite=True)
        publishing.remove_replaced(run.spark, folder)
        run.report_folder = folder
    return run.report_folder


@query
def write_report_mart(run: Run) -> DataFrame:
    """A whole report folder; its country section read back."""
    return publishing.read_section(run.spark, _published(run), "sales_countries")


@query
def report_manifest(run: Run) -> DataFrame:
    """Rows of every published section, and whether the manifest says the same."""
    folder = _published(run)
    return issues.union_all(
        [
            publishing.read_section(run.spark, folder, section.name).agg(
                F.lit(section.name).alias("section"),
                F.count("*").alias("rows"),
                (F.count("*") == section.rows).alias("as_listed"),
            )
            for section in publishing.manifest(run.spark, folder).sections
        ]
    )


# Sections compared value by value; the others hold the same tables as queries of their own.
VALUED = (
    "summary_kpis", "summary_trend", "summary_categories", "summary_top_products", "sales_daily",
    "sales_weekly", "sales_countries", "sales_channels", "products_categories",
    "products_top_revenue", "products_top_profit", "products_bands", "inventory",
    "inventory_status", "recommendations", "quality_issues", "processed_orders",
)


@query
def report_values(run: Run) -> DataFrame:
    """What every column of the published sections holds: filled cells, distinct values, sum."""
    folder = _published(run)
    long = []
    for name in VALUED:
        table = publishing.read_section(run.spark, folder, name)
        cells = table.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in table.columns])
        # Equal cells are counted first, so that each value is read as a number once.
        copies = F.col("copies").cast("decimal(20,0)")
        amount = F.sum(F.col("cell").try_cast("decimal(38,4)") * copies).cast("double")
        long.append(
            cells.unpivot([], cells.columns, "column_name", "cell")
            .groupBy("column_name", "cell")
            .agg(F.count("*").alias("copies"))
            .groupBy(F.lit(name).alias("section"), "column_name")
            .agg(
                F.coalesce(F.sum(F.when(F.col("cell").isNotNull(), F.col("copies"))), F.lit(0)).alias("filled"),
                F.count("cell").alias("distinct_values"),
                amount.alias("amount"),
            )
        )
    return issues.union_all(long)


@query
def write_validation_mart(run: Run) -> DataFrame:
    """A whole validation folder; its summary section read back."""
    folder = f"{Stage(run.spark).path}/validation"
    settings = {"default_currency": "USD", "api_token": "hidden", "month_first": False}
    reporting.write_sections(reporting.validation_sections(run.result, settings), folder)
    return publishing.read_section(run.spark, folder, "summary")


def _states(run: Run) -> DataFrame:
    """The events as run states: one run per user, one state per event."""
    event = run.sample.events
    status = F.create_map(
        *[
            F.lit(part)
            for pair in (
                ("signup", runlog.PENDING), ("view", runlog.RUNNING),
                ("purchase", runlog.COMPLETED), ("click", runlog.WITH_WARNINGS),
                ("error", runlog.FAILED),
            )
            for part in pair
        ]
    )[F.col("event_type")]
    key, day = F.col("event_id"), F.col("ts").cast("date")
    reported = F.col("event_type").isin("purchase", "click")
    path = F.concat(F.lit("/reports/"), key.cast("string"), F.lit(".xlsx"))
    failed = F.col("event_type") == "error"
    return event.select(
        F.concat(F.lit("RUN-"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("run_id"),
        F.col("ts").alias("started_at"),
        status.alias("status"),
        F.date_sub(day, 30).alias("reporting_period_start"),
        day.alias("reporting_period_end"),
        F.create_map(
            F.lit("orders"), F.concat(F.lit("/in/"), key.cast("string"), F.lit("/orders.csv"))
        ).alias("source_filenames"),
        F.create_map(F.lit("orders"), key, F.lit("returns"), F.col("user_id")).alias(
            "source_row_counts"
        ),
        (key % 7).alias("excluded_row_count"),
        (key % 3).alias("warning_count"),
        (key % 2).alias("error_count"),
        F.when(reported, path).alias("report_path"),
        F.when(reported & (key % 2 == 0), text.base_name(path)).alias("report_filename"),
        F.create_map(
            F.lit("theme"), F.lit("dark"), F.lit("API-Token"), key.cast("string"),
            F.lit("database_url"), F.lit("x"), F.lit("logo"), F.lit("y"),
        ).alias("configuration_snapshot"),
        F.when(
            failed,
            F.concat(F.lit("Stopped: password="), key.cast("string"), F.lit(", Bearer t; retry")),
        ).alias("failure_summary"),
        F.when(key % 5 != 0, F.col("value") * 10).alias("duration_seconds"),
        key.alias("state_number"),
        (key % 17 == 0).alias("deleted"),
    )


@query
def run_ids(run: Run) -> DataFrame:
    requests = run.sample.events.select("event_id", F.col("ts").alias("started_at"))
    return runlog.assign_run_ids(requests, tie=["event_id"]).select("event_id", "run_id")


@query
def latest_runs(run: Run) -> DataFrame:
    return runlog.latest_runs(_states(run)).select("run_id", "status", "state_number")


@query
def list_runs(run: Run) -> DataFrame:
    found = runlog.list_runs(
        runlog.latest_runs(_states(run)),
        statuses=(runlog.COMPLETED, runlog.WITH_WARNINGS, runlog.FAILED),
        started_from=date(2024, 1, 2),
        limit=5000,
    )
    return found.select("run_id", "status", "state_number")


@query
def run_history(run: Run) -> DataFrame:
    runs = runlog.latest_runs(_states(run))
    available = runs.filter("state_number % 3 = 0 and report_path is not null").select("run_id")
    history = runlog.run_history(runs, available)
    return history.drop("started_at", "duration")


@query
def run_details(run: Run) -> DataFrame:
    details = runlog.run_details(runlog.latest_runs(_states(run)))
    return details.select(
        "run_id",
        F.col("source_filenames")["orders"].alias("orders_file"),
        F.array_join(F.map_keys("configuration_snapshot"), ",").alias("settings"),
        "failure_summary",
    )


@query
def run_durations(run: Run) -> DataFrame:
    timed = runlog.latest_runs(_states(run))
    whole = F.floor(F.col("duration_seconds")).cast("double")
    return timed.select("run_id", text.duration_label(whole).alias("duration"))


@query
def redact_text(run: Run) -> DataFrame:
    key = F.col("event_id").cast("string")
    message = F.concat(
        F.lit("user u"), key, F.lit("@Example.com sent {\"Order_ID\": "), key,
        F.lit(", \"n\": 1} with Access-Token : abc"), key, F.lit("; secret=s; note kept"),
    )
    return run.sample.events.select("event_id", text.redact_message(message).alias("message"))

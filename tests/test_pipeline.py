"""Pipeline cascade, quality, dashboard, reports, and the run log."""

from __future__ import annotations

import json
from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tillwise.errors import ConfigError, GateError, ReportError, RetailDataError
from tillwise.operators import quality
from tillwise.operators.filters import DashboardFilters, filter_options
from tillwise.operators.issues import ISSUE_SCHEMA
from tillwise.plans import catalog, processing
from tillwise.plans.dashboard import dashboard
from tillwise.plans.generation import ReportOptions, generate_report
from tillwise.plans.processing import PipelineOptions, process_datasets, process_sources
from tillwise.plans.publishing import (
    Manifest,
    _commit,
    manifest,
    publish,
    published_size,
    read_section,
    remove_replaced,
)
from tillwise.plans.reporting import (
    quality_report_sections,
    report_analytics,
    report_sections,
    section_totals,
    supports_total,
    validation_sections,
    write_sections,
)
from tillwise.plans.runlog import RunLog, assign_run_ids, list_runs, run_history
from tillwise.sources.files import load_sources
from tillwise.sources.sample import Sample
from tillwise.staging import at_once

FOLDER = "/root/testdata/sf0.001"
KINDS = ("orders", "products", "inventory", "returns", "monthly_targets")


@pytest.fixture(scope="module")
def small(table):
    return {
        "orders": table(
            "`Order Number` string, Date string, SKU string, Qty string, Price string, "
            "Currency string",
            ("O-1", "2025-01-01", "P-1", "2", "10", "EUR"),
            ("O-2", "2025-01-01", "P-9", "1", "10", "EUR"),
            ("O-3", "2025-01-02", "P-1", "x", "10", "EUR"),
            ("O-1", "2025-01-05", "P-1", "9", "10", "EUR"),
            ("O-4", "2025-01-03", "P-2", "1", "10", "EUR"),
        ),
        "products": table(
            "product_id string, product_name string, purchase_cost string, "
            "recommended_price string, category string, supplier string",
            ("P-1", "Desk", "5", "10", "Office", "Supplier A"),
            ("P-2", None, "5", "10", "Office", "Supplier A"),
            ("P-3", "Lamp", "9", "8", "Home", "Supplier B"),
        ),
        "inventory": table(
            "product_id string, warehouse string, stock_quantity string, reorder_level string, "
            "last_restock_date string",
            ("P-1", "Nicosia", "10", "15", "2024-12-01"), ("P-2", "Nicosia", "1", "0", None),
        ),
        "returns": table(
            "return_id string, order_id string, product_id string, return_date string, "
            "quantity string, refund_amount string",
            ("R-1", "O-1", "P-1", "2025-01-03", "1", "0"),
            ("R-2", "O-2", "P-9", "2025-01-03", "1", "5"),
            ("R-3", "O-1", "P-1", "2024-12-31", "3", "5"),
        ),
    }


@pytest.fixture(scope="module")
def processed(small):
    return process_datasets(small)


def test_exclusions_cascade(processed):
    assert [r["order_id"] for r in processed.orders.collect()] == ["O-1"]
    assert [r["product_id"] for r in processed.inventory.collect()] == ["P-1"]
    assert [r["return_id"] for r in processed.returns.collect()] == ["R-1"]
    reasons = {
        (r["source_dataset"], r["source_row_number"]): r["exclusion_reason"]
        for r in processed.excluded_rows.collect()
    }
    assert reasons == {
        ("products", 3): "missing_product_name",
        ("orders", 3): "unknown_product_id",
        ("orders", 4): "invalid_numeric_value",
        ("orders", 5): "duplicate_row",
        ("orders", 6): "unknown_product_id",
        ("inventory", 3): "unknown_product_id",
        ("returns", 3): "unknown_order_id; unknown_product_id",
        ("returns", 4): "return_date_before_order_date; returned_quantity_exceeds_sold",
    }
    assert processed.currency == "EUR" and processed.targets is None
    order = processed.orders.first()
    assert (order["product_name"], order["reporting_month"]) == ("Desk", "2025-01")
    assert processed.returns.first()["sold_quantity"] == 2
    assert processed.inventory.first()["product_product_name"] == "Desk"


def test_counts_add_up(processed):
    for row in processed.statistics.collect():
        assert row["input_rows"] == row["processed_rows"] + row["excluded_rows"]
    summary = processed.summary.first()
    assert summary["source_rows"] == 13 and summary["warnings"] == 2
    scores = {r["dataset"]: r["quality_score"] for r in processed.scores.collect()}
    assert scores["products"] == 50.0  # clean, error, warning only


def test_unmapped_columns_block_a_dataset(small, table):
    tables = dict(small)
    tables["returns"] = table("return_id string, order_id string, `Order Reference` string", ("R", "O", "X"))
    result = process_datasets(tables)
    assert result.returns.isEmpty()
    found = {(r["field"], r["issue_code"]) for r in result.issues.filter("row_number is null").collect()}
    assert ("order_id", "ambiguous_column_mapping") in found
    assert ("quantity", "missing_required_column") in found
    assert ("order_id", "missing_required_column") not in found
    reason = result.excluded_rows.filter("source_dataset = 'returns'").first()["exclusion_reason"]
    assert reason == "ambiguous_column_mapping; missing_required_column"
    health = result.scores.filter("dataset = 'returns'").first()
    assert (health["error_rows"], health["quality_score"]) == (1, 0.0)


def test_shared_column_names_are_told_apart(small):
    tables = dict(small)
    tables["orders"] = tables["orders"].withColumn("category", F.lit("own"))
    row = process_datasets(tables).orders.first()
    assert (row["category_x"], row["category_y"]) == ("own", "Office")


def test_odd_headings_pass_through(small):
    tables = dict(small)
    tables["orders"] = tables["orders"].withColumn("Note.to `us`", F.lit("n"))
    tables["products"] = tables["products"].withColumn("size (cm.)", F.lit("s"))
    result = process_datasets(tables)
    row = result.orders.first()
    assert (row["Note.to `us`"], row["size (cm.)"]) == ("n", "s")
    assert result.excluded_rows.filter("source_dataset = 'orders'").count() == 4


def test_sample_pipeline_invariants(spark):
    sample = Sample(spark, FOLDER)
    result = process_datasets(
        {kind: sample.raw(kind) for kind in KINDS}, PipelineOptions("USD", {"EUR": 1.1, "GBP": 1.25})
    )
    assert result.orders.groupBy("order_id", "product_id").count().filter("count > 1").isEmpty()
    assert result.orders.count() == result.statistics.filter("dataset = 'orders'").first()["processed_rows"]
    assert result.excluded_rows.filter("exclusion_reason = ''").isEmpty()


def test_pipeline_from_files(spark, tmp_path):
    files = {
        "orders": "Order Number;Date;SKU;Qty;Price\nO-1;31/01/2025;P-1;2;1.000,50\n",
        "products": "product_id,product_name,purchase_cost,recommended_price\nP-1,Desk,5,10\n",
        "inventory": "product_id,warehouse,stock_quantity\nP-1,W,4\n",
    }
    for kind, body in files.items():
        (tmp_path / f"{kind}.csv").write_text(body)
    returned = {
        "items": [{"return_id": "R-1", "order_id": "O-1", "product_id": "P-1",
                   "return_date": "2025-02-01", "quantity": "1", "refund_amount": "5"}],
        "page": 1, "page_size": 10, "total": 1, "next_page": None,
    }
    returned["columns"] = list(returned["items"][0])
    (tmp_path / "pages.json").write_text(json.dumps(returned))
    sources = load_sources(
        spark, {kind: str(tmp_path / f"{kind}.csv") for kind in files},
        {"returns": str(tmp_path / "pages.json")}, allow_mixed=True,
    )
    result, profiles = process_sources(sources)
    row = result.orders.first()
    assert (row["unit_price"], row["source_file"], row["source_row_number"]) == (D("1000.5"), "orders.csv", 2)
    assert result.issues.isEmpty()
    back = result.returns.first()
    assert (back["source_file"], back["source_row_number"]) == ("api_returns.json", 2)
    assert profiles.count() == 4


@pytest.fixture(scope="module")
def issue_table(spark):
    rows = [
        ("warning", "products", "p", 3, "recommended_price", "recommended_price_below_cost", "low", "5", "Review", True),
        ("error", "products", "p", 4, "product_name", "missing_product_name", "gone", None, "Fix", False),
        ("error", "products", "p", 4, "purchase_cost", "negative_purchase_cost", "neg", "-1", "Fix", False),
        ("error", "returns", "r", None, "quantity", "missing_required_column", "none", None, "Map", False),
    ]
    return spark.createDataFrame(rows, ISSUE_SCHEMA)


def test_score_counts_a_row_once(spark):
    schema = "dataset string, total_rows bigint, error_rows bigint, warning_rows bigint, valid_rows bigint, has_dataset_issues boolean"
    rows = [("a", 4, 1, 1, 2, False), ("b", 0, 0, 0, 0, False), ("c", 0, 0, 0, 0, True)]
    scores = quality.quality_score(spark.createDataFrame(rows, schema))
    assert {r["dataset"]: r["quality_score"] for r in scores.collect()} == {"a": 62.5, "b": 100.0, "c": 0.0}
    three = [("orders", 3, 0, 0, 3, False), ("products", 1, 1, 0, 0, False)]
    combined = quality.combined_quality(quality.quality_score(spark.createDataFrame(three, schema)))
    assert combined.first()["quality_score"] == 75.0


def test_issue_groups_and_states(spark, issue_table):
    groups = [(r["category"], r["affected_rows"], r["highest_severity"]) for r in quality.group_issues(issue_table).collect()]
    assert groups == [
        ("Missing Required Columns", 1, "error"), ("Missing Values", 1, "error"),
        ("Business Rule Violations", 1, "error"), ("Transformation Warnings", 1, "warning"),
    ]
    views = quality.issue_views(issue_table, quality.no_actions(spark))
    states = {r["issue_code"]: r["processing_status"] for r in views.collect()}
    assert states == {
        "recommended_price_below_cost": "Reviewable warning",
        "missing_product_name": "Exclusion required",
        "negative_purchase_cost": "Exclusion required",
        "missing_required_column": "Blocking — source correction required",
    }
    search = quality.IssueFilters(severities=("error",), search="NEG")
    assert quality.filter_issue_views(views, search).count() == 1


def test_gates(spark, issue_table):
    with pytest.raises(GateError, match="3 blocking"):
        quality.ensure_generation_allowed(issue_table)
    warnings = issue_table.filter("severity = 'warning'")
    assert quality.ensure_generation_allowed(warnings) is False
    assert quality.ensure_generation_allowed(warnings, strict=True, allow_warnings=True) is True
    with pytest.raises(GateError, match="Strict"):
        quality.ensure_generation_allowed(warnings, strict=True)
    rows = issue_table.filter("row_number is not null")
    open_review = quality.review_gate(rows, quality.no_actions(spark), True).first()
    assert (open_review["unresolved_exclusions"], open_review["may_continue"]) == (2, False)
    assert quality.review_gate(rows, quality.mark_excluded(rows), True).first()["may_continue"]
    assert not quality.review_gate(rows, quality.mark_excluded(rows)).first()["may_continue"]
    decided = quality.accept_and_continue(rows, quality.no_actions(spark))
    assert decided.filter("action = 'Accepted with warning'").count() == 1


def test_dashboard(processed):
    board = dashboard(processed.orders, processed.inventory, processed.returns, default_currency="EUR")
    kpis = board.sales.kpis.first()
    assert (kpis["net_revenue"], kpis["gross_profit"], kpis["orders"]) == (D("20.00"), D("10.00"), 1)
    summary = board.summary.first()
    assert (summary["currency"], summary["filtered_order_rows"]) == ("EUR", 1)
    assert board.cards.count() == 8
    assert not board.tables["below_reorder_level"].isEmpty()
    assert not board.recommendations.isEmpty()
    options = filter_options(processed.orders, processed.inventory)
    assert ("suppliers", "Supplier A") in {tuple(r) for r in options.collect()}


@pytest.mark.parametrize(
    ("chosen", "orders", "stock"),
    [
        (DashboardFilters(warehouses=("Nicosia",)), 1, 1),
        (DashboardFilters(warehouses=("Unknown",)), 0, 0),
        (DashboardFilters(suppliers=("Supplier A",), products=("P-1",)), 1, 1),
        (DashboardFilters(suppliers=("Missing",)), 0, 0),
        (DashboardFilters(countries=("Nowhere",)), 0, 1),
    ],
)
def test_dashboard_scopes(processed, chosen, orders, stock):
    board = dashboard(processed.orders, processed.inventory, processed.returns, chosen)
    assert board.sales.kpis.first()["orders"] == orders
    assert board.inventory.count() == stock
    assert board.summary.first()["active_filter_count"] == chosen.active_count


def test_report_has_all_recommendations(spark, processed):
    analytics = report_analytics(processed, "2025-01")
    sections = report_sections(processed, analytics, summary_recommendations=0)
    assert sections["summary_recommendations"].count() == 0
    assert sections["recommendations"].count() == analytics.recommendations.count()


def test_report_folders(spark, processed, tmp_path):
    analytics = report_analytics(processed, "2025-01")
    sections = report_sections(processed, analytics, include_returns=False)
    assert "returns_reasons" not in sections and "summary_targets" not in sections
    folder = str(tmp_path / "report")
    write_sections(sections, folder)
    assert read_section(spark, folder, "summary_kpis").first()["orders"] == 1
    cards = {r["field"]: r["comparison_text"] for r in read_section(spark, folder, "summary_cards").collect()}
    assert cards["orders"] == "No previous-period data is available for comparison."
    assert {r["key"] for r in read_section(spark, folder, "metadata").collect()} >= {"generated_at", "version"}
    with pytest.raises(ReportError):
        write_sections(sections, folder)
    checks = validation_sections(processed, {"default_currency": "EUR", "api_token": "x"})
    assert {r["key"] for r in checks["configuration"].collect()} == {"default_currency"}
    reviewed = quality_report_sections(processed, {"exclude_invalid_rows": False})
    assert "excluded_rows" not in reviewed and "action_taken" in reviewed["issues"].columns


def test_report_beside_an_earlier_period(spark, processed):
    analytics = report_analytics(processed, "2025-01")
    profiles = spark.createDataFrame([("orders", 10, 3)], "dataset string, file_size bigint, row_count bigint")
    sections = report_sections(processed, analytics, analytics.sales.lines, profiles=profiles)
    changes = {r["metric"]: r["absolute_difference"] for r in sections["summary_comparison"].collect()}
    assert set(changes.values()) == {0} and "net_revenue" in changes
    trend = sections["summary_trend"].first()
    assert trend["current_period_revenue"] == trend["previous_period_revenue"] == D("20.00")
    assert [r["dataset"] for r in sections["sources"].collect()] == ["orders", "Total"]


def test_published_report_is_whole(spark, tmp_path):
    folder = f"{tmp_path}/a report"
    numbers, none = spark.range(7), spark.range(0)
    assert manifest(spark, folder) is None
    first = publish({"kept": numbers, "gone": none}, folder)
    assert [(s.name, s.rows) for s in first.sections] == [("kept", 7), ("gone", 0)]
    assert read_section(spark, folder, "gone").columns == ["id"]
    size = published_size(spark, folder)
    broken = spark.range(3).select(F.raise_error(F.lit("stopped")).alias("id"))
    with pytest.raises(Exception, match="stopped"):
        publish({"kept": spark.range(2), "broken": broken}, folder, overwrite=True)
    assert manifest(spark, folder) == first and read_section(spark, folder, "kept").count() == 7
    assert published_size(spark, folder) == size
    with pytest.raises(ReportError, match="already exists"):
        publish({"kept": numbers}, folder)
    publish({"kept": spark.range(2)}, folder, overwrite=True)
    assert read_section(spark, folder, "kept").count() == 2
    with pytest.raises(ReportError, match="no section"):
        read_section(spark, folder, "gone")
    assert remove_replaced(spark, folder) == 2 and remove_replaced(spark, folder) == 0
    assert read_section(spark, folder, "kept").count() == 2


def test_publishing_at_once_and_after_a_crash(spark, tmp_path):
    folder = str(tmp_path / "report")
    broken = spark.range(3).select(F.raise_error(F.lit("stopped")).alias("id"))
    with pytest.raises(Exception, match="stopped"):
        publish({"broken": broken}, folder)
    assert publish({"a": spark.range(1)}, folder).number == 1
    (tmp_path / "report" / "_manifests" / "00000002.claim").touch()
    assert publish({"a": spark.range(2)}, folder, overwrite=True).number == 3
    with pytest.raises(ReportError, match="meanwhile"):
        _commit(spark, folder, Manifest(3, ()))
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "notes.txt").write_text("mine")
    with pytest.raises(ReportError, match="already exists"):
        publish({"a": spark.range(1)}, str(tmp_path / "other"))
    with pytest.raises(ReportError, match="No report"):
        read_section(spark, str(tmp_path / "other"), "a")


def test_totals(spark):
    assert supports_total("net_revenue") and supports_total("orders")
    assert not supports_total("average_order_value") and not supports_total("unit_price")
    frame = spark.createDataFrame([("a", 1, 2.0), ("b", 2, 3.0)], "name string, units int, rate double")
    assert [tuple(r) for r in section_totals(frame).collect()][-1] == ("Total", 3, None)


def _create(log, started):
    return log.create(
        date(2025, 1, 1), date(2025, 1, 31), {"orders": "/in/orders.csv"}, {"orders": 3, "returns": 2},
        {"theme": "dark", "api_token": "x"}, "0.1.0", started,
    )


def test_run_log(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "runs"))
    first = _create(log, datetime(2025, 1, 2, 9, 0))
    second = _create(log, datetime(2025, 1, 2, 10, 0))
    assert (first, second) == ("RUN-20250102-001", "RUN-20250102-002")
    log.mark_running(first)
    log.mark_completed(first, datetime(2025, 1, 2, 9, 1), 61.2, "/reports/a", 10, 5, 1, 2, 0)
    log.mark_failed(second, "x" * 600, datetime(2025, 1, 2, 10, 1), 3.5)
    runs = {r["run_id"]: r for r in log.runs().collect()}
    assert runs[first]["status"] == "Completed with Warnings"
    assert runs[first]["configuration_snapshot"] == {"theme": "dark"}
    assert runs[second]["failure_summary"] == "x" * 600
    assert [r["run_id"] for r in list_runs(log.runs()).collect()] == [second, first]
    assert list_runs(log.runs(), statuses=("Failed",), run_id_query="-002").count() == 1
    assert list_runs(log.runs(), period_start=date(2025, 2, 1)).isEmpty()
    history = {r["run_id"]: r for r in run_history(log.runs()).collect()}
    assert history[first]["source_rows"] == 5 and history[first]["duration"] == "1m 1s"
    assert history[first]["output_file"] == "File unavailable"
    log.move_report(first, "/elsewhere/b", 12)
    assert log.runs().filter(F.col("run_id") == first).first()["report_filename"] == "b"
    assert log.delete(second) and not log.delete(second)
    assert log.runs().count() == 1
    assert _create(log, datetime(2025, 1, 2, 11, 0)) == "RUN-20250102-003"
    with pytest.raises(RetailDataError):
        log.mark_running("RUN-20250102-009")


def test_run_numbers_over_busy_seconds(spark):
    rows = [(i, datetime(2025, 1, 1, 0, 0, i // 600)) for i in range(1500)]
    frame = spark.createDataFrame(rows, "n int, started_at timestamp")
    ids = {r["n"]: r["run_id"] for r in assign_run_ids(frame, tie=["n"]).collect()}
    assert ids[0] == "RUN-20250101-001" and ids[1499] == "RUN-20250101-1500"
    assert len(set(ids.values())) == 1500
    # Without a column that tells them apart, requests of one instant still get numbers of their own.
    same = spark.range(300).select(F.lit(datetime(2025, 1, 1)).alias("started_at")).repartition(5)
    assert {r["run_id"] for r in assign_run_ids(same).collect()} == {f"RUN-20250101-{n:03d}" for n in range(1, 301)}
    with pytest.raises(ConfigError):
        list_runs(same, limit=0)


def test_report_generation_is_recorded(spark, table, tmp_path):
    tables = {
        "orders": table(
            "order_id string, order_date string, product_id string, quantity string, unit_price string",
            ("O-1", "2025-01-01", "P-1", "2", "10"),
        ),
        "products": table(
            "product_id string, product_name string, purchase_cost string, recommended_price string",
            ("P-1", "Desk", "12", "10"),
        ),
        "inventory": table("product_id string, warehouse string, stock_quantity string", ("P-1", "W", "3")),
        "returns": table(
            "return_id string, order_id string, product_id string, return_date string, "
            "quantity string, refund_amount string",
            ("R-1", "O-1", "P-1", "2025-01-03", "1", "4"),
        ),
    }
    result = process_datasets(tables)
    log = RunLog(spark, str(tmp_path / "runs"))
    folder = str(tmp_path / "report")
    run_id = generate_report(result, folder, log, ReportOptions("2025-01"))
    row = log.runs().first()
    assert (row["run_id"], row["status"], row["warning_count"]) == (run_id, "Completed with Warnings", 1)
    assert row["report_size"] > 0 and row["report_filename"] == "report"
    with pytest.raises(ReportError):
        generate_report(result, folder, log, ReportOptions("2025-01"))
    states = {r["run_id"]: r["status"] for r in log.runs().collect()}
    assert sorted(states.values()) == ["Completed with Warnings", "Failed"]
    with pytest.raises(GateError):
        generate_report(result, folder, log, ReportOptions("2025-01", strict=True))
    assert log.runs().count() == 2


def test_joins_do_not_carry_source_values_of_accepted_rows(small, stage):
    mapped = processing.map_dataset(small["orders"], "orders", "orders")
    cleaned = processing._clean(mapped, processing.CleaningOptions("EUR"), stage)
    shown = {(r["_step"], r["_raw"] is not None) for r in cleaned.collect()}
    assert shown == {(None, False), ("cleaning", True)}


def test_catalog_reads_packed_tables_in_small_parts(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    session = spark.newSession()
    for name in names:
        session.conf.set(name, "64m")
    catalog.run_of(session, "/an/unread/folder")
    assert [session.conf.get(name) for name in names] == ["16m", "16m"]


def test_returns_are_shuffled_once_to_meet_their_orders(spark):
    sold = spark.range(9).selectExpr(
        "cast(id as string) order_id", "cast(id as string) product_id", "current_date() order_date",
        "id quantity", "id unit_price", "cast(null as string) _step",
    )
    back = spark.range(9).selectExpr("cast(id as string) order_id", "'1' product_id", "id return_id")
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, "-1")
    try:
        joined = processing._join_orders(back, sold)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        rows = {(r["order_id"], r["_known_order"], r["_sold_units"]) for r in joined.collect()}
    finally:
        spark.conf.unset(threshold)
    assert rows == {(str(i), True, 1 if i == 1 else None) for i in range(9)}
    # Returns, known orders and sold lines go by order, each of them once.
    assert plan.count("Exchange hashpartitioning(order_id") + plan.count("Exchange hashpartitioning(_") == 3, plan


def test_totals_may_be_wider_than_their_column(spark):
    frame = spark.createDataFrame(
        [("a", D("9000000000000000.5"), 2_000_000_000)] * 2, "name string, target_revenue decimal(22,6), units int"
    )
    totals = section_totals(frame)
    assert [tuple(r) for r in totals.collect()][-1] == ("Total", D("18000000000000001"), 4_000_000_000)
    assert dict(totals.dtypes) == {"name": "string", "target_revenue": "decimal(32,6)", "units": "bigint"}
    shown = spark.createDataFrame([("a", D("1.5"))], "name string, net_revenue decimal(28,2)")
    assert section_totals(shown).dtypes == shown.dtypes


def test_report_computes_shared_tables_once(processed):
    analytics = report_analytics(processed, "2025-01")
    sections = report_sections(processed, analytics)
    for name, staged in {
        "summary_kpis": "report-kpis", "summary_trend": "report-daily", "sales_daily": "report-daily",
        "summary_categories": "report-categories", "products_categories": "report-categories",
        "products_bands": "report-lines-products", "summary_alerts": "report-findings",
        "summary_recommendations": "report-findings", "recommendations": "report-findings",
    }.items():
        files = sections[name].inputFiles()
        assert files and all(staged in file for file in files), name
    assert sections["recommendations"].collect() == analytics.recommendations.collect()
    assert sections["summary_categories"].collect() == analytics.sales.categories.limit(10).collect()


def test_steps_at_once_keep_their_order_and_fail_whole(spark):
    done = at_once(spark, {str(n): (lambda n=n: spark.range(n).count()) for n in range(9)})
    assert list(done.items()) == [(str(n), n) for n in range(9)]
    with pytest.raises(ZeroDivisionError):
        at_once(spark, {"a": lambda: 1, "b": lambda: 1 // 0})

"""Data-quality scores, issue categories, review states, and gates."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.errors import GateError
from tillwise.functions.text import safe_value
from tillwise.operators.issues import ERROR, WARNING, union_all

# Issue categories in display order with short label, explanation, action.
CATEGORIES = (
    (
        "Missing Required Columns", "Missing Columns",
        "Required source fields are missing or cannot be mapped unambiguously.",
        "Return to Upload Data and correct the column mapping or source file.",
    ),
    (
        "Missing Values", "Missing Values",
        "Required row-level values are empty.",
        "Supply the missing values or exclude the affected rows.",
    ),
    (
        "Duplicate Records", "Duplicates",
        "Multiple records use the same business key.",
        "Review the duplicates and retain only the intended record.",
    ),
    (
        "Invalid Data Types", "Invalid Types",
        "Values could not be interpreted as the required number, date, or percentage type.",
        "Correct the source format and validate the files again.",
    ),
    (
        "Invalid Relationships", "Relationship Errors",
        "References between orders, products, inventory, or returns are inconsistent.",
        "Correct the referenced identifiers or add the missing source records.",
    ),
    (
        "Business Rule Violations", "Business Rule Violations",
        "Values violate a business validation rule.",
        "Review the rule message and correct or exclude the affected rows.",
    ),
    (
        "Transformation Warnings", "Transformation Warnings",
        "Values were changed or excluded while normalizing source data.",
        "Review the transformation result and explicitly accept valid warnings.",
    ),
)
STRUCTURAL_CODES = ("missing_required_column", "ambiguous_column_mapping")
RELATIONSHIP_CODES = (
    "unknown_order_id", "unknown_product_id", "return_date_before_order_date",
    "returned_quantity_exceeds_sold",
)
TYPE_CODES = (
    "invalid_date", "invalid_month", "invalid_numeric_value", "invalid_purchase_cost",
    "invalid_quantity", "invalid_restock_date", "invalid_return_quantity",
    "invalid_unit_price", "invalid_vat_rate",
)
PENDING, EXCLUDED = "Pending review", "Excluded from processing"
ACCEPTED = "Accepted with warning"


def row_health(annotated: DataFrame, kind: str, structural: bool = False) -> DataFrame:
    """Rows with an error, rows with warnings only, and clean rows of one dataset.

    A row counts once, by its worst issue. A dataset-level blocker makes every row an error.
    """
    bad = F.lit(structural) | F.exists(
        "_issues", lambda item: (item["severity"] == ERROR) | ~item["row_can_continue"]
    )
    warned = F.exists("_issues", lambda item: item["severity"] == WARNING)
    return annotated.agg(
        F.lit(kind).alias("dataset"),
        F.count("*").alias("total_rows"),
        F.count_if(bad).alias("error_rows"),
        F.count_if(~bad & warned).alias("warning_rows"),
        F.count_if(~bad & ~warned).alias("valid_rows"),
        F.lit(structural).alias("has_dataset_issues"),
    )


def quality_score(health: DataFrame) -> DataFrame:
    """Score per dataset: clean rows count one, warning-only rows a half."""
    earned = F.col("valid_rows") + F.lit(0.5) * F.col("warning_rows")
    empty = F.when(F.col("has_dataset_issues"), 0.0).otherwise(100.0)
    rows = F.when(F.col("total_rows") != 0, F.col("total_rows"))
    share = F.bround(100.0 * earned / rows, 2)
    return health.withColumn(
        "quality_score", F.coalesce(share, empty).cast("double")
    )


def combined_quality(scores: DataFrame) -> DataFrame:
    """Score over all datasets: their rounded scores weighted by rows."""
    weighted = F.sum(F.col("quality_score") * F.col("total_rows"))
    total = F.sum(F.when(F.col("total_rows") != 0, F.col("total_rows")))
    return scores.agg(
        F.sum("total_rows").alias("total_rows"),
        F.sum("valid_rows").alias("valid_rows"),
        F.sum("warning_rows").alias("warning_rows"),
        F.sum("error_rows").alias("error_rows"),
        F.coalesce(
            F.bround(weighted / total, 2), F.bround(F.avg("quality_score"), 2), F.lit(100.0)
        ).alias("quality_score"),
    )


def processing_stats(annotated: DataFrame, kind: str, dataset_issues: int = 0) -> DataFrame:
    active = F.col("_step").isNull()
    return annotated.agg(
        F.lit(kind).alias("dataset"),
        F.count("*").alias("input_rows"),
        F.count_if(active).alias("processed_rows"),
        F.count_if(~active).alias("excluded_rows"),
        (F.coalesce(F.sum(F.size("_issues")), F.lit(0)) + dataset_issues)
        .cast("bigint")
        .alias("issue_count"),
    )


def quality_summary(stats: DataFrame, issues: DataFrame, scores: DataFrame) -> DataFrame:
    """Source, valid, and excluded rows, warnings, errors, and the combined score.

    Three one-row aggregates are laid side by side through a union, not a cross join.
    """
    rows = stats.agg(
        F.sum("input_rows").alias("source_rows"),
        F.sum("processed_rows").alias("valid_rows"),
        F.sum("excluded_rows").alias("excluded_rows"),
    )
    found = issues.agg(
        F.count_if(F.col("severity") == WARNING).alias("warnings"),
        F.count_if(F.col("severity") == ERROR).alias("errors"),
    )
    score = combined_quality(scores).select("quality_score")
    names = ("source_rows", "valid_rows", "excluded_rows", "warnings", "errors", "quality_score")
    return union_all([rows, found, score]).agg(*[F.max(name).alias(name) for name in names])


def category_of(code: Column, severity: Column) -> Column:
    """Management category of an issue; the first matching test decides."""
    name = F.lower(code)
    return (
        F.when(name.isin(*STRUCTURAL_CODES), CATEGORIES[0][0])
        .when(name.startswith("missing_"), CATEGORIES[1][0])
        .when(name.contains("duplicate"), CATEGORIES[2][0])
        .when(name.isin(*RELATIONSHIP_CODES), CATEGORIES[4][0])
        .when(name.isin(*TYPE_CODES), CATEGORIES[3][0])
        .when(severity == WARNING, CATEGORIES[6][0])
        .otherwise(CATEGORIES[5][0])
    )


def categorize_issues(issues: DataFrame) -> DataFrame:
    return issues.withColumn("category", category_of(F.col("issue_code"), F.col("severity")))


def _rank(severity: Column) -> Column:
    return F.when(severity == ERROR, 2).when(severity == WARNING, 1).otherwise(0)


def group_issues(issues: DataFrame) -> DataFrame:
    """Affected rows, highest severity, and texts per category, in display order.

    Rows are counted once per category; each dataset with a dataset-level issue adds one.
    """
    place = F.concat_ws(
        "|",
        "source_dataset",
        F.coalesce("source_filename", F.lit("")),
        F.coalesce(F.col("row_number").cast("string"), F.lit("dataset")),
    )
    texts = {name: (at, label, why, what) for at, (name, label, why, what) in enumerate(CATEGORIES)}

    def text(part: int) -> Column:
        pairs = [x for name, values in texts.items() for x in (F.lit(name), F.lit(values[part]))]
        return F.create_map(*pairs)[F.col("category")]

    grouped = (
        categorize_issues(issues)
        .groupBy("category")
        .agg(
            F.countDistinct(place).alias("affected_rows"),
            F.count("*").alias("issue_count"),
            F.max(_rank(F.col("severity"))).alias("_rank"),
        )
    )
    highest = F.element_at(F.array(F.lit("info"), F.lit("warning"), F.lit("error")), F.col("_rank") + 1)
    return grouped.select(
        "category",
        "affected_rows",
        "issue_count",
        highest.alias("highest_severity"),
        text(2).alias("explanation"),
        text(3).alias("recommended_action"),
    ).orderBy(text(0))


def issue_id(occurrence: Column) -> Column:
    """Key of an issue without its value."""
    return F.concat_ws(
        "|",
        "source_dataset",
        F.coalesce("source_filename", F.lit("")),
        F.coalesce(F.col("row_number").cast("string"), F.lit("dataset")),
        F.coalesce("field", F.lit("")),
        "issue_code",
        occurrence.cast("string"),
    )


def with_issue_ids(issues: DataFrame) -> DataFrame:
    """Add ``issue_id``.

    A row raises a code at most once per field, so the key needs no running number over
    the whole table; its last part stays zero.
    """
    return issues.withColumn("issue_id", issue_id(F.lit(0)))


def no_actions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "issue_id string, action string")


def _decision(action: Column) -> Column:
    structural = (
        (F.col("severity") == ERROR) & F.col("row_number").isNull() & ~F.col("row_can_continue")
    )
    return (
        F.when(structural, "Blocking — source correction required")
        .when(action == EXCLUDED, EXCLUDED)
        .when(action == ACCEPTED, ACCEPTED)
        .when(~F.col("row_can_continue"), "Exclusion required")
        .when(F.col("severity") == WARNING, "Reviewable warning")
        .otherwise("Can continue")
    )


def issue_views(issues: DataFrame, actions: DataFrame) -> DataFrame:
    """Issues with category, recorded action, and decision state."""
    views = with_issue_ids(categorize_issues(issues)).join(actions, "issue_id", "left")
    action = F.coalesce("action", F.lit(PENDING))
    return views.withColumn("action", action).withColumn(
        "processing_status", _decision(F.col("action"))
    )


def _label(category: Column) -> Column:
    pairs = [F.lit(text) for name, label, _, _ in CATEGORIES for text in (name, label)]
    return F.create_map(*pairs)[category]


@dataclass(frozen=True)
class IssueFilters:
    datasets: tuple[str, ...] = ()
    severities: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    filenames: tuple[str, ...] = ()
    processing_statuses: tuple[str, ...] = ()
    search: str = ""


def filter_issue_views(views: DataFrame, filters: IssueFilters) -> DataFrame:
    """Exact choices per dimension and a case-blind search over the visible text."""
    field = F.coalesce("field", F.lit("Not applicable"))
    filename = F.coalesce("source_filename", F.lit("Not available"))
    label = _label(F.col("category"))
    choices: Iterable[tuple[Column, tuple[str, ...]]] = (
        (F.col("source_dataset"), filters.datasets),
        (F.col("severity"), filters.severities),
        (label, filters.categories),
        (field, filters.fields),
        (filename, filters.filenames),
        (F.col("processing_status"), filters.processing_statuses),
    )
    result = views
    for column, accepted in choices:
        if accepted:
            result = result.filter(column.isin(*accepted))
    needle = filters.search.strip().lower()
    if needle:
        haystack = F.concat_ws(
            " ",
            "source_dataset",
            filename,
            field,
            "issue_code",
            "message",
            safe_value(F.col("field"), F.col("original_value"), limit=None),
            "recommended_action",
            label,
            "processing_status",
        )
        result = result.filter(F.lower(haystack).contains(needle))
    return result


def issue_export(issues: DataFrame, actions: DataFrame) -> DataFrame:
    """Issues for sharing: private values hidden, long values cut, action taken."""
    return (
        with_issue_ids(issues)
        .join(actions, "issue_id", "left")
        .select(
            "severity",
            "source_dataset",
            F.col("source_filename").alias("source_file"),
            "row_number",
            "field",
            "issue_code",
            F.col("message").alias("issue"),
            safe_value(F.col("field"), F.col("original_value")).alias("original_value"),
            "recommended_action",
            F.coalesce("action", F.lit(PENDING)).alias("action_taken"),
        )
    )


def mark_excluded(issues: DataFrame) -> DataFrame:
    """Bulk action: every blocking issue is marked as excluded."""
    return with_issue_ids(issues).filter(~F.col("row_can_continue")).select(
        "issue_id", F.lit(EXCLUDED).alias("action")
    )


def accept_and_continue(issues: DataFrame, actions: DataFrame) -> DataFrame:
    """Bulk action: accept every warning, exclude blocking issues not yet decided."""
    known = actions.withColumnRenamed("action", "_action")
    decided = (
        F.when(F.col("severity") == WARNING, ACCEPTED)
        .when(~F.col("row_can_continue"), F.coalesce("_action", F.lit(EXCLUDED)))
        .otherwise(F.col("_action"))
    )
    return (
        with_issue_ids(issues)
        .join(known, "issue_id", "left")
        .select("issue_id", decided.alias("action"))
        .filter("action is not null")
    )


def _gate_counts(issues: DataFrame) -> DataFrame:
    blocking = (F.col("severity") == ERROR) & ~F.col("row_can_continue")
    return issues.agg(
        F.count_if(blocking).alias("blocking_errors"),
        F.count_if(blocking & F.col("row_number").isNull()).alias("structural_errors"),
        F.count_if(F.col("severity") == WARNING).alias("warnings"),
    )


def generation_gate(
    issues: DataFrame, strict: bool = False, allow_warnings: bool = False
) -> DataFrame:
    """Counts and the verdict on whether a report may be generated."""
    verdict = (
        F.when(F.col("blocking_errors") > 0, "blocked by errors")
        .when(
            F.lit(strict and not allow_warnings) & (F.col("warnings") > 0), "blocked by warnings"
        )
        .when(F.lit(strict) & (F.col("warnings") > 0), "allowed with warnings")
        .otherwise("allowed")
    )
    return _gate_counts(issues).withColumn("verdict", verdict)


def ensure_generation_allowed(
    issues: DataFrame, strict: bool = False, allow_warnings: bool = False
) -> bool:
    """Raise unless a report may be generated; true when warnings were let through."""
    row = generation_gate(issues, strict, allow_warnings).first()
    if row["verdict"] == "blocked by errors":
        raise GateError(
            f"Validation found {row['blocking_errors']} blocking error(s); no report was generated."
        )
    if row["verdict"] == "blocked by warnings":
        raise GateError(
            f"Strict mode found {row['warnings']} warning(s); no report was generated."
        )
    return row["verdict"] == "allowed with warnings"


def review_gate(
    issues: DataFrame, actions: DataFrame, warnings_confirmed: bool = False
) -> DataFrame:
    """Whether every exclusion has an action and warnings are confirmed."""
    joined = with_issue_ids(issues).join(
        actions.select("issue_id", F.lit(True).alias("_acted")), "issue_id", "left"
    )
    undecided = ~F.col("row_can_continue") & F.col("_acted").isNull()
    structural = (
        (F.col("severity") == ERROR) & F.col("row_number").isNull() & ~F.col("row_can_continue")
    )
    counts = joined.agg(
        F.count_if(structural).alias("structural_errors"),
        F.count_if(undecided).alias("unresolved_exclusions"),
        F.count_if(F.col("severity") == WARNING).alias("warnings"),
    )
    confirmed = F.lit(warnings_confirmed) | (F.col("warnings") == 0)
    return counts.withColumns(
        {
            "warnings_confirmed": confirmed,
            "may_continue": (F.col("structural_errors") == 0)
            & (F.col("unresolved_exclusions") == 0)
            & confirmed,
        }
    )

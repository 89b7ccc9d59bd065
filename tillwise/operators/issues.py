"""The annotated table, and the issue and exclusion tables read from it.

A dataset travels through cleaning and validation as one table. Each row carries its
issues (``_issues``), its source values (``_raw``) and, once blocked, the step that blocked
it (``_step``). Kept rows, excluded rows, reasons and scores are then plain projections
and filters: no row is looked up again by number and no step rescans the source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INFO, WARNING, ERROR = "info", "warning", "error"
CLEANING, VALIDATION = "cleaning", "validation"
MARKS = ("_issues", "_raw", "_step", "_changes")
ISSUE_TYPE = (
    "struct<severity:string,field:string,issue_code:string,message:string,"
    "original_value:string,recommended_action:string,row_can_continue:boolean>"
)
ISSUE_COLUMNS = (
    "severity", "source_dataset", "source_filename", "row_number", "field", "issue_code",
    "message", "original_value", "recommended_action", "row_can_continue",
)
ISSUE_SCHEMA = (
    "severity string, source_dataset string, source_filename string, row_number bigint, "
    "field string, issue_code string, message string, original_value string, "
    "recommended_action string, row_can_continue boolean"
)
_NO_ISSUES = f"cast(array() as array<{ISSUE_TYPE}>)"


def col(name: str) -> Column:
    """A column by its exact name, whatever characters a source heading contains."""
    escaped = name.replace("`", "``")
    return F.col(f"`{escaped}`")


def issue(
    code: str,
    field: str | None,
    message: str | Column,
    value: Column,
    action: str,
    severity: str = ERROR,
    can_continue: bool = False,
) -> Column:
    return F.struct(
        F.lit(severity).alias("severity"),
        F.lit(field).cast("string").alias("field"),
        F.lit(code).alias("issue_code"),
        (F.lit(message) if isinstance(message, str) else message).alias("message"),
        value.cast("string").alias("original_value"),
        F.lit(action).alias("recommended_action"),
        F.lit(can_continue).alias("row_can_continue"),
    )


def no_issues() -> Column:
    return F.expr(_NO_ISSUES)


def raised(*issues: Column) -> Column:
    """Array of the issues that are not null, in order; nothing is built for a row without any."""
    if not issues:
        return no_issues()
    none = F.coalesce(*issues).isNull()
    return F.when(none, no_issues()).otherwise(F.array_compact(F.array(*issues)))


def blocks(issues: Column) -> Column:
    return F.exists(issues, lambda item: ~item["row_can_continue"])


def is_active() -> Column:
    return F.col("_step").isNull()


def row_id() -> Column:
    return F.struct("source_file", "source_row_number")


def same_key(left: list[Column], right: list[Column]) -> Column:
    """Key equality in which nulls match each other."""
    return reduce(lambda a, b: a & b, (x.eqNullSafe(y) for x, y in zip(left, right, strict=True)))


def data_columns(frame: DataFrame) -> list[str]:
    return [name for name in frame.columns if not name.startswith("_")]


def kept_rows(annotated: DataFrame) -> DataFrame:
    """Rows without a blocking issue, marked as processed."""
    return (
        annotated.filter(is_active())
        .select(*[col(name) for name in data_columns(annotated)])
        .withColumns(
            {
                "processing_status": F.lit("processed"),
                "exclusion_reason": F.lit(None).cast("string"),
            }
        )
    )


def excluded_rows(
    annotated: DataFrame, kind: str, structural_codes: tuple[str, ...] = ()
) -> DataFrame:
    """Blocked rows as text with their reasons.

    A row blocked while cleaning shows its source values, a row blocked by a business rule
    the cleaned ones.
    """
    codes = F.transform(
        F.filter("_issues", lambda item: ~item["row_can_continue"]),
        lambda item: item["issue_code"],
    )
    fixed = F.array(*[F.lit(code) for code in structural_codes]).cast("array<string>")
    reason = F.array_join(F.array_sort(F.array_distinct(F.concat(codes, fixed))), "; ")
    raw = set(annotated.schema["_raw"].dataType.fieldNames())

    def value(name: str) -> Column:
        cleaned = col(name).cast("string")
        if name not in raw:
            return cleaned.alias(name)
        source = F.col("_raw")[name]
        return F.when(F.col("_step") == CLEANING, source).otherwise(cleaned).alias(name)

    trace = ("source_row_number", "processing_status", "exclusion_reason")
    return annotated.filter(~is_active()).select(
        F.lit(kind).alias("source_dataset"),
        *[value(name) for name in data_columns(annotated) if name not in trace],
        "source_row_number",
        F.lit("excluded").alias("processing_status"),
        reason.alias("exclusion_reason"),
    )


def issue_rows(annotated: DataFrame, kind: str) -> DataFrame:
    """One row per issue, in the flat export layout."""
    return (
        annotated.select(
            "source_file", "source_row_number", F.explode("_issues").alias("found")
        )
        .select(
            F.col("found.severity").alias("severity"),
            F.lit(kind).alias("source_dataset"),
            F.col("source_file").alias("source_filename"),
            F.col("source_row_number").cast("bigint").alias("row_number"),
            "found.field",
            "found.issue_code",
            "found.message",
            "found.original_value",
            "found.recommended_action",
            "found.row_can_continue",
        )
    )


def dataset_issues(
    spark: SparkSession, kind: str, filename: str | None, found: list[tuple[str, str, str, str]]
) -> DataFrame:
    """Dataset-level issues from (field, code, message, action), with an optional value."""
    rows = [
        (ERROR, kind, filename, None, entry[0], entry[1], entry[2],
         entry[4] if len(entry) > 4 else None, entry[3], False)
        for entry in found
    ]
    return spark.createDataFrame(rows, ISSUE_SCHEMA)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name; a column that one table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

"""Run log as an append-only table of run states.

Nothing is updated in place. Each change appends the run's new state with the next state
number; the newest state of a run is its current record, a tombstone deletes it.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillwise.errors import ConfigError, RetailDataError
from tillwise.functions.text import (
    base_name,
    duration_label,
    redact_failure,
    safe_settings,
)
from tillwise.operators.issues import union_all
from tillwise.operators.prefix import row_numbers
from tillwise.staging import Stage

# Run states.
PENDING, RUNNING, COMPLETED = "Pending", "Running", "Completed"
WITH_WARNINGS, FAILED, CANCELLED = "Completed with Warnings", "Failed", "Cancelled"
RUN_SCHEMA = (
    "run_id string, started_at timestamp, completed_at timestamp, status string, "
    "reporting_period_start date, reporting_period_end date, "
    "source_filenames map<string,string>, source_row_counts map<string,bigint>, "
    "processed_row_count bigint, excluded_row_count bigint, warning_count bigint, "
    "error_count bigint, report_path string, report_filename string, report_size bigint, "
    "configuration_snapshot map<string,string>, application_version string, "
    "failure_summary string, duration_seconds double, state_number bigint, deleted boolean"
)


def assign_run_ids(
    requests: DataFrame,
    existing: DataFrame | None = None,
    tie: Sequence[str] = (),
    stage: Stage | None = None,
) -> DataFrame:
    """Add ``run_id`` as ``RUN-yyyyMMdd-NNN``, counting on from the ids of that day.

    Requests are numbered by day in the order of their start and of the columns in ``tie`` (without
    any, requests of one instant are numbered as they are read). The day is dealt out by ranges of
    that order, so requests that all start in one second still spread over tasks.
    """
    order = ["started_at", *tie]
    timed = requests.withColumn("_day", F.date_format("started_at", "yyyyMMdd"))
    if not tie:
        timed = timed.withColumn("_place", F.monotonically_increasing_id())
        order.append("_place")
    numbered = row_numbers(timed, order, "_number", ["_day"], stage)
    if existing is None:
        numbered = numbered.withColumn("_used", F.lit(0))
    else:
        used = existing.groupBy(F.substring("run_id", 5, 8).alias("_day")).agg(
            F.max(F.substring_index("run_id", "-", -1).cast("int")).alias("_used")
        )
        numbered = numbered.join(used, "_day", "left")
    number = F.coalesce("_used", F.lit(0)) + F.col("_number")
    return numbered.withColumn(
        "run_id", F.concat(F.lit("RUN-"), F.col("_day"), F.lit("-"), F.format_string("%03d", number))
    ).drop("_day", "_place", "_number", "_used")


def latest_runs(log: DataFrame) -> DataFrame:
    """Current record of every run that was not deleted."""
    fields = [name for name in log.columns if name != "run_id"]
    return (
        log.groupBy("run_id")
        .agg(F.max_by(F.struct(*fields), "state_number").alias("state"))
        .select("run_id", "state.*")
        .filter(~F.coalesce("deleted", F.lit(False)))
    )


def list_runs(
    runs: DataFrame,
    statuses: Sequence[str] = (),
    period_start: date | None = None,
    period_end: date | None = None,
    started_from: date | None = None,
    started_to: date | None = None,
    run_id_query: str = "",
    limit: int = 500,
) -> DataFrame:
    """Newest runs first: status, overlapping period, start days, part of the id.

    ``limit`` counts the runs that match; it must be positive.
    """
    if limit < 1:
        raise ConfigError(f"The limit of a run list must be positive, not {limit}.")
    result = runs
    if statuses:
        result = result.filter(F.col("status").isin(*statuses))
    if period_start is not None:
        result = result.filter(F.col("reporting_period_end") >= F.lit(period_start))
    if period_end is not None:
        result = result.filter(F.col("reporting_period_start") <= F.lit(period_end))
    if started_from is not None:
        result = result.filter(F.col("started_at") >= F.lit(started_from).cast("timestamp"))
    if started_to is not None:
        after = started_to + timedelta(days=1)
        result = result.filter(F.col("started_at") < F.lit(after).cast("timestamp"))
    needle = run_id_query.strip().lower()
    if needle:
        result = result.filter(F.lower("run_id").contains(needle))
    return result.orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)


def output_label(available: Column) -> Column:
    recorded = F.coalesce("report_filename", "report_path").isNotNull()
    return (
        F.when(available, F.coalesce("report_filename", F.lit("Report")))
        .when(recorded, "File unavailable")
        .otherwise("Not generated")
    )


def run_history(runs: DataFrame, availability: DataFrame | None = None) -> DataFrame:
    """Display table of runs; ``availability`` lists run ids whose report can be read."""
    if availability is None:
        marked = runs.withColumn("_available", F.lit(False))
    else:
        listed = availability.select("run_id", F.lit(True).alias("_available"))
        marked = runs.join(listed, "run_id", "left").withColumn(
            "_available", F.coalesce("_available", F.lit(False))
        )
    counts = F.map_values("source_row_counts")
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda total, rows: total + rows)
    return marked.select(
        "run_id",
        "status",
        F.concat(
            F.date_format("reporting_period_start", "yyyy-MM-dd"),
            F.lit(" to "),
            F.date_format("reporting_period_end", "yyyy-MM-dd"),
        ).alias("reporting_period"),
        "started_at",
        duration_label(F.col("duration_seconds")).alias("duration"),
        total.alias("source_rows"),
        F.col("excluded_row_count").alias("excluded_rows"),
        F.col("warning_count").alias("warnings"),
        F.col("error_count").alias("errors"),
        output_label(F.col("_available")).alias("output_file"),
        F.when(F.col("_available"), "View details · Download")
        .otherwise("View details")
        .alias("actions"),
    )


def run_details(runs: DataFrame) -> DataFrame:
    """Safe detail columns: base file names, settings without secrets, redacted failure."""
    return runs.select(
        "run_id",
        F.transform_values("source_filenames", lambda _kind, name: base_name(name)).alias(
            "source_filenames"
        ),
        safe_settings(F.col("configuration_snapshot")).alias("configuration_snapshot"),
        redact_failure(F.col("failure_summary")).alias("failure_summary"),
    )


class RunLog:
    """Lifecycle of runs in one append-only Parquet table.

    Appends of concurrent drivers must be serialised by the caller: a folder of files has
    no lock with which to hand out the next number of a day.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path

    def states(self) -> DataFrame:
        """All states; an empty table before the first run."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(path):
            return self.spark.createDataFrame([], RUN_SCHEMA)
        return self.spark.read.schema(RUN_SCHEMA).parquet(self.path)

    def runs(self) -> DataFrame:
        return latest_runs(self.states())

    def _append(self, frame: DataFrame) -> None:
        frame.write.mode("append").parquet(self.path)

    def create(
        self,
        period_start: date,
        period_end: date,
        source_filenames: dict[str, str],
        source_row_counts: dict[str, int],
        configuration: dict[str, object],
        application_version: str,
        started_at: datetime,
    ) -> str:
        """Record a pending run and return its id."""
        values = {name: None for name in self.spark.createDataFrame([], RUN_SCHEMA).columns}
        values.update(
            started_at=started_at,
            status=PENDING,
            reporting_period_start=period_start,
            reporting_period_end=period_end,
            source_filenames=dict(source_filenames),
            source_row_counts={k: int(v) for k, v in source_row_counts.items()},
            processed_row_count=0,
            excluded_row_count=0,
            warning_count=0,
            error_count=0,
            configuration_snapshot={k: str(v) for k, v in configuration.items()},
            application_version=application_version,
            state_number=1,
            deleted=False,
        )
        request = self.spark.createDataFrame([tuple(values.values())], RUN_SCHEMA)
        request = request.withColumn(
            "configuration_snapshot", safe_settings(F.col("configuration_snapshot"))
        )
        identified = assign_run_ids(request.drop("run_id"), self.states())
        state = self.spark.createDataFrame(
            identified.select(*values).collect(), RUN_SCHEMA
        )
        self._append(state)
        return state.first()["run_id"]

    def _change(self, run_id: str, changes: dict[str, Column]) -> None:
        current = self.runs().filter(F.col("run_id") == run_id)
        rows = (
            current.withColumns(changes)
            .withColumn("state_number", F.col("state_number") + 1)
            .collect()
        )
        if not rows:
            raise RetailDataError(f"Run '{run_id}' was not found.")
        names = self.states().columns
        self._append(self.spark.createDataFrame([tuple(rows[0][n] for n in names)], RUN_SCHEMA))

    def mark_running(self, run_id: str) -> None:
        self._change(run_id, {"status": F.lit(RUNNING)})

    def mark_completed(
        self,
        run_id: str,
        completed_at: datetime,
        duration_seconds: float,
        report_path: str,
        report_size: int,
        processed: int,
        excluded: int,
        warnings: int,
        errors: int,
    ) -> None:
        self._change(
            run_id,
            {
                "status": F.lit(WITH_WARNINGS if warnings > 0 else COMPLETED),
                "completed_at": F.lit(completed_at),
                "duration_seconds": F.lit(float(duration_seconds)),
                "report_path": F.lit(report_path),
                "report_filename": base_name(F.lit(report_path)),
                "report_size": F.lit(report_size).cast("bigint"),
                "processed_row_count": F.lit(processed).cast("bigint"),
                "excluded_row_count": F.lit(excluded).cast("bigint"),
                "warning_count": F.lit(warnings).cast("bigint"),
                "error_count": F.lit(errors).cast("bigint"),
                "failure_summary": F.lit(None).cast("string"),
            },
        )

    def mark_failed(
        self,
        run_id: str,
        failure: str,
        completed_at: datetime,
        duration_seconds: float,
        processed: int = 0,
        excluded: int = 0,
        warnings: int = 0,
        errors: int = 0,
    ) -> None:
        self._change(
            run_id,
            {
                "status": F.lit(FAILED),
                "failure_summary": F.lit(failure),
                "completed_at": F.lit(completed_at),
                "duration_seconds": F.lit(float(duration_seconds)),
                "processed_row_count": F.lit(processed).cast("bigint"),
                "excluded_row_count": F.lit(excluded).cast("bigint"),
                "warning_count": F.lit(warnings).cast("bigint"),
                "error_count": F.lit(errors).cast("bigint"),
            },
        )

    def mark_cancelled(
        self, run_id: str, completed_at: datetime, duration_seconds: float
    ) -> None:
        self._change(
            run_id,
            {
                "status": F.lit(CANCELLED),
                "completed_at": F.lit(completed_at),
                "duration_seconds": F.lit(float(duration_seconds)),
            },
        )

    def move_report(self, run_id: str, path: str | None, size: int | None = None) -> None:
        name = base_name(F.lit(path)) if path else F.lit(None).cast("string")
        self._change(
            run_id,
            {
                "report_path": F.lit(path).cast("string"),
                "report_filename": name,
                "report_size": F.lit(size).cast("bigint"),
            },
        )

    def delete(self, run_id: str) -> bool:
        """Delete the record (not the report); false when there is none."""
        if self.runs().filter(F.col("run_id") == run_id).isEmpty():
            return False
        self._change(run_id, {"deleted": F.lit(True)})
        return True


def append_states(states: Sequence[DataFrame]) -> DataFrame:
    """Several batches of states as one log."""
    return union_all(list(states))

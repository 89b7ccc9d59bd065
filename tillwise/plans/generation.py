"""From a processed result to a report folder with its run record."""

from __future__ import annotations

import time
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame

from tillwise import __version__
from tillwise.errors import RetailDataError
from tillwise.operators.filters import reporting_period
from tillwise.operators.inventory import Thresholds
from tillwise.operators.quality import ensure_generation_allowed
from tillwise.plans.processing import ProcessingResult
from tillwise.plans.publishing import published_size
from tillwise.plans.reporting import report_analytics, report_sections, write_sections
from tillwise.plans.runlog import RunLog


@dataclass(frozen=True)
class ReportOptions:
    """What goes into a report and which warnings may pass."""

    period: str | None = None
    thresholds: Thresholds | Mapping[str, object] | None = None
    strict: bool = False
    allow_warnings: bool = False
    overwrite: bool = False
    include: Mapping[str, bool] = field(default_factory=dict)
    profiles: DataFrame | None = None


def generate_report(
    result: ProcessingResult, path: str, log: RunLog, options: ReportOptions | None = None
) -> str:
    """Check the gate, write the report, and record the run; return the run id.

    A run that fails after it was recorded is marked as failed and the error is raised.
    """
    options = options or ReportOptions()
    ensure_generation_allowed(result.issues, options.strict, options.allow_warnings)
    period = reporting_period(options.period, result.orders)
    summary = result.summary.first()
    counts = {row["dataset"]: row["input_rows"] for row in result.statistics.collect()}
    started, clock = datetime.now(UTC), time.monotonic()
    run_id = log.create(
        period.start,
        period.end,
        {kind: kind for kind in counts},
        counts,
        {"period": options.period, "strict": options.strict, "overwrite": options.overwrite},
        __version__,
        started,
    )
    log.mark_running(run_id)
    totals = {
        "processed": summary["valid_rows"],
        "excluded": summary["excluded_rows"],
        "warnings": summary["warnings"],
        "errors": summary["errors"],
    }
    try:
        analytics = report_analytics(result, f"{period.start}:{period.end}", options.thresholds)
        sections = report_sections(
            result, analytics, report_id=run_id, profiles=options.profiles, generated_at=started,
            **options.include,
        )
        write_sections(sections, path, options.overwrite)
    except Exception as error:
        known = isinstance(error, RetailDataError)
        log.mark_failed(
            run_id,
            str(error) if known else "Unexpected report failure.",
            datetime.now(UTC),
            round(time.monotonic() - clock, 3),
            **totals,
        )
        raise
    log.mark_completed(
        run_id,
        completed_at=datetime.now(UTC),
        duration_seconds=round(time.monotonic() - clock, 3),
        report_path=path,
        report_size=published_size(log.spark, path),
        **totals,
    )
    return run_id

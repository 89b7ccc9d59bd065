"""Running totals and row numbers over ordered tables, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.staging import Stage


def _names(prefix: str, columns: Sequence[str], frame: DataFrame) -> list[str]:
    """Names for as many new columns, none of which the frame has."""
    taken, made = {c.lower() for c in frame.columns}, []
    for column in columns:
        name = f"{prefix}{column}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name)
        made.append(name)
    return made


def running_totals(
    frame: DataFrame,
    order: Sequence[Column | str],
    name: str,
    weight: Column | str | None = None,
    groups: Sequence[str] = (),
    stage: Stage | None = None,
) -> DataFrame:
    """Add ``name``: what the rows before each row weigh, in its group and in the given order.

    Without a weight that is the number of earlier rows. The rows are dealt out by ranges of the
    groups and the order, so a large group is spread over tasks; each range of a group adds up on
    its own and starts from the totals of the group's earlier ranges, of which there are no more
    than tasks and groups. Rows that the order does not tell apart lie in one range: give an order
    that does. They get totals of their own, in any order; null weights count as nothing, and null
    groups are groups. The rows are written once, so that ranges stay as they are when a task runs
    again.
    """
    stage = stage or Stage(frame.sparkSession)
    part, own, before, total = _names("_", ("part", "weight", "before", "total"), frame)
    ordered = [F.col(c) if isinstance(c, str) else c for c in order]
    value = F.lit(1) if weight is None else F.coalesce(weight if isinstance(weight, Column) else F.col(weight), F.lit(0))
    ranged = stage.write(
        frame.repartitionByRange(*[F.col(g) for g in groups], *ordered)
        .withColumns({part: F.spark_partition_id(), own: value.cast("bigint")}),
        "ranged",
    )
    earlier = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*groups, part)
        .agg(F.sum(own).alias(total))
        .select(
            *[F.col(g).alias(f"{before}_{i}") for i, g in enumerate(groups)],
            F.col(part).alias(f"{before}_part"),
            F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias(before),
        )
    )
    same = F.col(part) == F.col(f"{before}_part")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"{before}_{i}"))
    inside = Window.partitionBy(*groups, part).orderBy(*ordered).rowsBetween(Window.unboundedPreceding, -1)
    kept = [F.col(c) for c in frame.columns if c != name]
    return (
        ranged.withColumn(total, F.coalesce(F.sum(own).over(inside), F.lit(0)))
        .join(offsets, same)
        .select(*kept, (F.col(total) + F.col(before)).alias(name))
    )


def row_numbers(
    frame: DataFrame,
    order: Sequence[Column | str],
    name: str,
    groups: Sequence[str] = (),
    stage: Stage | None = None,
) -> DataFrame:
    """Add ``name``: each row's number in its group, from 1, in the given order."""
    counted = running_totals(frame, order, name, groups=groups, stage=stage)
    return counted.withColumn(name, F.col(name) + 1)

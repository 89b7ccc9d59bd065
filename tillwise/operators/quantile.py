"""Exact quantiles of a distributed column."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.operators.prefix import running_totals
from tillwise.staging import Stage

_VALUE = "decimal(38,12)"


def exact_quantile(
    frame: DataFrame, column: str, share: float, name: str = "quantile", stage: Stage | None = None
) -> DataFrame:
    """One row with the quantile, interpolated between neighbours; null if there are no values.

    Values are counted first, so a frequent value is a single row. The counted values are dealt
    out by ranges whose borders come from a sample; running totals over the ranges tell which
    ranks each value holds, and the two wanted ranks are looked up in the ranges that hold them.
    Nothing passes through the driver, and no task sees more than a range.
    """
    if not 0 <= share <= 1:
        raise ValueError(f"A quantile's share must be between zero and one, not {share}.")
    stage = stage or Stage(frame.sparkSession)
    counted = (
        frame.select(F.col(column).cast(_VALUE).alias("value"))
        .filter("value is not null")
        .groupBy("value")
        .agg(F.count("*").alias("copies"))
    )
    placed = stage.write(running_totals(counted, ["value"], "before", "copies", stage=stage), "ranks")
    total = placed.select(F.sum("copies")).scalar()
    position = F.lit(Decimal(str(share))) * (total - 1)
    rank = F.floor(position).cast("bigint")

    def holds(wanted: Column) -> Column:
        return (F.col("before") <= wanted) & (wanted < F.col("before") + F.col("copies"))

    near = placed.withColumns({"rank": rank, "rest": (position - rank).cast("decimal(18,17)")}).filter(
        holds(F.col("rank")) | holds(F.col("rank") + 1)
    )
    ends = near.agg(
        F.min(F.when(holds(F.col("rank")), F.col("value"))).alias("low"),
        F.min(F.when(holds(F.col("rank") + 1), F.col("value"))).alias("high"),
        F.min("rest").alias("rest"),
    )
    step = F.coalesce(F.col("high") - F.col("low"), F.lit(0)).cast("decimal(30,12)")
    # The share of a step is rounded once, at the values' own scale.
    return ends.select((F.col("low") + (step * F.col("rest")).cast("decimal(30,12)")).cast(_VALUE).alias(name))
